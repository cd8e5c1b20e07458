"""Registered queries of the library, by family, each with the SQL that must give the same rows."""

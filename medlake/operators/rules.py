"""Rule tables turned into column expressions: first match, most matches, tiers and audits.

A rule set is small configuration, so it is compiled into the plan: no rule join, no UDF,
one pass over the phrases, and constant patterns compiled once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """Patterns of one label: direct and associated evidence, and what excludes a phrase."""

    direct: tuple[str, ...] = ()
    associated: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    global_exclude: tuple[str, ...] = field(default=())


def hits(text: Column, patterns: tuple[str, ...]) -> Column:
    """Array of the patterns that match, in order."""
    if not patterns:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(p)) for p in patterns)))


def first_match(text: Column, rules: list[tuple[str, str]], default: str = "other") -> Column:
    """The label of the first pattern that matches."""
    return reduce(lambda acc, r: acc.when(text.rlike(r[1]), r[0]), rules, F.when(F.lit(False), "")).otherwise(default)


def most_hits(text: Column, rules: dict[str, tuple[str, ...]], default: str = "other") -> Column:
    """The label with the most matching patterns, the earlier of equals."""
    scored = [F.struct(reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in ps]).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(rules.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def tier(text: Column, profile: Profile) -> Column:
    """Struct of tier, score and matched patterns.

    Excluded phrases score 0; direct ones 100 + 5 a hit and associated ones 50 + 5 a hit,
    less their words up to 30; the rest is rejected.
    """
    words = F.least(F.size(F.filter(F.split(text, "[ ]+"), lambda w: w != "")), F.lit(30))
    bad, direct, assoc = hits(text, profile.global_exclude + profile.exclude), hits(text, profile.direct), hits(text, profile.associated)
    row = lambda name, score, found: F.struct(F.lit(name).alias("tier"), score.cast("int").alias("score"), found.alias("matched"))
    return (
        F.when(F.size(bad) > 0, row("excluded", F.lit(0), bad))
        .when(F.size(direct) > 0, row("direct", 100 + 5 * F.size(direct) - words, direct))
        .when(F.size(assoc) > 0, row("associated", 50 + 5 * F.size(assoc) - words, assoc))
        .otherwise(row("rejected", F.lit(0), bad))
    )


def resolve(text: Column, label: Column, category: Column, cascade: list[tuple[str, str | None, Profile]]) -> Column:
    """Struct of profile number, tier, score and matched patterns.

    A label, with its category where a line of the cascade asks for one, takes the first
    line that matches; a label without one has the empty profile, which rejects, as -1.
    """
    row = lambda i, t: F.struct(F.lit(i).alias("profile"), t["tier"].alias("tier"), t["score"].alias("score"), t["matched"].alias("matched"))
    out = F.when(F.lit(False), row(-1, tier(text, Profile())))
    for i, (name, kind, profile) in enumerate(cascade):
        hit = label.rlike(name) & category.rlike(kind) if kind else label.rlike(name)
        out = out.when(hit, row(i, tier(text, profile)))
    return out.otherwise(row(-1, tier(text, Profile())))


def review_status(n_direct: Column, n_associated: Column, enough: int = 10) -> Column:
    """Decision table over the tiers a label has."""
    return F.when(n_direct >= enough, "ok").when(n_direct + n_associated >= enough, "support_only").when(n_direct + n_associated > 0, "review").otherwise("empty")


def audit(tier_: Column, excluded_by: Column, ladder: list[tuple[str, str]]) -> Column:
    """Retain, or the reason code of the first ladder pattern found in the excluding rule."""
    reason = reduce(lambda acc, r: acc.when(F.contains(excluded_by, F.lit(r[0])), r[1]), ladder, F.when(F.lit(False), ""))
    return F.when(tier_ == "direct", "retain").when(tier_ == "associated", "support").when(tier_ == "excluded", reason.otherwise("excluded_other")).otherwise("no_rule")

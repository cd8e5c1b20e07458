"""Text and code expressions; patterns stay within what Java and RE2 share, unless said otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[ \\t\\r\\n\\f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed (F2)."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def recode(c: Column, names: dict[str, str], default: str | None = None) -> Column:
    """Values mapped by a fixed dictionary."""
    out = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return out.otherwise(default if default is not None else c)


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def missing_text(c: Column) -> Column:
    """Null, empty, or the stock phrase for absent text."""
    return F.coalesce(F.lower(F.trim(c)).isin("", "not given", "not given."), F.lit(True))


def text_id(c: Column) -> Column:
    """First 16 hex digits of the SHA-1."""
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def slug(c: Column, default: str = "item") -> Column:
    """Lower-case words joined by underscores."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", default).otherwise(s)


def letters(c: Column) -> Column:
    """Number of ASCII letters (P10)."""
    return F.length(F.regexp_replace(F.lower(c), "[^a-z]", ""))


#: What makes a phrase unsafe to send to a search.
UNSAFE = r"\d|@|https?://|\b(?:mrn|accession|patient|name|dob|date|id)\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"


def pii_like(c: Column) -> Column:
    """Digits, addresses, links, identifier and month words."""
    return F.lower(c).rlike(UNSAFE)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, squeezed white space, lower case.

    Spark has no function for the composition, and Arrow's doesn't compose; texts of plain
    ASCII need none and stay in the JVM.
    """
    @F.arrow_udf("string")
    def normal(rows: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in rows.to_pylist()], pa.string())

    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.lower(F.trim(F.regexp_replace(F.when(plain, c).otherwise(normal(F.when(~plain, c))), r"(?U)\s+", " ")))


def tex(c: Column) -> Column:
    """Text with the characters escaped that TeX reads as commands."""
    out = F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\u0001")), "([&%$#_{}])", r"\\$1")
    for char, command in (("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\u0001", r"\textbackslash{}")):
        out = F.replace(out, F.lit(char), F.lit(command))
    return out


def few_shot(task: str, examples: list[tuple[str, str]], question: Column) -> Column:
    """A prompt of a task, worked examples and the text in question."""
    shown = [f"Input: {x}\nOutput: {y}" for x, y in examples]
    return F.concat_ws("\n\n", F.lit(task), *map(F.lit, shown), F.concat(F.lit("Input: "), question, F.lit("\nOutput:")))


def display_group(label: Column, groups: dict[str, list[str]], default: str = "Other") -> Column:
    """The group that lists a label, with a capital first letter."""
    return sentence_case(recode(label, {x: g for g, xs in groups.items() for x in xs}, default))


def sentences(c: Column) -> Column:
    """Non-empty sentences: split behind . ; ! ? and at line ends."""
    marked = F.regexp_replace(c, "([.;!?])[ \\t]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "[\\r\\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-case ASCII words and numbers."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def canonical_code(c: Column) -> Column:
    """Trimmed, upper-case, without dots."""
    return F.replace(F.upper(F.trim(c)), F.lit("."), F.lit(""))


def canonical_id(c: Column) -> Column:
    """An id without the ".0" that a float column leaves; never shortens 1240 (F32, Q5)."""
    return F.regexp_replace(F.trim(c), "[.]0+$", "")


def ancestors(code: Column) -> Column:
    """The code and its decimal truncations, longest first: 250.22, 250.2, 250."""
    base, tail = F.split_part(code, F.lit("."), F.lit(1)), F.split_part(code, F.lit("."), F.lit(2))
    n = F.length(tail)
    cut = F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.concat(base, F.lit("."), F.substring(tail, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(code), cut, F.when(n > 0, F.array(base)).otherwise(F.array().cast("array<string>")))


def truthy(c: Column) -> Column:
    """Common spellings of yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def clean_report(c: Column) -> Column:
    """The report-cleaning chain (F1): section, list marks, labels, administrative tail, repeated sentences.

    A blank text stays as it is; a text of which nothing is left gives its squeezed form.
    """
    low = F.lower(c)
    after = lambda word: F.when(F.instr(low, word) > 0, F.substring(c, F.instr(low, word) + len(word), F.length(c)))
    body = F.coalesce(after("impression:"), after("findings:"), c)
    for pattern, put in (("(?m)^[ \\t]*[0-9]+[.)][ \\t]+", ""), ("[*]+", ""), ("\\b[A-Z][a-zA-Z \\t\\r\\n]*:[ \\t\\r\\n]*", ""), ("(?m)^[ \\t]*[-\u2022][ \\t]+", "")):
        body = F.regexp_replace(body, pattern, put)
    body = F.regexp_replace(squeeze(body), "(?i)(electronically signed|dictated by|report signed).*$", "")
    admin = "discussed with|telephone|please call"
    parts = F.filter(F.transform(F.split(body, "[.]"), lambda s: F.trim(s)), lambda s: (s != "") & ~F.lower(s).rlike(admin))

    def joined(p: Column) -> Column:
        names = F.array_distinct(F.transform(p, F.lower))
        first = lambda low: F.transform(names, lambda n: F.get(p, F.array_position(low, n).cast("int") - 1))
        return F.when(F.size(p) == 0, squeeze(c)).otherwise(F.concat(F.array_join(let(F.transform(p, F.lower), first), ". "), F.lit(".")))

    return F.when(c.isNull() | (F.trim(c) == ""), c).otherwise(let(parts, joined))


def drop_sections(c: Column, unwanted: list[str]) -> Column:
    """Sections whose header holds an unwanted word go; the text before the first header stays."""
    header = "(?m)((?:^|[.\\n])[ \\t]*)([A-Z][A-Za-z]*(?: [A-Za-z]+){0,4}[ \\t]*:)"
    parts = F.split(F.regexp_replace(c, header, "$1\u0001$2"), "\u0001")
    bad = "(?i)(" + "|".join(unwanted) + ")"
    kept = F.filter(parts, lambda s, i: (i == 0) | ~F.substring_index(s, ":", 1).rlike(bad))
    return squeeze(F.array_join(kept, ""))


#: The gates of phrase polarity, in their order.
UNCERTAIN = r"\bcannot\s+(?:be\s+)?(?:exclude|excluded|rule(?:d)?\s+out)\b|\bcan\s+not\s+(?:be\s+)?(?:exclude|excluded|rule(?:d)?\s+out)\b|\bnot\s+excluded\b|\brule\s+out\b|\br/o\b|\bpossible\b|\bpossibly\b|\bprobable\b|\bprobably\b|\blikely\b|\bmay\b|\bmight\b|\bcould\b|\bequivocal\b|\bindeterminate\b|\bsuspected\b|\bsuspicious\b|\bconcerning\b|\bquestion(?:able)?\b|\bversus\b|\bvs\.?\b|\?"
PARTIAL = r"^no\s+fat\s+plane\b|^no\s+(?:new(?:ly)?|other|additional|associated|further|remaining|interval)\b|^no\s+(?:increase|decrease|progression|worsening|improvement)\s+(?:in|of)\b|^no\s+(?:significant|definite|definitive|discrete|convincing|obvious|gross|apparent|evident|clear|discernible|visualized|appreciable|substantial|sizable|large|major|measurable|acute|bilateral|unilateral|worrisome|dominant|obstructing)\b|\bno\s+(?:significant\s+)?(?:interval\s+)?change\b|\bwithout\s+(?:significant\s+)?(?:interval\s+)?change\b|\bnot\s+significantly\s+changed\b|\bno\s+longer\b"
TECHNICAL = r"\bnot\s+(?:well|clearly|definitely|adequately|optimally)\s+(?:visualized|seen|identified|evaluated)\b|\blimited\s+(?:exam|examination|evaluation|assessment)\b|\bmotion\s+artifact\b|\black\s+of\s+(?:iv\s+)?contrast\b|\bstatus\s+post\b|\bsurgically\s+absent\b|\bpost[- ]?(?:operative|surgical)\b|\bresolved\b|\bresolution\s+of\b|\bcleared\b"
MIXED = r"\bbut\b|\bhowever\b|\balthough\b|\bexcept\b|\bapart\s+from\b|\bother\s+than\b|\bas\s+well\s+as\b|[;:]"
NORMAL = r"\bunremarkable\b|\bwithin\s+normal\s+limits\b|\bnormal\b|\bpatent\b"
NEGATED_BEFORE = r"^(?:there\s+(?:is|are|was|were)\s+)?(?:no\b|never\b|without\b|(?:an?\s+)?absence\s+of\b|negative\s+for\b|free\s+of\b|clear\s+of\b|lack\s+of\b)"
NEGATED_BEHIND = r"^[^,;:]+?\s+(?:(?:is|are|was|were|has\s+been|have\s+been)\s+)?(?:absent|not\s+(?:present|detected|demonstrated|evident|visible|enlarged|dilated|distended|aneurysmal|obstructed|occluded|thickened))(?:\s+(?:on|at|in|within|by|from)\b[^,;:]*)?$"
NEGATION = r"\bno\b|\bnot\b|\bnever\b|\bwithout\b|\babsence\b|\babsent\b|\bnegative\s+for\b|\bfree\s+of\b|\bclear\s+of\b|\black\s+of\b|\bexcluded\b|\bruled\s+out\b"
POLARITY = (
    ("^$", "excluded", "empty"),
    (UNCERTAIN, "excluded", "uncertain_or_hedged"),
    (PARTIAL, "excluded", "partial_or_temporal_negation"),
    (TECHNICAL, "excluded", "technical_temporal_or_surgical"),
    (MIXED, "excluded", "mixed_clause"),
    (NORMAL, "excluded", "normality_boilerplate"),
    (NEGATED_BEFORE, "negated", "strong_prefix_negation"),
    (NEGATED_BEHIND, "negated", "strong_post_negation"),
    (NEGATION, "excluded", "unresolved_negation"),
)


def polarity(normalised: Column) -> Column:
    """Whole-phrase polarity and its reason, by ordered gates (F24), of a phrase from :func:`nfkc`."""
    row = lambda p, why: F.struct(F.lit(p).alias("polarity"), F.lit(why).alias("reason"))
    t = F.coalesce(normalised, F.lit(""))
    return reduce(lambda acc, g: acc.when(t.rlike(g[0]), row(*g[1:])), POLARITY[1:], F.when(t.rlike(POLARITY[0][0]), row(*POLARITY[0][1:]))).otherwise(row("affirmative", "affirmative"))

"""Coded events to label matrices: code maps, hierarchy expansion, time windows, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.functions.text import ancestors, canonical_code, truthy


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Columns found under any of several names, whatever their case; a missing one is an error."""
    have = {c.lower(): c for c in df.columns}
    picked = []
    for name, options in wanted.items():
        found = next((have[o.lower()] for o in options if o.lower() in have), None)
        if found is None:
            raise ValueError(f"no column for {name}: looked for {options} among {df.columns}")
        picked.append(F.col(found).alias(name))
    return df.select(*picked)


def code_map(rows: DataFrame, codes: list[str], target: str, exclude: str | None = None) -> DataFrame:
    """(code, target) from several source-code columns; excluded and blank rows go."""
    kept = rows.where(~truthy(F.col(exclude))) if exclude else rows
    long = kept.select(F.explode(F.array(*(canonical_code(F.col(c)) for c in codes))).alias("code"), F.trim(target).alias(target))
    return long.where(f"code <> '' and {target} <> ''").distinct()


def expand_codes(rows: DataFrame, code: str, known: DataFrame) -> DataFrame:
    """Each row once for its code and for every truncation of it that is a known code.

    Distinct codes are expanded, not rows; the small result is joined back.
    """
    distinct = rows.select(code).distinct()
    up = distinct.select(code, F.explode(ancestors(F.col(code))).alias("expanded"))
    good = up.join(known.select(F.col(known.columns[0]).alias("expanded"), F.lit(True).alias("_k")), "expanded", "left")
    return rows.join(good.where(F.col("_k") | (F.col("expanded") == F.col(code))).drop("_k").distinct(), code)


def sector(code: Column, bounds: list[tuple[float, float, str]], default: str = "Other", overrides: dict[float, str] | None = None) -> Column:
    """Numeric code ranges [low, high) to names (F8); codes that round to an override's two decimals take its name."""
    n = code.try_cast("double")
    out = F.when(F.lit(False), "")
    for at, name in (overrides or {}).items():
        out = out.when(F.round(n, 2) == at, name)
    for low, high, name in bounds:
        out = out.when((n >= low) & (n < high), name)
    return out.otherwise(default)


def numeric_first(code: Column) -> list[Column]:
    """Sort keys: codes by number, those without one last, then by text."""
    return [F.coalesce(code.try_cast("double"), F.lit(1e9)), code]


def window_labels(anchors: DataFrame, events: DataFrame, person: str, key: str, anchor_at: str, event_at: str, code: str, before: str | None = None, after: str = "INTERVAL '0' SECOND") -> DataFrame:
    """Distinct (key, code) of a person's events up to, or in a window around, each anchor.

    With an open past, only the first of a person's events of each code counts.  A window
    is looked up by slices of time as long as itself, so a person's events meet the anchors
    around them and no others.
    """
    ev = events.select(person, F.col(event_at).alias("_e"), code)
    an = anchors.select(key, person, F.col(anchor_at).alias("_a"))
    if before is None:
        both = an.join(ev.groupBy(person, code).agg(F.min("_e").alias("_e")), person)
        return both.where(F.col("_e") <= F.col("_a") + F.expr(after)).select(key, code).distinct()
    origin = "timestamp'2000-01-01 00:00:00'"
    span = anchors.sparkSession.sql(f"SELECT unix_timestamp({origin} + {after}) - unix_timestamp({origin} - {before}) AS s").first().s
    slack = 86400  # a day, for the shifts of local time
    second = lambda t: F.unix_timestamp(t.cast("timestamp"))
    place = lambda s: F.floor(s / F.lit(max(span, 1) + 2 * slack)).cast("long")
    low, high = second(F.col("_a") - F.expr(before)) - slack, second(F.col("_a") + F.expr(after)) + slack
    near = an.withColumn("_slice", F.explode(F.sequence(place(low), place(high))))
    both = near.join(ev.distinct().withColumn("_slice", place(second(F.col("_e")))), [person, "_slice"])
    hit = (F.col("_e") <= F.col("_a") + F.expr(after)) & (F.col("_e") >= F.col("_a") - F.expr(before))
    return both.where(hit).select(key, code).distinct()


def multi_hot(keys: DataFrame, pairs: DataFrame, key: str, code: str, columns: list[str]) -> DataFrame:
    """One 0/1 column for each code, and an all-zero row for keys without any (A4)."""
    wide = pairs.groupBy(key).pivot(code, columns).agg(F.max(F.lit(1)))
    return keys.select(key).distinct().join(wide, key, "left").fillna(0, subset=columns)


def prevalence(pairs: DataFrame, n_keys: int, code: str) -> DataFrame:
    """Share of keys with each code (A3)."""
    return pairs.groupBy(code).agg((F.count("*") / F.lit(n_keys)).alias("prevalence"))

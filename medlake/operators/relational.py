"""Keyed joins with checks, ordered deduplication, splits and samples, in window and join form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.plans.ordinal import with_ordinal


def keep_one(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (W10, W12, S16); the order must be total."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def left_unique(left: DataFrame, right: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Left join that never adds rows: the right side is cut to one row a key first."""
    return left.join(keep_one(right, on, order), on, "left")


def orphans(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(side, n): matched keys, and keys without a partner on either side."""
    a, b = left.select(*on).dropna().distinct(), right.select(*on).dropna().distinct()
    flags = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), on, "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return flags.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def membership(named: dict[str, DataFrame], key: str) -> DataFrame:
    """Each key with the sorted names of the tables that have it."""
    tagged = None
    for name, df in named.items():
        part = df.select(F.col(key).alias("key"), F.lit(name).alias("name")).where("key is not null")
        tagged = part if tagged is None else tagged.union(part)
    return tagged.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("name")), "+").alias("members"))


def union_tagged(named: dict[str, DataFrame], tag: str) -> DataFrame:
    """Vertical concatenation with a literal name for each source."""
    out = None
    for name, df in named.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def completeness(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(n_missing, n_duplicate): what a one-to-one, complete join must find zero of."""
    missing = left.select(*on).join(right.select(*on), on, "left_anti").agg(F.count("*").alias("n_missing"))
    twice = right.groupBy(*on).count().where("count > 1").agg(F.count("*").alias("n_duplicate"))
    return missing.crossJoin(twice)  # one row each


def drift_gate(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Matched rows whose two values agree within a relative tolerance, counted by outcome."""
    both = left.join(right, on, "left")
    off = F.abs(F.col(a) - F.col(b)) > tolerance * F.greatest(F.abs(F.col(a)), F.lit(1e-12))
    outcome = F.when(F.col(b).isNull(), "missing").when(off, "drift").otherwise("ok")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def greedy_budget(groups: DataFrame, size: str, key: str, target: int, over: int, under: int) -> DataFrame:
    """Groups in ascending size, accepted while the running total stays within ``target + over``,
    or starts below ``target - under`` (W8).

    Totals only rise, so what is accepted is a prefix and one running sum over ranges
    decides it, however many groups share a size.
    """
    run = with_ordinal(groups, [F.col(size), F.col(key)], "_before", F.col(size)).withColumn("running", F.col("_before") + F.col(size))
    accepted = (F.col("running") <= target + over) | (F.col("running") - F.col(size) < target - under)
    return run.withColumn("accepted", accepted).drop("_before")


def hash_order(key: str | Column, seed: str) -> Column:
    """A reproducible shuffle: the SHA-1 of seed and key."""
    return F.sha1(F.concat(F.lit(seed), (F.col(key) if isinstance(key, str) else key).cast("string")))


def share_split(keys: DataFrame, key: str, cuts: dict[str, float], seed: str, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """Keys dealt to named parts by hash order and half-even rounded cut points.

    With ``by``, each class is cut on its own and the first part gets ``least`` keys at
    least.  Places come from ranges and a prefix sum, so no class has to fit a task.
    """
    by = by or []
    numbered = with_ordinal(keys, [*(F.col(c) for c in by), hash_order(key, seed), F.col(key)], "_r")
    sizes = numbered.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_n"), F.min("_r").alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    ranked = numbered.join(sizes, same) if by else numbered.crossJoin(F.broadcast(sizes))  # one row without classes
    place = F.col("_r") - F.col("_first") + 1
    names, total, split = list(cuts), 0.0, None
    for i, name in enumerate(names):
        total += cuts[name]
        edge = F.bround(F.col("_n") * total, 0)
        edge = F.greatest(edge, F.lit(float(least))) if i == 0 else edge
        split = F.when(place <= edge, name) if split is None else split.when(place <= edge, name)
    return ranked.select(*keys.columns, split.otherwise(names[-1]).alias("part"))


def split_leaks(rows: DataFrame, group: str, part: str) -> DataFrame:
    """Groups found in more than one part (U5); a sound split has none."""
    return rows.groupBy(group).agg(F.count_distinct(part).alias("n_parts")).where("n_parts > 1")


def sample_each(rows: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group without replacement, in hash order."""
    return keep_top(rows, by, [hash_order(key, seed), F.col(key)], n)


def keep_top(rows: DataFrame, by: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group, with their rank where a name for it is given."""
    out = rows.withColumn(rank or "_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank or "_r") <= n)
    return out if rank else out.drop("_r")


def evenly_spaced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``n`` rows at even positions of an ordered table."""
    count = rows.count()
    wanted = sorted({int(i * (count - 1) / max(n - 1, 1)) for i in range(n)}) if count else []
    return with_ordinal(rows, order, "_r").where(F.col("_r").isin(wanted)).drop("_r")


def runs(rows: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Contiguous runs of one state: first and last position and length."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_new", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first(state).alias(state), F.count("*").alias("length"))


def profile(rows: DataFrame, checks: dict[str, Column], required: list[str] = ()) -> DataFrame:
    """One row of counts, one for each named condition, in one pass (P8, P14); a required column that lacks is an error."""
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ValueError(f"columns {lacking} are not among {rows.columns}")
    return rows.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(n) for n, c in checks.items()))


def require(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows``, or an error that names the violated conditions and their counts."""
    found = profile(rows, checks).first().asDict()
    bad = {n: found[n] for n in checks if found[n]}
    if bad:
        raise ValueError(f"of {found['n_rows']} rows: {bad}")
    return rows


def in_range(ordinal: Column, n: int) -> Column:
    """Marks positions outside [0, n)."""
    return ordinal.isNull() | (ordinal < 0) | (ordinal >= n)


def gathered(wanted: DataFrame, have: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Wanted rows that are there, with the other side's columns, and one row with the number missing."""
    return wanted.join(have, on), wanted.join(have.select(*on), on, "left_anti").agg(F.count("*").alias("n_missing"))


def paired(named: dict[str, tuple[DataFrame, DataFrame]], key: str, text: str) -> DataFrame:
    """Array and text tables of several sources under one ordinal, in the given order of sources.

    Each pair must have the same number of rows; a blank text becomes one space.
    """
    parts = []
    for i, (name, (arrays, texts)) in enumerate(named.items()):
        a, t = arrays.count(), texts.count()
        if a != t:
            raise ValueError(f"{name}: {a} arrays but {t} texts")
        parts.append(arrays.join(texts, key).withColumn("source", F.lit(name)).withColumn("_s", F.lit(i)))
    both = reduce(DataFrame.unionByName, parts)
    return with_ordinal(both.withColumn(text, F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(" "))), [F.col("_s"), F.col(key)], "ordinal").drop("_s")


def sign_ledger(ledger: DataFrame, names: DataFrame, key: str, before: str, after: str, delta: str) -> DataFrame:
    """The listed rows of a ledger, and whether a delta has the sign of its two values' difference."""
    found = names.join(ledger, key, "left")
    return found.withColumn("consistent", F.coalesce(F.signum(F.round(F.col(after) - F.col(before), 9)) == F.signum(F.round(delta, 9)), F.lit(False)))


def two_level_stats(rows: DataFrame, by: list[str], pair: list[str], value: str) -> DataFrame:
    """Quartiles and deviation of a value in each group, and the mean of its pairs' means."""
    q = lambda p: F.percentile(value, F.lit(p))
    flat = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"))
    pairs = rows.groupBy(*by, *pair).agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.count("*").alias("n_pairs"), F.avg("_m").alias("pair_mean"))
    return flat.join(pairs, by)


def sorted_means(named: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """(source, column, mean, rank): means of each source's columns, best first, under its name."""
    parts = [df.agg(*(F.avg(c).alias(c) for c in columns)).select(F.lit(name).alias("source"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("mean")) for c in columns))).alias("x")).select("source", "x.*") for name, df in named.items()]
    w = Window.partitionBy("source").orderBy(F.col("mean").desc_nulls_last(), "column")  # one row for each column
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w).cast("bigint"))


def shared_top(rows: DataFrame, label: str, item: str, order: list[Column]) -> DataFrame:
    """(label, item, n_labels): each label's first item and how many labels have the same one.

    Labels are counted for each item, never paired with one another.
    """
    first = keep_one(rows, [label], order).select(label, item)
    return first.join(first.groupBy(item).agg(F.count("*").alias("n_labels")), item).select(label, item, "n_labels")

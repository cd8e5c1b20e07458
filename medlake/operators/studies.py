"""Study designs: complete cases, permutation nulls, pair samples, layouts, linkage, affine repair, projection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.operators.relational import keep_top
from medlake.plans.ordinal import with_ordinal

#: Plausible voxel spacings in mm, and what counts as zero.
SPACING_LOW, SPACING_HIGH, SINGULAR, TINY = 0.05, 10.0, 1e-8, 1e-6


def complete_cases(rows: DataFrame, labels: list[str], least: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows without a gap in any covered label column, and those columns.

    A column is covered if it has ``least`` values at least; the others go.
    """
    counts = rows.agg(*(F.count(c).alias(c) for c in labels)).first()
    kept = [c for c in labels if counts[c] >= least]
    return rows.drop(*(c for c in labels if c not in kept)).dropna("any", subset=kept or None), kept


def hash_number(*parts: Column | str) -> Column:
    """A reproducible number below 2**32 from the MD5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))), 1, 8), 16, 10).cast("long")


def centroid_null(distances: DataFrame, group: Column, replicates: int, seed: str = "null") -> DataFrame:
    """One row of centroid matching and its permutation null.

    ``distances`` has (a, b, d) for each pair of a new and a reference centroid of a small
    label set, ``group`` is an expression of ``b``.  Observed: share of labels whose own
    reference is nearest, among the nearest three, and nearest within its group.  Null: the
    share under shuffled reference labels, with the share of shuffles (and the observed
    one) that do as well.
    """
    near = Window.partitionBy("a").orderBy(F.round("d", 9), "b")
    d = distances.withColumn("_g", group).withColumn("_r", F.row_number().over(near))
    mine = d.where("a = b").select("a", F.col("_g").alias("_own"))  # a label's own group
    inside = d.join(mine, "a").where(F.col("_g") == F.col("_own")).withColumn("_k", F.row_number().over(near))
    obs = d.where("a = b").agg(F.count("*").alias("n"), F.avg((F.col("_r") == 1).cast("double")).alias("top1"), F.avg((F.col("_r") <= 3).cast("double")).alias("top3"))
    group_hit = inside.where("a = b").agg(F.avg((F.col("_k") == 1).cast("double")).alias("top1_in_group"))
    nearest = d.where("_r = 1").select("a", F.col("b").alias("_nearest"))
    labels = d.select(F.col("b").alias("_label")).distinct()
    place = labels.withColumn("_at", F.row_number().over(Window.orderBy("_label")))  # one row for each label
    turns = labels.crossJoin(distances.sparkSession.range(replicates).select(F.col("id").alias("_p")))
    turns = turns.withColumn("_at", F.row_number().over(Window.partitionBy("_p").orderBy(hash_number(seed, F.col("_p"), F.col("_label")), "_label")))
    turned = turns.withColumnRenamed("_label", "_turned").join(place, "_at")
    hit = turned.join(nearest, F.col("_label") == F.col("_nearest")).groupBy("_p").agg(F.sum((F.col("_turned") == F.col("a")).cast("long")).alias("_hits"))
    one = obs.crossJoin(group_hit)  # one row each
    null = hit.crossJoin(one.select("n", "top1")).agg(F.avg(F.col("_hits") / F.col("n")).alias("null_mean"), ((1 + F.count_if(F.col("_hits") / F.col("n") >= F.col("top1") - 1e-12)) / F.lit(replicates + 1)).alias("p_value"))
    return one.crossJoin(null)


def random_pairs(items: DataFrame, key: str, label: str, attempts: int, seed: str) -> DataFrame:
    """(attempt, left, right) keys of two different rows for each attempt; pairs of equal labels are skipped."""
    numbered = with_ordinal(items.select(key, label), [F.col(key)], "_k")
    n = F.lit(max(items.count(), 2))
    draw = items.sparkSession.range(attempts).select(F.col("id").alias("attempt"), (hash_number(seed, F.col("id"), "left") % n).alias("_l"), (hash_number(seed, F.col("id"), "right") % (n - 1)).alias("_s"))
    draw = draw.withColumn("_r", (F.col("_l") + 1 + F.col("_s")) % n)
    both = draw.join(numbered.toDF("left", "_la", "_l"), "_l").join(numbered.toDF("right", "_lb", "_r"), "_r")
    return both.where("_la <> _lb").select("attempt", "left", "right")


def balanced_pairs(pairs: DataFrame, stratum: str, group: list[str], per_group: int, per_stratum: int, seed: str) -> DataFrame:
    """Pairs capped for each (stratum, group), then for each stratum, in hash order (U12); caps are the sample's design."""
    order = [hash_number(seed, *(F.col(c) for c in pairs.columns)), *(F.col(c) for c in pairs.columns)]
    return keep_top(keep_top(pairs, [stratum, *group], order, per_group), [stratum], order, per_stratum)


def _listed(rows: DataFrame, name: str, size: str, order: list[str]) -> DataFrame:
    """One row with the few items of a layout as an array ``s`` of (name, size), in order."""
    item = F.struct(*order, F.col(name).alias("_name"), F.col(size).cast("double").alias("_size"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["_name"].alias("name"), x["_size"].alias("size"))).alias("s"))


def first_fit(rows: DataFrame, name: str, size: str, order: list[str], bins: int) -> DataFrame:
    """(name, bin) of a few items: each goes to the first bin with room, else to the least loaded.

    Room is the total over the bins, rounded up, or the largest item if that is more.
    """
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x["size"])
    one = _listed(rows, name, size, order).withColumn("cap", F.greatest(F.ceil(total(F.col("s")) / bins).cast("double"), F.array_max(F.transform("s", lambda x: x["size"]))))

    def put(acc: Column, x: Column) -> Column:
        fits = F.array_position(F.transform(acc["loads"], lambda v: v + x["size"] <= F.col("cap")), True)
        at = F.when(fits > 0, fits).otherwise(F.array_position(acc["loads"], F.array_min(acc["loads"]))).cast("int") - 1
        loads = F.transform(acc["loads"], lambda v, i: F.when(i == at, v + x["size"]).otherwise(v))
        return F.struct(loads.alias("loads"), F.concat(acc["bins"], F.array(at)).alias("bins"))

    start = F.struct(F.array_repeat(F.lit(0.0), bins).alias("loads"), F.array().cast("array<int>").alias("bins"))
    done = one.select("s", F.aggregate("s", start, put)["bins"].alias("b"))
    return done.select(F.explode(F.arrays_zip("s", "b")).alias("z")).select(F.col("z.s.name").alias(name), F.col("z.b").alias("bin"))


def contiguous_parts(rows: DataFrame, name: str, size: str, order: list[str], parts: int) -> DataFrame:
    """(name, part) of a few ordered items cut into contiguous parts.

    Of all cuts, those with the smallest worst deviation from equal sums are taken, then
    the smallest squared deviation, then the earliest.
    """
    one = _listed(rows, name, size, order).withColumn("run", F.transform(F.sequence(F.lit(0), F.size("s")), lambda n: F.aggregate(F.slice("s", F.lit(1), n), F.lit(0.0), lambda a, x: a + x["size"])))
    cuts = one.select("s", "run", F.array().cast("array<int>").alias("cuts"))
    for i in range(1, parts):
        last = F.coalesce(F.get("cuts", F.lit(i - 2)), F.lit(0)) if i > 1 else F.lit(0)
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda q: (q > last) & (q < F.size("s")))
        cuts = cuts.withColumn("_c", F.explode(places)).withColumn("cuts", F.concat("cuts", F.array("_c"))).drop("_c")
    bounds = F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("s")))
    target = F.element_at("run", -1) / parts
    off = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.get("run", F.get(bounds, i)) - F.get("run", F.get(bounds, i - 1)) - target)
    scored = cuts.withColumn("_off", off).withColumn("_worst", F.round(F.array_max(F.transform("_off", F.abs)), 9)).withColumn("_square", F.round(F.aggregate("_off", F.lit(0.0), lambda a, x: a + x * x), 9))
    best = scored.agg(F.min(F.struct("_worst", "_square", "cuts", "s")).alias("m")).select("m.cuts", "m.s").where("s is not null")
    return best.select(F.posexplode("s").alias("_i", "x"), "cuts").select(F.col("x.name").alias(name), F.size(F.filter("cuts", lambda c: c <= F.col("_i"))).alias("part"))


def complete_linkage(pairs: DataFrame, labels: int = 2000) -> DataFrame:
    """(step, a, b, height, size): merges of a complete-linkage tree over a small set of labels.

    ``pairs`` has (a, b, distance) with a < b for all pairs.  A cluster is named by its
    smallest label; ties go to the smaller names.  Refuses more than ``labels`` labels, as
    the tree is built on the driver.
    """
    n = pairs.select("a").union(pairs.select("b")).distinct().count()
    if n > labels:
        raise ValueError(f"complete linkage of {n} labels; {labels} at most")
    got = pairs.select("a", "b", "distance").collect()
    names = sorted({r.a for r in got} | {r.b for r in got})
    at = {x: i for i, x in enumerate(names)}
    d = np.full((len(names), len(names)), np.inf)
    for r in got:
        d[at[r.a], at[r.b]] = r.distance
    size, steps = np.ones(len(names), int), []
    for step in range(len(names) - 1):
        i, j = np.unravel_index(d.argmin(), d.shape)  # i < j; the first of equals
        size[i] += size[j]
        steps.append((step, names[i], names[j], float(d[i, j]), int(size[i])))
        both = np.maximum(np.fmin(d[i], d[:, i]), np.fmin(d[j], d[:, j]))  # each pair stands on one side only
        both[[i, j]] = np.inf
        d[[i, j]], d[:, [i, j]] = np.inf, np.inf
        live = np.isfinite(both)
        k = np.arange(len(names))
        d[i, live & (k > i)], d[live & (k < i), i] = both[live & (k > i)], both[live & (k < i)]
    kind = dict(pairs.dtypes)["a"]
    return pairs.sparkSession.createDataFrame(steps, f"step int, a {kind}, b {kind}, height double, size int")


def repair_affine(a: Column) -> Column:
    """A usable 4x4 affine, row by row in 16 doubles.

    A singular or non-finite one is rebuilt along the axes from its column lengths, signs
    of its largest entries and shift; a column whose length is no plausible spacing is
    scaled to the nearest one.
    """
    cell = lambda r, c: F.get(a, F.lit(4 * r + c))
    norm = [F.sqrt(sum((cell(r, c) * cell(r, c) for r in range(3)), F.lit(0.0))) for c in range(3)]
    det = cell(0, 0) * (cell(1, 1) * cell(2, 2) - cell(1, 2) * cell(2, 1)) - cell(0, 1) * (cell(1, 0) * cell(2, 2) - cell(1, 2) * cell(2, 0)) + cell(0, 2) * (cell(1, 0) * cell(2, 1) - cell(1, 1) * cell(2, 0))
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    clip = lambda x: F.least(F.greatest(x, F.lit(SPACING_LOW)), F.lit(SPACING_HIGH))
    broken = ~F.forall(a, finite) | (F.abs(det) <= SINGULAR)
    fresh, scaled = [], []
    for r in range(4):
        for c in range(4):
            if r == 3:
                fresh.append(F.lit(float(c == 3)))
            elif c == 3:
                fresh.append(F.when(finite(cell(r, 3)), cell(r, 3)).otherwise(0.0))
            elif r != c:
                fresh.append(F.lit(0.0))
            else:
                some = finite(norm[c]) & (norm[c] > TINY)
                big = [F.abs(cell(i, c)) for i in range(3)]
                lead = F.when((big[0] >= big[1]) & (big[0] >= big[2]), cell(0, c)).when(big[1] >= big[2], cell(1, c)).otherwise(cell(2, c))
                fresh.append(F.when(some, clip(norm[c]) * F.when(lead < 0, -1.0).otherwise(1.0)).otherwise(1.0))
            odd = (norm[c] < SPACING_LOW) | (norm[c] > SPACING_HIGH) if c < 3 and r < 3 else F.lit(False)
            scaled.append(F.when(odd, cell(r, c) * clip(norm[c]) / norm[c]).otherwise(cell(r, c)) if c < 3 and r < 3 else cell(r, c))
    return F.when(F.size(a) == 16, F.when(broken, F.array(*fresh)).otherwise(F.array(*scaled)))


def barycentre(neighbours: DataFrame, places: DataFrame, by: str = "query_id", bank: str = "bank_id", rounds: int = 32) -> DataFrame:
    """(query, x, y): new points as weighted means of their neighbours' places in a fixed layout.

    ``neighbours`` has (query, bank, distance).  Weights are exp(-(d - nearest) / s), with s
    found by bisection so that they add up to log2 of the number of neighbours.
    """
    near = neighbours.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("distance", bank))).alias("n"))  # k rows each
    gap = F.transform("n", lambda x: x["distance"] - F.get("n", F.lit(0))["distance"])
    goal = F.log2(F.size("gap").cast("double"))
    mass = lambda g, s: F.aggregate(g, F.lit(0.0), lambda acc, x: acc + F.exp(-x / s))

    def narrow(acc: Column, _: Column) -> Column:
        mid = (acc["low"] + acc["high"]) / 2
        more = mass(F.col("gap"), mid) > goal
        return F.struct(F.when(more, acc["low"]).otherwise(mid).alias("low"), F.when(more, mid).otherwise(acc["high"]).alias("high"))

    span = F.struct(F.lit(1e-9).alias("low"), (F.lit(1000.0) * F.greatest(F.element_at("gap", -1), F.lit(1e-6))).alias("high"))
    scaled = near.withColumn("gap", gap).withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), span, narrow)["high"])
    each = scaled.select(by, "s", F.explode(F.arrays_zip("n", "gap")).alias("z")).select(by, F.col(f"z.n.{bank}").alias(bank), F.exp(-F.col("z.gap") / F.col("s")).alias("w"))
    w = F.sum("w")
    return each.join(places, bank).groupBy(by).agg((F.sum(F.col("w") * F.col("x")) / w).alias("x"), (F.sum(F.col("w") * F.col("y")) / w).alias("y"))

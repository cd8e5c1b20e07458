"""Order MinHash fingerprints in Spark SQL expressions alone.

A text is cut into pieces: words, and what content-defined cuts make of longer runs
without white space.  Its k-mers are runs of k pieces, and each occurrence of a k-mer is
told apart by its number in the text.  Under each of ``m`` orders, the ``l`` smallest of
all numbered k-mers are taken, put back into text order and hashed to one signature
value, so a value agrees only where the same k-mers stand in the same order; this makes
the share of equal values a measure of edit distance rather than of content alone
(Marcais et al., 2019).

The orders are rotations of one random order of the hashes: order j ranks a hash by how
far it lies behind the j-th of ``m`` evenly spaced points on the ring of 64-bit values.
Under each of them every numbered k-mer is equally likely to be smallest, and one sort
serves them all: work is that of sorting a text's k-mers, whatever ``m`` is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.plans.shared import materialize

_SPACE = r"\x20\x09-\x0D"
#: Characters that end a piece in runs of over twelve: a change then moves only the pieces around it.
_CUT = r"aeiouAEIOU0-9.,;:/_=&?(){}<>\"'+\-\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}"
PIECES = rf"(?<![^{_SPACE}])[^{_SPACE}]{{1,12}}+(?![^{_SPACE}])|[^{_SPACE}{_CUT}]{{0,15}}+[{_CUT}]|[^{_SPACE}{_CUT}]{{1,16}}+"
K, L, M = 2, 2, 32
COARSE = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ring_points(m: int) -> list[int]:
    """Where the ``m`` orders start, ascending."""
    return [-(2**63) + (2 * j + 1) * 2**63 // m for j in range(m)]


def _numbered(kmers: Column) -> Column:
    """Structs (o, i) of hash and place of each numbered occurrence, from sorted structs (h, i)."""

    def from_starts(starts: Column) -> Column:
        numbers = F.flatten(F.transform(starts, lambda s, r: F.sequence(F.lit(0).cast("long"), F.coalesce(F.get(starts, r + 1), F.size(kmers)) - s - 1)))
        return F.zip_with(kmers, numbers, lambda x, c: F.struct(F.xxhash64(x["h"], c).alias("o"), x["i"].alias("i")))

    places = F.sequence(F.lit(0), F.size(kmers) - 1)
    return let(F.filter(places, lambda q: (q == 0) | (F.get(kmers, q)["h"] != F.get(kmers, q - 1)["h"])), from_starts)


def fingerprint(text: Column, k: int = K, l: int = L, m: int = M) -> Column:  # noqa: E741
    """Array of ``m`` longs; equal for texts with equal pieces, and defined for the empty text."""
    points = F.array(*(F.struct(F.lit(c).cast("long").alias("o"), F.lit(-1).alias("i")) for c in ring_points(m)))

    def signature(items: Column, rank: Column) -> Column:
        """Of the ``l`` numbered k-mers from place ``rank`` on, around the ring."""
        chosen = (F.get(items, (rank + t) % F.size(items)) for t in range(l))
        placed = F.sort_array(F.array(*(let(x, lambda v: F.struct(v["i"].alias("i"), v["o"].alias("o"))) for x in chosen)))
        return F.xxhash64(F.transform(placed, lambda v: v["o"]))

    def from_ring(ring: Column) -> Column:
        items = F.filter(ring, lambda x: x["i"] >= 0)
        at = F.filter(F.sequence(F.lit(0), F.size(ring) - 1), lambda q: F.get(ring, q)["i"] < 0)
        return let(items, lambda it: F.transform(at, lambda q, j: signature(it, q - j)))

    def from_pieces(p: Column) -> Column:
        kmers = F.transform(p, lambda t, i: F.struct(F.xxhash64(t, *(F.get(p, i + n) for n in range(1, k))).alias("h"), i.alias("i")))
        found = let(F.sort_array(kmers), lambda s: let(F.sort_array(F.concat(_numbered(s), points)), from_ring))
        return F.when(F.size(p) > 0, found).otherwise(F.transform(F.sequence(F.lit(1), F.lit(m)), lambda j: F.xxhash64(j)))

    return let(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), from_pieces)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signature values."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def as_text(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def id_range(id_: Column, cuts: list[int]) -> Column:
    """Number of ``cuts`` at or below the id, by a coarse and a fine search; null ids come last."""
    if not cuts:
        return F.when(id_.isNull(), 1).otherwise(0)
    fine = F.array(*map(F.lit, cuts))
    coarse = F.array(*map(F.lit, cuts[::COARSE]))
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= id_)) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(fine, block * COARSE + 1, F.lit(COARSE)), lambda c: c <= id_))
    return F.when(id_.isNull(), len(cuts) + 1).otherwise(block * COARSE + inside)


def id_range(id_: Column, text: Column, cuts: list[int], ranges: int) -> Column:
    """Number of ``cuts`` at or below the id, by a coarse and a fine search; null ids follow, by their texts' hashes."""
    place = F.floor((F.xxhash64(text) / F.lit(2.0**64) + 0.5) * F.lit(ranges)).cast("int")
    unknown = F.lit(len(cuts) + 1) + F.least(place, F.lit(ranges - 1))
    if not cuts:
        return F.when(id_.isNull(), unknown).otherwise(0)
    fine = F.array(*map(F.lit, cuts))
    coarse = F.array(*map(F.lit, cuts[::COARSE]))
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= id_)) - 1, F.lit(0))
    inside = F.size(F.filter(F.slice(fine, block * COARSE + 1, F.lit(COARSE)), lambda c: c <= id_))
    return F.when(id_.isNull(), unknown).otherwise(block * COARSE + inside)


def with_next(docs: DataFrame, ranges: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """(id, text, range, guest) and the window along a range, in which each text is followed by the next one.

    Order is by id, then text; null ids come last, by a hash of their texts.  One exchange
    moves the texts, by range; the first text of each range also goes to the range before
    it (of the first one, to the last), as a guest behind its last row.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("id", shares, 100 * ranges)).first()[0] if shares else None
    rows = rows.withColumn("range", id_range(F.col("id"), F.col("text"), sorted(set(cuts or [])), ranges))
    place = F.when(F.col("id").isNull(), F.xxhash64("text"))
    firsts = rows.groupBy("range").agg(F.min_by(F.struct("id", "text"), F.struct(F.coalesce("id", place), "text")).alias("first"))
    firsts = materialize(firsts, "firsts")  # one row for each range
    along = Window.orderBy("range")  # over their numbers alone
    before = firsts.select("range", F.coalesce(F.lag("range").over(along), F.last("range").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    guests = firsts.join(before, "range").select("first.id", "first.text", F.col("before").alias("range"), F.lit(True).alias("guest"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return every, Window.partitionBy("range").orderBy("guest", F.coalesce("id", place), "text")


def compare_edits(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter of its characters (rounded down) replaced by as
    many of the next text's first ones, or all of them.  Null texts are empty; rows that
    share an id are ordered by their texts, and null ids come last, in an order that
    their texts alone decide.
    """
    if ranges is None:
        ranges = min(16384, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, order = with_next(docs, ranges, id_col, text_col)
    rows = rows.withColumn("next", F.lead("text").over(order))
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    rows = rows.select("*", n.alias("n_chars"), F.concat(F.substring("text", F.lit(1), n.cast("int") - cut), F.substring("next", F.lit(1), cut)).alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("fe"))
    rows = rows.withColumn("fn", F.lead("fp").over(order)).where("not guest")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fe")).alias("near_edited"), likeness(F.col("fp"), F.col("fn")).alias("near_next"),
    )

"""Near-duplicate texts: SetSketch registers, banded, estimated jointly, then verified.

1. Every text becomes the set of its k-word shingles (lower-cased A-Z), of which the
   size, a 128-bit set fingerprint and 160 SetSketch registers are kept.
2. Texts with equal sets form a class; only its smallest id goes on, so a group of exact
   copies costs one row however large it is.
3. 32 bands of 5 register values are candidate keys.  Every class is paired with the
   smallest class under each of its keys, its hubs (stars, linear in the rows of a key).
4. Pairs whose likelihood estimate from the registers is over four standard errors below
   the threshold go; the others are verified on their full sets.
5. Classes that share a key share a hub.  In each hub's group, rows outside its largest
   component of verified links are compared with those of other components on their
   registers, in blocks of bounded size; rows that have a likely partner again on full sets, by
   an inverted index for each pair of blocks.  What leaves a block is at most one row for
   each member, then one link for a row and component: no group is expanded into pairs.

Two sets of similarity 0.8 share no key with probability (1 - 0.8^5)^32 = 3e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm import setsketch as ss
from medlake.llm.components import connected_components
from medlake.llm.skew import join_classes
from medlake.llm.words import U, digests, split_words, string_bytes, text_slices, tidy, window_hash, window_starts
from medlake.plans.shared import materialize, scratch

BLOCK_ROWS, BLOCK_BYTES, BITMAP_BITS, HUB_ROWS = 512, 8 << 20, 1 << 24, 1024


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their bounds.

    A text of fewer than ``k`` words has its whole word sequence as its one shingle; one
    without words has none.
    """
    w = split_words(data, at, lower=True)
    n = w.count()
    pos, text = window_starts(w.first, k)
    h = window_hash(w.hash, pos, k)
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            h = np.concatenate([h, window_hash(w.hash, w.first[few], size)])
            text = np.concatenate([text, few])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    at = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, h1, h2, regs) for every row; a null text is an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_bytes(batch.column(1))
            for i, j, part, bounds in text_slices(data, at):
                h, first = shingle_sets(part, bounds, k)
                h1, h2 = digests(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(np.diff(first)), pa.array(h1), pa.array(h2), _binary(ss.registers(h, first))],
                    names=["id", "n_shingles", "h1", "h2", "regs"],
                )

    schema = "id long, n_shingles long, h1 long, h2 long, regs binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(work), schema)


def _band_keys(regs: Column) -> Column:
    width = 2 * ss.ROWS
    return F.array(*(F.xxhash64(F.lit(b), F.substring(regs, 1 + b * width, width)) for b in range(ss.BANDS)))


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, ss.M)


def _with_hub(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Pairs (a, b) joined to what ``side`` has for a; a hub of many pairs is copied once for every ``HUB_ROWS`` of them."""
    counts = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("s", F.ceil(F.col("n") / HUB_ROWS)), "hubs")
    salted = join_classes(pairs, counts, ["a"]).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("s"))).drop("s")
    copies = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("salt")).join(side, "a")
    return salted.join(copies, ["a", "salt"]).drop("salt")


def _likely(pairs: DataFrame, reps: DataFrame, cut: float) -> DataFrame:
    """Pairs (a, b) whose joint estimate reaches ``cut``."""
    half = reps.select("id", "n_shingles", "regs")
    full = _with_hub(pairs, half.toDF("a", "na", "ra")).join(half.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
                keep = ss.joint_jaccard(_registers(batch.column(4)), _registers(batch.column(5)), na.astype(float), nb.astype(float)) >= cut
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return full.mapInArrow(tidy(work), "a long, b long")


def _shingle_tables(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, shingles) of the wanted texts.

    A bitmap of the wanted ids' hashes, of fixed size, spares most other texts the
    exchange; it may let some through, which the join drops.  Texts travel compressed, and
    sets are made after the join.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS))
    packed_bits = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits"))
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in packed_bits.collect():  # BITMAP_BITS / 8 bytes at most
        bits[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            at = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            data, at = string_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(data[s:e].tobytes()) for s, e in zip(at[:-1], at[1:])], pa.binary())], names=["id", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                raw = np.frombuffer(z.decompress(batch.column(1)[row].as_py()), np.uint8)
                h, _ = shingle_sets(raw, np.array([0, len(raw)]), k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + 1], pa.array([h.tobytes()], pa.binary())], names=["id", "shingles"])

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("slot", slot).mapInArrow(tidy(squeeze), "id long, text binary")
    return packed.join(ids, "id", "left_semi").mapInArrow(tidy(sets), "id long, shingles binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _verify(pairs: DataFrame, tables: DataFrame, percent: int) -> DataFrame:
    full = _with_hub(pairs, tables.toDF("a", "sa")).join(tables.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            m = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["a", "b"])

    return full.mapInArrow(tidy(work), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first ``keys`` columns; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy() for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1), len(ids)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if held and tuple(ids[s]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(ids[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _blocks(rows: DataFrame, weight: str, limit: int, least: int) -> DataFrame:
    """(hub, bi, bj, block, id, component): rows of each hub's group of ``least`` rows or more, dealt to pairs of blocks of about ``limit`` weight.

    Rows of a group's most frequent component are linked already: their blocks meet the
    blocks of the others, which also meet one another.  Groups of one component are settled
    and go.  What a block compares is joined by id afterwards, so that no exchange is dealt
    by hub.
    """
    rows = materialize(rows.select("hub", "id", "component", weight), "rows")
    each = rows.groupBy("hub", "component").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    total = each.groupBy("hub").agg(F.max(F.struct("n", "component", "w")).alias("m"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    blocks = lambda w: F.ceil(w / limit)
    total = total.where((F.col("n") >= least) & (F.col("parts") > 1)).select("hub", "n", F.col("m.component").alias("main"), blocks(F.col("m.w")).alias("b"), blocks(F.col("w") - F.col("m.w")).alias("c"))
    dealt = join_classes(rows, materialize(total, "hubs"), ["hub"])
    main, hash_ = F.col("component") == F.col("main"), F.xxhash64("id", "hub")
    dealt = dealt.withColumn("block", F.when(main, F.pmod(hash_, F.col("b"))).otherwise(F.col("b") + F.pmod(hash_, F.col("c"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(main, F.col("b")).otherwise(F.lit(0).cast("long")), F.col("b") + F.col("c") - 1)))
    return dealt.select("hub", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "id", "component")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")


def _partners(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each row outside the group's most frequent component, the rows to compare it with."""
    bi, bj, block, ids, comp = (t.column(c).to_numpy() for c in ("bi", "bj", "block", "id", "component"))
    _, back, size = np.unique(comp, return_inverse=True, return_counts=True)
    main = back == size.argmax()
    for i in np.flatnonzero(~main):
        o = np.flatnonzero((comp != comp[i]) & (main | (ids > ids[i])) & ((block != block[i]) | (bi[0] == bj[0])))
        if len(o):
            yield i, o


def _open_rows(groups: DataFrame, reps: DataFrame, comp: DataFrame, cut: float) -> DataFrame:
    """(hub, id) rows that have a likely partner of another component in their hub's group."""
    rows = groups.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id")).withColumn("one", F.lit(1))
    # a hub and one member are compared already
    rows = _dealt(_blocks(rows, "one", BLOCK_ROWS, 3).join(reps.select("id", "n_shingles", "regs"), "id").select("hub", "bi", "bj", "block", "id", "component", "n_shingles", "regs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            ids, n = t.column("id").to_numpy(), t.column("n_shingles").to_numpy().astype(float)
            regs = _registers(t.column("regs").combine_chunks())
            needed = np.zeros(len(ids), bool)
            for i, o in _partners(t):
                o = o[np.minimum(n[o], n[i]) >= cut * np.maximum(n[o], n[i])]
                o = o[(regs[o] == regs[i]).sum(1) >= ss.M * cut * 0.8]
                if needed[i]:
                    o = o[~needed[o]]
                if len(o):
                    o = o[ss.joint_jaccard(np.repeat(regs[i : i + 1], len(o), 0), regs[o], np.full(len(o), n[i]), n[o]) >= cut]
                    needed[o] = True
                    needed[i] |= len(o) > 0
            if needed.any():
                yield pa.RecordBatch.from_arrays([t.column("hub").combine_chunks().filter(pa.array(needed)), pa.array(ids[needed])], names=["hub", "id"])

    return rows.mapInArrow(tidy(work), "hub long, id long").distinct()


def _open_links(rows: DataFrame, tables: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in each hub's group, on full sets; one for a row and component."""
    sizes = tables.select("id", F.greatest(F.octet_length("shingles"), F.lit(BLOCK_BYTES // BLOCK_ROWS)).alias("w"))  # blocks of few rows, too
    full = rows.join(sizes, "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    dealt = _dealt(_blocks(full, "w", BLOCK_BYTES, 2).join(tables, "id").select("hub", "bi", "bj", "block", "id", "component", "shingles"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            ids, comp_ = t.column("id").to_numpy(), t.column("component").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U) for x in t.column("shingles").combine_chunks()]
            n = np.array([len(x) for x in sets])
            values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            order = np.argsort(values, kind="stable")
            known, first = np.unique(values[order], return_index=True)
            owner, first = owner[order], np.append(first, len(values))
            a: list[int] = []
            b: list[int] = []
            for i, o in _partners(t):
                at = np.searchsorted(known, sets[i])
                size = first[at + 1] - first[at]
                hit = owner[np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                both = np.bincount(hit, minlength=len(sets))[o]
                o = o[(both > 0) & (100 * both >= percent * (n[o] + n[i] - both))]
                o = o[np.unique(comp_[o], return_index=True)[1]]
                a += [ids[i]] * len(o)
                b += ids[o].tolist()
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidy(work), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| on their sets of
    ``shingle``-word shingles; ``component_id`` is the smallest id reachable by links and
    ``kept`` marks the row that has it.  Null or wordless texts have the empty set and are
    linked with nothing.  Ids must be unique integers; rows with a null id stay, each with
    null component and kept true.  Further columns of ``docs`` are ignored.
    """
    with scratch() as hand_over:
        cut = percent / 100 - 4 * math.sqrt(percent / 100 * (1 - percent / 100) / ss.M)
        sk = materialize(sketch(docs, shingle, id_col, text_col), "sketch")
        some = sk.where("n_shingles > 0 and id is not null").select("id", "n_shingles", "h1", "h2")
        many = materialize(some.groupBy("n_shingles", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "classes")
        copies = materialize(join_classes(some, many, ["n_shingles", "h1", "h2"]).select("id", "rep"), "copies")
        reps = materialize(sk.where("n_shingles > 0 and id is not null").select("id", "n_shingles", "regs").join(copies.where("id <> rep"), "id", "left_anti"), "reps")

        bands = reps.select("id", F.explode(_band_keys(F.col("regs"))).alias("key"))
        keys = materialize(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "keys")
        star = materialize(join_classes(bands, keys, ["key"]).where("id <> hub").select("hub", "id").distinct(), "star")
        likely = materialize(_likely(star.toDF("a", "b"), reps, cut), "likely")
        tables = materialize(_shingle_tables(docs, _ends(likely), id_col, text_col, shingle), "sets")
        links = materialize(_verify(likely, tables, percent), "links")
        comp = connected_components(links)

        groups = star.union(star.select("hub", F.col("hub").alias("id")).distinct())
        rows = materialize(_open_rows(groups, reps, comp, cut), "open")
        lacking = rows.select("id").distinct().join(tables, "id", "left_anti")
        rest = materialize(_shingle_tables(docs, lacking, id_col, text_col, shingle), "sets")
        more = materialize(_open_links(rows, tables.union(rest), comp, percent), "links")
        if not more.isEmpty():
            comp = connected_components(links.union(more))
        hand_over(sk, copies, comp)

    full = sk.select("id", "n_shingles").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    full = full.join(comp.toDF("rep", "component"), "rep", "left")
    out = full.select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)

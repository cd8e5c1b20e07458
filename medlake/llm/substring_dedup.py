"""Exact repeats of long word sequences, by fixed-block anchors.

A window of ``length`` words is removed if it also starts in a text with a smaller id.

* Reference blocks: every text is cut into non-overlapping blocks of ``length // 2``
  words.  Any shared window holds a whole block of the other text, so probing the blocks
  with every rolling window of the block's size finds each shared window.
* Hits are extended to both sides to all full-length windows that hold one; of these the
  smallest id that has each is settled by two independent 64-bit hashes.  Adjoining
  windows that repeat make up the maximal exact repeats, whose words go.  (Extending each
  hit against each text that has the block would give the same words by pairs of texts,
  of which a common passage has too many.)

Layout.  Texts are written once, in compressed chunks of a few MB.  A chunk sends its
distinct hashes to the partition that owns their leading bits, as one sorted array for
each partition, and gets back one bit for each hash.  Arrays hold a hash once for a
chunk, however often it occurs, so frequent lines and groups of copies weigh no more
than rare ones; 4 bytes a rolling window and about 18 a window that holds a hit is all
that moves.  The probe compares 32 bits beyond the partition's, which may only add hits
to settle.  Exact copies of a whole text are known from its fingerprint and skip the
second exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlake.llm.skew import join_classes
from medlake.llm.words import SEPARATOR, U, Words, digests, split_words, string_bytes, tidy, window_hash, window_starts
from medlake.plans.shared import discard, materialize

CHUNK_BYTES, PART_BYTES = 2 << 20, 16 << 20
NO_ID = 2**63 - 1
Batches = Iterator[pa.RecordBatch]


def _pack(values: np.ndarray) -> bytes:
    """Integers as byte planes: sorted differences and small ids then compress in the shuffle."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=values.dtype.type(0)))


def _unpack_sorted(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(_unpack(raw, kind), dtype=kind)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


WINDOWS = "part int, chunk long, found binary, other binary, own binary"
CHUNK = "chunk long, size long, ids array<long>, words array<long>, s1 array<long>, s2 array<long>, at binary, text binary, rest binary"


def _stored(rows: list[pa.RecordBatch]) -> bytes:
    """Columns that go along, as a compressed Arrow stream."""
    if not rows[0].num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Texts gathered into chunks, with the length and fingerprint of each word sequence."""

    def work(batches: Batches) -> Batches:
        z = zstandard.ZstdCompressor(level=3)
        ids: list = []
        rest: list[pa.RecordBatch] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        made = held = 0

        def emit() -> pa.RecordBatch:
            nonlocal made, held
            data, at = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            w = split_words(data, at)
            sums = [h.tolist() for h in digests(np.stack([w.hash, w.other], 1), w.first)]
            row = ((TaskContext.get().partitionId() << 32) + made, len(data), ids[:], w.count().tolist(), *sums, at.tobytes(), z.compress(data.tobytes()), _stored(rest))
            made, held = made + 1, 0
            ids.clear(), parts.clear(), sizes.clear(), rest.clear()
            return _batch(CHUNK, [row])

        for batch in batches:
            data, at = string_bytes(batch.column(1))
            own = batch.column(0).to_pylist()
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(at, at[i] + chunk_bytes - held, "right")) - 1)
                ids += own[i:j]
                rest.append(batch.slice(i, j - i).select(range(2, batch.num_columns)))
                parts.append(data[at[i] : at[j]])
                sizes.append(np.diff(at[i : j + 1]))
                held += at[j] - at[i]
                i = j
                if held >= chunk_bytes * 0.9:
                    yield emit()
        if ids:
            yield emit()

    return docs.mapInArrow(tidy(work), CHUNK)


class _Chunk:
    """A chunk read back: its words and the hashes of its rolling windows."""

    def __init__(self, ids: list[int], at: bytes, text: bytes, length: int, bits: int):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8)
        self.ids = np.array(ids, np.int64)
        self.words: Words = split_words(data, np.frombuffer(at, np.int64))
        self.length, self.block, self.bits = length, length // 2, bits
        self.pos, self.doc = window_starts(self.words.first, self.block)
        self.roll = window_hash(self.words.hash, self.pos, self.block) >> U(32 - bits)
        self.aligned = (self.pos - self.words.first[self.doc]) % self.block == 0

    def by_part(self, values: np.ndarray, shift: int) -> list[tuple[int, np.ndarray]]:
        cuts = np.searchsorted(values, np.arange(1, 1 << self.bits, dtype=U) << U(shift))
        return [(p, v) for p, v in enumerate(np.split(values, cuts)) if len(v)]

    def probes(self) -> Iterator[tuple[int, int, bytes]]:
        """(part, 0 for blocks and 1 for windows, sorted 32-bit values)."""
        for kind, values in enumerate((np.unique(self.roll[self.aligned]), np.unique(self.roll))):
            for part, v in self.by_part(values, 32):
                yield part, kind, _pack_sorted((v & U(0xFFFFFFFF)).astype(np.uint32))

    def replies(self, values: np.ndarray, shift: int, replies: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(values), bool)
        done = 0
        for part, v in self.by_part(values, shift):
            if part in replies:
                out[done : done + len(v)] = np.unpackbits(np.frombuffer(replies[part], np.uint8), count=len(v))
            done += len(v)
        return out

    def candidates(self, hits: dict[int, bytes], copies: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, texts and both hashes of the full-length windows that hold a hit; whole copies have none."""
        values, back = np.unique(self.roll, return_inverse=True)
        hit = self.replies(values, 32, hits)[back]
        mine, doc = self.roll[self.aligned], self.doc[self.aligned]
        if len(mine):
            known = np.unique(mine)
            k = np.searchsorted(known, mine)
            low, high = np.full(len(known), len(self.ids)), np.full(len(known), -1)
            np.minimum.at(low, k, doc)
            np.maximum.at(high, k, doc)
            at = np.minimum(np.searchsorted(known, self.roll), len(known) - 1)
            hit |= (known[at] == self.roll) & ((low[at] != self.doc) | (high[at] != self.doc))
        hit &= ~np.isin(self.ids, np.array(copies, np.int64))[self.doc]
        sums = np.zeros(len(self.words.hash) + 1, np.int64)
        mark = np.zeros(len(self.words.hash), np.int64)
        mark[self.pos[hit]] = 1
        np.cumsum(mark, out=sums[1:])
        start, doc = window_starts(self.words.first, self.length)
        some = sums[start + self.length - self.block + 1] > sums[start]
        start, doc = start[some], doc[some]
        return start, doc, window_hash(self.words.hash, start, self.length), window_hash(self.words.other, start, self.length, 1)

    def owners(self, doc: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of hashes, the smallest id in this chunk for each, and each window's place among them."""
        first, back = _distinct(h, g)
        own = np.full(len(first), NO_ID, np.int64)
        np.minimum.at(own, back, self.ids[doc])
        return h[first], g[first], own, back


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, in order, and the number of each row's pair."""
    order = np.lexsort((g, h))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return order[fresh], back


def _hits(batches: Batches) -> Batches:
    """For each part, its blocks come first; then each chunk's windows get a bit each."""
    part, blocks, known = None, [], None
    for batch in batches:
        for row in range(batch.num_rows):
            p, kind, chunk = (batch.column(i)[row].as_py() for i in range(3))
            values = _unpack_sorted(batch.column(3)[row].as_py(), np.uint32)
            if p != part:
                part, blocks, known = p, [], None
            if kind == 0:
                blocks.append((chunk, values))
                continue
            if known is None and blocks:
                v, c = np.concatenate([b for _, b in blocks]), np.concatenate([np.full(len(b), c) for c, b in blocks])
                order = np.lexsort((c, v))
                v, c = v[order], c[order]
                known, first = np.unique(v, return_index=True)
                low, high = c[first], c[np.append(first[1:], len(v)) - 1]
                blocks = []
            if known is not None:
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                hit = (known[at] == values) & ((low[at] != chunk) | (high[at] != chunk))
                if hit.any():
                    yield _batch("chunk long, part int, bits binary", [(chunk, p, np.packbits(hit).tobytes())])


def _firsts(batches: Batches) -> Batches:
    """For each part and chunk, a bit for each window that another chunk has in a smaller id."""
    held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    part = None

    def settle() -> Batches:
        own = np.concatenate([h[3] for h in held])
        first, back = _distinct(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
        least = np.full(len(first), NO_ID, np.int64)
        np.minimum.at(least, back, own)
        later, at = least[back] < own, 0
        for chunk, values, *_ in held:
            bits = later[at : at + len(values)]
            at += len(values)
            if bits.any():
                yield _batch("chunk long, part int, bits binary", [(chunk, part, np.packbits(bits).tobytes())])

    for batch in batches:
        for row in range(batch.num_rows):
            p, chunk = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
            if p != part and held:
                yield from settle()
                held = []
            part = p
            held.append((chunk, _unpack_sorted(batch.column(2)[row].as_py(), U), _unpack(batch.column(3)[row].as_py(), U), _unpack(batch.column(4)[row].as_py(), np.int64)))
    if held:
        yield from settle()


def _replies(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name))


def _as_dict(value) -> dict[int, bytes]:
    return {x["part"]: x["bits"] for x in value or ()}


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, keep_clean: bool = False, carry: list[str] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row of ``docs``, and its columns named in ``carry``.

    Words are ``[^\\x20\\x09-\\x0D]+``; each word covered by a ``length``-word window that
    also starts in a text with a smaller id goes, judged on the input.  Kept words are
    joined by one space; with ``keep_clean``, texts that lose no word stay as they are.
    Null texts have no words and become empty.  Null ids count as larger than any
    other; rows that share an id don't remove each other's words.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"), *carry)
    chunks = materialize(_chunks(rows, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("size")).first()[0] or 0
    bits = min(24, max(4, int(total / PART_BYTES).bit_length()))

    docs_of = chunks.select("chunk", F.explode(F.arrays_zip("ids", "words", "s1", "s2")).alias("d")).select("chunk", "d.*").where(F.col("words") >= length)
    many = docs_of.groupBy("s1", "s2", "words").agg(F.min("ids").alias("rep"), F.max("ids").alias("last"), F.count("*").alias("n")).where("rep < last").drop("last")
    many = materialize(many, "classes")
    copies = join_classes(docs_of, many, ["s1", "s2", "words"]).where("ids > rep").groupBy("chunk").agg(F.collect_list("ids").alias("copies"))
    copies = materialize(copies, "copies")
    discard(many)

    def probe(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, *parts = (batch.column(i)[row].as_py() for i in range(4))
                for part, kind, values in _Chunk(*parts, length, bits).probes():
                    yield _batch("part int, kind int, chunk long, found binary", [(part, kind, chunk, values)])

    stored = chunks.select("chunk", "ids", "at", "text")
    sent = stored.mapInArrow(tidy(probe), "part int, kind int, chunk long, found binary")
    found = sent.repartition("part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(tidy(_hits), "chunk long, part int, bits binary")
    hits = materialize(_replies(found, "hits"), "hits")

    def windows(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, *parts, hit, copy = (batch.column(i)[row].as_py() for i in range(6))
                c = _Chunk(*parts, length, bits)
                _, *found = c.candidates(_as_dict(hit), copy or [])
                values, others, own, _ = c.owners(*found)
                done = 0
                for part, v in c.by_part(values, 64 - bits):
                    here = slice(done, done + len(v))
                    yield _batch(WINDOWS, [(part, chunk, _pack_sorted(v), _pack(others[here]), _pack(own[here]))])
                    done += len(v)

    hits, copies = hits.hint("merge"), copies.hint("merge")  # both grow with the input: the plan is the same at every size
    known = stored.join(hits, "chunk", "left").join(copies, "chunk", "left")
    sent = known.mapInArrow(tidy(windows), WINDOWS)
    found = sent.repartition("part").sortWithinPartitions("part", "chunk").mapInArrow(tidy(_firsts), "chunk long, part int, bits binary")
    firsts = materialize(_replies(found, "firsts"), "firsts").hint("merge")

    out_schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept_text string")
    for c in carry:
        out_schema.add(docs.schema[c])
    names = out_schema.names

    def finish(batches: Batches) -> Batches:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, *parts, hit, copy, rest, first = (batch.column(i)[row].as_py() for i in range(8))
                c = _Chunk(*parts, length, bits)
                start, *found = c.candidates(_as_dict(hit), copy or [])
                values, _, own, back = c.owners(*found)
                gone = c.replies(values, 64 - bits, _as_dict(first))[back] | (own[back] < c.ids[found[0]])
                w = c.words
                cover = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(cover, start[gone], 1)
                np.add.at(cover, start[gone] + length, -1)
                keep = np.cumsum(cover)[:-1] == 0
                keep &= ~np.repeat(np.isin(c.ids, np.array(copy or [], np.int64)) & (w.count() >= length), w.count())
                along = [x.combine_chunks() for x in pa.ipc.open_stream(rest).read_all().columns] if rest else []
                yield pa.RecordBatch.from_arrays([*_kept(c, keep, keep_clean), *along], names=names)

    whole = chunks.select(*stored.columns, "rest")
    last = whole.join(hits, "chunk", "left").join(copies, "chunk", "left").join(firsts, "chunk", "left").select(*stored.columns, "hits", "copies", "rest", "firsts")
    out = last.mapInArrow(tidy(finish), out_schema)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def _kept(c: _Chunk, keep: np.ndarray, keep_clean: bool) -> list[pa.Array]:
    """Counts and texts after removal; each kept word but a text's last is followed by a space."""
    w = c.words
    kept = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    n = kept[w.first[1:]] - kept[w.first[:-1]]
    chosen = np.flatnonzero(keep)
    last = np.zeros(len(chosen), bool)
    last[np.cumsum(n)[n > 0] - 1] = True
    size = w.end[chosen] - w.start[chosen] + ~last
    jump = np.zeros(len(w.data) + 2, np.int8)
    np.add.at(jump, w.start[chosen], 1)
    np.add.at(jump, w.start[chosen] + size, -1)
    mask = np.cumsum(jump[: len(w.data)], dtype=np.int8) > 0
    data = w.data.copy()
    data[SEPARATOR[data]] = 0x20
    if keep_clean:
        whole = np.repeat(n == w.count(), np.diff(w.text_at))
        mask |= whole
        data[whole] = w.data[whole]
    kept_bytes = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=kept_bytes[1:])
    at = kept_bytes[w.text_at].astype(np.int32)
    text = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[mask].tobytes())])
    return [pa.array(c.ids), pa.array(w.count()), pa.array(w.count() - n), text]

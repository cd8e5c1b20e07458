"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

For every prefix of a unit of text the table stores the one token that the prefix's
encoding ends with.  Tokens that end at a position come from an Aho-Corasick automaton
over the pieces; of these, the right one is the token that is compatible with the last
token of the prefix before it, that is, the two are what merging their joined characters
gives.  Ids are recovered backwards from the table's end.  Work is linear in the length,
whatever the merges are.

Texts are cut into units where no piece can reach across: before a run of word marks and
around line feeds.  Units repeat, so each worker keeps a bounded memo of their ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.words import Memo, tidy

MARK = "▁"
#: Units in the younger of two generations of the memo; the older one holds as many.
MEMO = 200_000
#: Pair tests kept at most; they are made again when needed.
PAIRS = 1_000_000
#: The array type of four signed bytes.
ID_CODE = next(c for c in "il" if array(c).itemsize == 4)


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian int32."""
    out = array(ID_CODE, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Encoder and decoder for one model file; only BPE models without normalisation are taken."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.eos, size = sp.eos_id(), sp.vocab_size()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        fixed = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.piece = {i: sp.id_to_piece(i) for i in range(size) if i not in fixed}
        self.ids = {t: i for i, t in self.piece.items()}
        self.score = {t: sp.get_score(i) for t, i in self.ids.items()}
        self.chars = {t for t in self.ids if len(t) == 1}
        if any(MARK in t.lstrip(MARK) or "\n" in t or not self.chars.issuperset(t) for t in self.ids):
            raise ValueError("pieces reach across words or lines, or have characters that are no pieces")
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte fallback")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.alone: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.shift = size.bit_length()
        self.memo = Memo(self.unit_bytes, MEMO)
        self.unit = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.raw = [b""] * size
        for i, t in self.piece.items():
            self.raw[i] = t.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        for i in range(size):
            if sp.is_unknown(i):
                self.raw[i] = " ⁇ ".encode()

    def merged(self, text: str) -> list[str]:
        """Merging by definition: best score first, leftmost among equals. For short strings."""
        parts, score = list(text), self.score.get
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits_alone(self, t: int) -> bool:
        if t not in self.alone:
            self.alone[t] = self.merged(self.piece[t]) == [self.piece[t]]
        return self.alone[t]

    def _fits(self, a: int, b: int) -> bool:
        key = a << self.shift | b
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return found

    def unit_ids(self, text: str) -> list[int]:
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        if not self.chars.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.chars:
                    last[i + 1] = -1
        pair, shift = self.pairs.get, self.shift
        for end, (size, t) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - size] if end > size else -1
                if before is None:
                    continue
                if before < 0:
                    fit = self._fits_alone(t)
                else:
                    fit = pair(before << shift | t)
                    if fit is None:
                        fit = self._fits(before, t)
                if fit:
                    last[end] = t
        out: list[int] = []
        while n:
            t = last[n]
            if t == -1:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
                n -= 1
            else:
                out.append(t)
                n -= len(self.piece[t])
        return out[::-1]

    def unit_bytes(self, unit: str) -> bytes:
        """The unit's ids as little-endian int32."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        return pack(self.unit_ids(unit))

    def encode(self, text: str) -> bytes:
        """Ids of a text and the end id, as little-endian int32."""
        end = pack([self.eos])
        return b"".join(map(self.memo.__getitem__, self.unit(MARK + text.replace(" ", MARK)))) + end if text else end

    def decode(self, ids: list[int]) -> str:
        """Text of ids; control ids have none, the mark before the first word goes.

        Bytes that are no UTF-8 become U+FFFD.
        """
        text = b"".join(map(self.raw.__getitem__, ids))
        first = next((i for i in ids if self.raw[i]), None)
        if first is not None and self.piece.get(first, "").startswith(MARK):
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    return Codec(model_path)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each whole text with the end id; null counts as empty.

    One row for each row of ``docs``, repeated and null ids included; other columns go.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows = [c.encode(x or "") for x in part.column(1).to_pylist()]
                at = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=at[1:])
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(tidy(work), f"`{id_col}` long, ids array<int>")


def decode_ids(rows: DataFrame, model_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the text of each row's ids; null ids count as none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            lists = batch.column(1)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [c.decode(values[s:e].tolist()) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=[id_col, "ids", "decoded"])

    return rows.select(id_col, F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(tidy(work), f"`{id_col}` long, ids array<int>, decoded string")

"""Token counts of fields and sections, from one encoding of the whole document.

The fields of a row are joined by line feeds and encoded once with a byte-level BPE
tokenizer; as its tokens spell the text's bytes, the running sum of their lengths gives
each token's span.  Spans are interval-joined to the sections, which tile the document: a
field and the line feed behind it, and inside the last field each line with its line
feed.  A token that reaches across a boundary goes by rule: to the section of its
``first`` byte, of its ``last`` byte, or to the one with ``most`` of its bytes (the
earlier of equals).  So the counts of a document's sections always add up to its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlake.llm.word_tokens import WordIds

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
#: The pattern of the file on plain text, fixed by the tokenizer.
BYTE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
RULES = ("first", "last", "most")


class ByteIds(WordIds):
    """Ids of a byte-level tokenizer file whose words follow :data:`BYTE_WORDS`."""

    FILE_MARK = '"use_regex":true'
    WORDS = BYTE_WORDS

    def __init__(self, path: str):
        super().__init__(path)
        size = self.tokenizer.get_vocab_size()
        special = set(self.special)
        spelled = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.lengths = np.array([len(t.encode()) if t in special else len(t) for t in spelled], np.int64)

    def _prepared(self, text: str) -> str:
        return text

    def _mapped(self, word: str) -> str:
        return "".join(self.alphabet[b] for b in word.encode())

    def _mixed(self, text: str) -> bytes:
        return self._library(text)


@lru_cache(maxsize=2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


def allocate(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether the token reaches across a boundary.

    ``lengths`` are the tokens' byte lengths and ``ends`` the sections' ends.
    """
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    first, last = (np.minimum(x, len(ends) - 1) for x in (first, last))
    cross = first != last
    own = last.copy() if rule == "last" else first.copy()
    if rule == "most":
        for i in np.flatnonzero(cross):
            edges = np.concatenate([[start[i]], ends[first[i] : last[i]], [stop[i]]])
            own[i] = first[i] + np.diff(edges).argmax()
    return own, cross


def section_tokens(docs: DataFrame, path: str, fields: list[str], rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """(id, section, field, n_bytes, n_tokens, n_boundary), one row for a section.

    Sections are numbered from 0: one for each field but the last, then the last field's
    lines (one at least).  Null fields are empty; other columns are ignored; each row of
    ``docs`` is counted on its own, repeated or null ids included.  ``n_boundary`` counts
    the section's tokens that reach into another one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = byte_ids(path)
        names = np.array(fields, object)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                texts = ["\n".join(x or "" for x in row) for row in zip(*(c.to_pylist() for c in part.columns[1:]))]
                heads = [np.cumsum([len((x or "").encode()) + 1 for x in row]) for row in zip(*(c.to_pylist() for c in part.columns[1:-1]))] or [np.zeros(0, np.int64)] * len(texts)
                out: list[list[np.ndarray]] = [[] for _ in range(5)]
                rows = []
                for text, head in zip(texts, heads):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    begin = head[-1] if len(head) else 0
                    lines = np.flatnonzero(raw[begin:] == 10) + begin + 1
                    ends = np.concatenate([head, lines, [len(raw)]]) if not len(lines) or lines[-1] < len(raw) else np.concatenate([head, lines])
                    own, cross = allocate(t.lengths[np.frombuffer(t.encode(text), "<u4")], ends, rule)
                    n = len(ends)
                    rows.append(n)
                    index = np.arange(n)
                    for c, v in zip(out, (index, names[np.minimum(index, len(fields) - 1)], np.diff(ends, prepend=0), np.bincount(own, minlength=n), np.bincount(own[cross], minlength=n))):
                        c.append(v)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                index, field, size, count, over = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([ids, pa.array(index), pa.array(field, pa.string()), pa.array(size), pa.array(count), pa.array(over)], names=["id", "section", "field", "n_bytes", "n_tokens", "n_boundary"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"_{i}") for i, f in enumerate(fields)))
    return rows.mapInArrow(work, "id long, section long, field string, n_bytes long, n_tokens long, n_boundary long").withColumnRenamed("id", id_col)

"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte 2- to 4-grams, taken inside words and
their borders and hashed to a fixed number of buckets; a linear softmax gives the
language.  Both are trained together by stochastic gradient descent in numpy on the
driver, from a bounded sample of labelled rows.  As mean and softmax weights are linear,
prediction needs one small table of buckets by languages, of fixed size.

Scores are temperature-scaled on rows of the sample that training doesn't see, so that a
score is the chance that the language is right.  A text is rejected if that chance is
below ``least``: at one half, if it is likelier wrong than right.  If the sample is so
small that no row is left for it, the temperature comes from the training rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlake.llm.words import SEPARATOR, string_bytes, text_slices, tidy

BITS, DIM, GRAMS = 16, 12, (2, 3, 4)
TRAIN_ROWS, PIECE_WORDS, EPOCHS, BATCH, RATE, LEAST = 3000, 25, 3, 32, 1.0, 0.5
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[SEPARATOR] = 0x20


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    temperature: float
    least: float


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket of each subword, text by text, and how many each text has."""
    buffer = np.insert(data, np.concatenate([at[:-1], at[-1:]]), 0x20)
    begin = at + np.arange(len(at))  # a border before each text, and one at the end
    border = SEPARATOR[buffer]
    folded = _fold[buffer].astype(np.uint32)
    packed = folded.copy()
    for n in range(2, max(GRAMS) + 1):
        packed = packed[:-1] | folded[n - 1 :] << np.uint32(8 * (n - 1))  # its bytes are the subword
        if n not in GRAMS:
            continue
        inside = np.ones(len(packed), bool)
        for j in range(1, n - 1):
            inside &= ~border[j : j + len(packed)]
        if n == 2:
            inside &= ~(border[:-1] & border[1:])
        counts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(begin, len(inside))]
        yield ((packed[inside] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), np.diff(counts)


def logits(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over the subwords of each text; zeros for a text without any."""
    total, size = np.zeros((len(at) - 1, table.shape[1])), np.zeros(len(at) - 1, np.int64)
    for bucket, counts in features(data, at):
        some = np.flatnonzero(counts)
        if len(some):
            total[some] += np.add.reduceat(table[bucket], (np.cumsum(counts) - counts)[some], axis=0)
        size += counts
    return total / np.maximum(size, 1)[:, None]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return string_bytes(pa.array(texts, pa.large_string()))


def fit(texts: list[str], labels: list[str], least: float = LEAST, seed: int = 0) -> Model:
    """Train on all words of four fifths of the rows, calibrate on the others; rows in any order give the same model."""
    rows = sorted(zip(texts, labels))
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), 1.0, least)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(lang) for _, lang in rows])
    held = rng.random(len(rows)) < 0.2
    pieces: list[str] = []
    target: list[int] = []
    for i in np.flatnonzero(~held):
        words = rows[i][0].split()
        for s in range(0, len(words), PIECE_WORDS):
            pieces.append(" ".join(words[s : s + PIECE_WORDS]))
            target.append(y[i])
    vectors, weights = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, len(langs)))
    steps = EPOCHS * -(-len(pieces) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        turn = rng.permutation(len(pieces))
        for s in range(0, len(turn), BATCH):
            b = turn[s : s + BATCH]
            found = list(features(*_buffers([pieces[i] for i in b])))  # afresh each time: memory stays that of a batch
            ids = np.concatenate([bucket for bucket, _ in found])
            owner = np.concatenate([np.repeat(np.arange(len(b)), counts) for _, counts in found])
            ids, n = ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(b))
            mean = np.add.reduceat(vectors[ids], np.cumsum(n) - n) / n[:, None]
            slope = softmax(mean @ weights)
            slope[np.arange(len(b)), [target[i] for i in b]] -= 1
            rate = RATE * (1 - step / steps) / np.sqrt(len(b))
            back = slope @ weights.T / n[:, None]
            weights -= rate * mean.T @ slope
            np.add.at(vectors, ids, -rate * np.repeat(back, n, 0))
            step += 1
    table = vectors @ weights
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    z = np.concatenate([logits(*_buffers([rows[i][0]]), table) for i in check])
    goal = y[check]
    loss = lambda t: -np.mean(np.log(softmax(z / t)[np.arange(len(goal)), goal] + 1e-300))
    return Model(langs, table, float(min(np.geomspace(0.25, 20, 89), key=loss)), least)


def held_out(id_col: Column) -> Column:
    """Rows that training and calibration never see."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about ``rows`` labelled rows that aren't held out, chosen by a hash of their id."""
    own = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    n = own.count()
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30))
    sample = own.where(place < int(min(1.0, rows / max(n, 1)) * (1 << 30))).select(text_col, lang_col).collect()
    return fit([r[0] for r in sample], [r[1] for r in sample], least)


def scores(column: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and acceptance of each text."""
    data, at = string_bytes(column)
    names = np.array([*m.langs, "und"], object)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    best, score = np.full(len(column), len(m.langs)), np.zeros(len(column))
    for i, j, part, bounds in text_slices(data, at):
        known = np.diff(np.concatenate([[0], np.cumsum(letter[part])])[bounds]) > 0
        for k in np.flatnonzero(~known & (np.diff(bounds) > 0)):
            known[k] = any(map(str.isalpha, part[bounds[k] : bounds[k + 1]].tobytes().decode("utf-8", "replace")))
        if m.langs:
            p = softmax(logits(part, bounds, m.table) / m.temperature)
            best[i:j], score[i:j] = np.where(known, p.argmax(1), len(m.langs)), np.where(known, p.max(1), 0.0)
    return names[best], score, (best < len(m.langs)) & (score >= m.least)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) for every row, from the whole text alone.

    A null text or one without letters is ``und`` with score 0, and rejected; so is every
    row if the model has learned no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, taken = scores(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(taken)], names=["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(work), "id long, lang_pred string, score double, accepted boolean").withColumnRenamed("id", id_col)


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), shared.value)[2]))

    return docs.mapInArrow(tidy(work), docs.schema)


def crc32_text(value: int) -> int:
    """The checksum behind :func:`held_out`, for tests."""
    return zlib.crc32(str(value).encode())

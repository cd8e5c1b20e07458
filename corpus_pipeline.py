"""A corpus pipeline over ``documents``: language, near duplicates, repeats, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  The
first three return the columns of ``documents``; the last returns packed pieces.  Rows
are told apart by ``doc_id``, the table's key.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.llm import language_id, minhash_dedup, packing, substring_dedup
from medlake.plans.shared import discard, materialize, scratch, small_batches


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated language model rejects go, null texts and those without letters among them."""
    small_batches(spark)
    return language_id.keep_accepted(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked on five-word shingles at 0.8, the smallest id stays.

    Rows that share an id are one document here: they stay or go together.  Rows with a
    null id, and those without words, stay.
    """
    small_batches(spark)
    found = minhash_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has go; so do documents left without words by that.

    A text that loses nothing stays as it is, a null one null; ``n_chars`` of a changed text
    is counted anew.  Each row goes through on its own, whatever id it has: null ids count
    as the last, and rows that share one leave each other alone.
    """
    small_batches(spark)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select("text", *(F.col(c).alias(a) for c, a in own.items()), F.col("text").isNull().alias("no_text"))
    kept = substring_dedup.remove_repeats(rows, length=50, id_col=own["doc_id"], keep_clean=True, carry=[*(a for c, a in own.items() if c != "doc_id"), "no_text"])
    kept = kept.where("n_removed = 0 or n_removed < n_words")
    value = {c: F.col(a).cast(docs.schema[c].dataType) for c, a in own.items()}
    value["text"] = F.when(~F.col("no_text"), F.col("kept_text"))
    value["n_chars"] = F.when(F.col("n_removed") == 0, value["n_chars"]).otherwise(F.char_length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*(value[c].alias(c) for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 2048 with the sources' own mixture."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("packing", pack_windows),
]
#: Not expressible in SQL: a trained model and a tokenizer; the tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's working tables and its input go when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as hand_over:
            done = materialize(stage(spark, docs, sf_dir), name)
            hand_over(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

import pytest
from helpers import SCHEMA, awkward, documents, near_components, repeats
from pyspark.sql import functions as F

from medlake.llm import language_id, queries
from test_tokens import check_packing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    from test_tokens import WORD

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    language = {r.doc_id for r in language_id.predict(docs, language_id.train(docs)).where("accepted").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in language}
    comp = near_components(texts, 5)
    texts = {i: t for i, t in texts.items() if comp[i] == i}
    kept = {}
    for i, (words, left) in repeats(texts, 50).items():
        if len(left) == len(words):
            kept[i] = texts[i]
        elif left:
            kept[i] = " ".join(left)
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, {i: [t] for i, t in kept.items()}, (None, Tokenizer.from_file(WORD)), 2048)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def odd_rows():
    """Awkward rows with null and repeated ids, and columns named as the stages' own were."""
    passage = " ".join(f"p{i}" for i in range(60))
    extra = [(f"a b c {passage}", "en", "s", 3, "z", 1, "r"), (f"d {passage} e", "en", "s", None, "z", 1, "r"), (passage, None, None, 5, "z", 1, "r")]
    rows = awkward(extra)
    rows += [(None, f"null id {passage}", None, None, 7, None, None, None), (None, "null id", *[None] * 6), (None, None, *[None] * 6)]
    return rows + [(101, "the same id with another text", "en", "s", 4, "z", 1, "r"), rows[13]]


def test_stages_on_odd_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_removed int, n_words string"
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame(odd_rows(), names)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, df, SF)
        assert out.dtypes == df.dtypes
        assert stage(spark, spark.createDataFrame([], names), SF).count() == 0
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    out = sorted((tuple(r) for r in corpus_pipeline.remove_repeats(spark, df, SF).collect()), key=key)
    want = []
    for i, text, *rest in odd_rows():
        if i == 100 or text is None or passage not in text:
            want.append((i, text, *rest))  # nothing goes; the passage's first holder keeps it
        elif text != passage:
            left = text.replace(passage, "").split()
            want.append((i, " ".join(left), *rest[:2], len(" ".join(left)), *rest[3:]))
    assert out == sorted(want, key=key)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert sum(r.doc_id is None for r in kept) == 3  # null ids stay
    assert {r.doc_id for r in kept} == {r[0] for r in odd_rows()} - {5, 10, 101, 102}  # "A  B", the second of two equal texts, and what holds the passage after 100
    assert not any(r.doc_id == 101 for r in kept)  # rows that share an id go together


def test_language_stage_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    out = language_id.keep_accepted(documents(spark, [(r[0], r[1], *r[2:]) for r in odd_rows()]), model).collect()
    assert not any(r.text is None or not any(map(str.isalpha, r.text)) for r in out)
    assert language_id.keep_accepted(spark.createDataFrame([], SCHEMA), model).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("pages", "documents", "embeddings"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    rel = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, "/root/testdata/sf0.01")
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert sorted(str([r[n] for n in names]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_every_query_has_rows(spark):
    for name in ("op2_sentencepiece", "op3_language_id", "op8_order_minhash", "op10_token_counts"):
        df = queries.queries()[name](spark, SF)
        assert df.select(F.count_distinct("doc_id")).first()[0] == 200

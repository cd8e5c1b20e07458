"""Golden cases and edge cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from medlake.functions import measures as ms
from medlake.functions import text as tx
from medlake.operators import evaluation as ev
from medlake.operators import ontology, phenotype, relational, rules, textmine, vectors


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def auc_of(spark, pairs):
    df = spark.createDataFrame([("a", y, float(s)) for y, s in pairs], "g string, y int, score double")
    return ev.auc(df, ["g"]).first().auc


def test_auc_ties_and_single_class(spark):
    assert auc_of(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)]) == 0.875
    assert auc_of(spark, [(1, 1), (1, 2)]) is None


def test_auc_matches_pairs_in_any_partitioning(spark):
    rows = [("a", i * 7 % 3 == 0, (i * 31 % 17) / 4) for i in range(200)]
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame([(g, int(y), s) for g, y, s in rows], "g string, y int, score double")
    for n in (1, 8):
        assert math.isclose(ev.auc(df.repartition(n), ["g"]).first().auc, want)


def test_holm(spark):
    df = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03)], "f int, k int, p double")
    assert [round(r.p_adjusted, 9) for r in ev.holm(df, ["f"], "p", "k").orderBy("k").collect()] == [0.03, 0.06, 0.06]


def test_student_tail():
    assert math.isclose(ev.incomplete_beta(5, 0.5, 10 / (10 + 1.812461**2)) / 2, 0.05, rel_tol=1e-5)


def test_codes(spark):
    assert one(spark, tx.canonical_code(F.lit(" e11.9 "))) == "E119"
    assert one(spark, tx.canonical_id(F.lit("1240"))) == "1240"
    assert one(spark, tx.canonical_id(F.lit("17.0"))) == "17"
    assert one(spark, tx.ancestors(F.lit("250.22"))) == ["250.22", "250.2", "250"]
    assert one(spark, tx.ancestors(F.lit("250"))) == ["250"]
    known = spark.createDataFrame([("250",), ("250.2",)], "k string")
    rows = spark.createDataFrame([("250.22",), ("9.1",)], "code string")
    got = {(r.code, r.expanded) for r in phenotype.expand_codes(rows, "code", known).collect()}
    assert got == {("250.22", "250.22"), ("250.22", "250.2"), ("250.22", "250"), ("9.1", "9.1")}


def test_window_labels_edges(spark):
    a = spark.sql("select 1 k, 1 p, timestamp_ntz'2024-06-01 00:00:00' at")
    e = spark.sql("select * from values (1, timestamp_ntz'2023-06-02 00:00:00', 'low'), (1, timestamp_ntz'2024-06-08 00:00:00', 'high'), (1, timestamp_ntz'2024-06-08 00:00:01', 'late'), (1, timestamp_ntz'2023-06-01 23:59:59', 'early') t(p, ts, c)")
    got = phenotype.window_labels(a, e, "p", "k", "at", "ts", "c", "INTERVAL '365' DAY", "INTERVAL '7' DAY")
    assert {r.c for r in got.collect()} == {"low", "high"}


def test_tiers(spark):
    p = rules.Profile(direct=("effusion",), global_exclude=("artifact",))
    assert tuple(one(spark, rules.tier(F.lit("large pleural effusion"), p)))[:2] == ("direct", 102)
    assert tuple(one(spark, rules.tier(F.lit("effusion artifact"), p)))[:2] == ("excluded", 0)


@pytest.mark.parametrize(
    "text, want",
    [("No A, B, or C.", 0), ("minimal b on the right. No b on the left.", 1), ("Possible b.", -1), ("", 0), ("no change in b", 1)],
)
def test_findings(spark, text, want):
    assert one(spark, textmine.status(tx.sentences(F.lit(text)), r"\bb\b")) == want


def test_numbers(spark):
    assert one(spark, F.array(*(ms.band(F.lit(x), [130, 200, 300, 400]) for x in (129, 130, 200, 300, 400)))) == [0, 1, 2, 3, 4]
    assert one(spark, ms.resize_plan([F.lit(5.0), F.lit(10.0)], [5, 5]))["size0"] == 2
    assert one(spark, vectors.zero_shot(F.lit(1.0), F.lit(1.0))) == 0.5


def test_greedy_budget(spark):
    df = spark.createDataFrame([(i, 1) for i in range(3)], "k int, size int")
    assert all(r.accepted for r in relational.greedy_budget(df, "size", "k", 500, 50, 100).collect())
    import random

    r = random.Random(5)
    sizes = [(i, r.randint(1, 30)) for i in range(60)]
    run, want = 0, set()
    for k, n in sorted(sizes, key=lambda x: (x[1], x[0])):
        if run + n <= 210 + 5 or run < 210 - 10:
            run += n
            want.add(k)
    got = relational.greedy_budget(spark.createDataFrame(sizes, "k int, size int"), "size", "k", 210, 5, 10)
    assert {x.k for x in got.where("accepted").collect()} == want


def test_membership_and_orphans(spark):
    a, b = spark.createDataFrame([(0,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int")
    assert {r.key: r.members for r in relational.membership({"a": a, "b": b}, "k").collect()} == {0: "a", 1: "b", 2: "a+b"}
    assert {r.side: r.n for r in relational.orphans(a, b, ["k"]).collect()} == {"both": 1, "left_only": 1, "right_only": 1}


def test_top_k_rerank(spark):
    q = spark.createDataFrame([(0, [1.1, 0.0]), (1, [3.7, 0.0])], "query_id long, v array<double>")
    b = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((0.0, 1.0, 2.0, 4.0))], "bank_id long, v array<double>")
    got = vectors.top_k(q, b.repartition(3), 2, "l2").orderBy("query_id", "rank").collect()
    assert [r.bank_id for r in got] == [1, 2, 3, 2]
    assert vectors.top_k(q.limit(0), b, 2).count() == 0


def test_ground_long_terms(spark):
    terms = spark.createDataFrame([("a b c d e f g h", 1), ("c d", 2)], "term string, node long")
    phrases = spark.createDataFrame([(1, "x a b c d e f g h"), (2, "c d y")], "phrase_id long, phrase string")
    assert {r.phrase_id: r.node for r in ontology.ground(phrases, terms).collect()} == {1: 1, 2: 2}
    assert [r.outcome for r in ontology.ground(phrases.limit(1), terms.limit(0)).collect()] == ["no_term"]


def test_top_k_of_many_queries(spark):
    q = spark.range(200_001).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id")).alias("v"))
    b = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((1.0, -1.0, 0.5))], "bank_id long, v array<double>")
    r = vectors.top_k(q, b, 1).agg(F.count("*"), F.count_distinct("query_id"), F.count_if(F.col("bank_id") == 0), F.count_if(F.col("bank_id") == 1)).first()
    up = q.where(F.col("v")[0] > 0).count()
    assert tuple(r) == (200_001, 200_001, up, 200_001 - up)


def test_top_k_blocks_match_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    x, y = rng.integers(-2, 3, (70, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float)  # many ties
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id long, v array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "bank_id long, v array<double>")
    for name, n in (("QUERY_BLOCK", 16), ("TILE", 7)):
        monkeypatch.setattr(vectors, name, n, raising=False)
    for metric, s in (("dot", x @ y.T), ("l2", -((x[:, None] - y[None]) ** 2).sum(2))):
        for k in (1, 5, 60):
            want = {(i, int(j), s[i, j], r + 1) for i in range(70) for r, j in enumerate(np.lexsort((np.arange(50), -s[i]))[:k])}
            assert {tuple(r) for r in vectors.top_k(q, b, k, metric).collect()} == want


def test_projection_is_one_product(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, v = rng.normal(size=(30, 4)), rng.normal(size=(30, 3)), rng.normal(size=(5, 4))
    bank = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<double>, b array<double>").repartition(3)
    images = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = (v @ a.T) @ b
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    got = np.array([r.p for r in vectors.project(images, bank, "a", "b").orderBy("id").collect()])
    assert np.allclose(got, want)


def test_grounding(spark):
    terms = spark.createDataFrame([("lung", 1), ("left lung", 2), ("heart", 3), ("mass", 4), ("mass", 5)], "term string, node int")
    phrases = spark.createDataFrame([(1, "Left lung"), (2, "lung"), (3, "the lung is clear"), (4, "left lung and heart"), (5, "mass"), (6, "")], "phrase_id int, phrase string")
    got = {r.phrase_id: (r.outcome, r.node) for r in ontology.ground(phrases, terms).collect()}
    assert got == {1: ("grounded", 2), 2: ("grounded", 1), 3: ("unsafe_single_token", None), 4: ("several_nodes", None), 5: ("no_term", None), 6: ("no_term", None)}


def test_text(spark):
    assert one(spark, tx.clean_report(F.lit("FINDINGS: x IMPRESSION: 1. Clear lungs. clear lungs. Please call. Electronically signed"))) == "Clear lungs."
    assert one(spark, tx.clean_report(F.lit(" "))) == " "
    assert one(spark, tx.slug(F.lit("--"))) == "item"
    assert one(spark, tx.polarity(F.lit("no pleural effusion")))["polarity"] == "negated"
    rows = spark.createDataFrame([('{"observations": ["a", 1, "b"]}',), ("{'observations': ['c']}",), ("bad",), (None,)], "raw string")
    assert [r.x for r in rows.select(textmine.parse_observations(F.col("raw")).alias("x")).collect()] == [["a", "b"], ["c"], [], []]

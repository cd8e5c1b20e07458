"""Queries over scores: labels of documents scored by their length, and rows of lineitem as results of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.operators import evaluation as ev
from medlake.plans.shared import beside
from medlake.queries.common import registrar, rounded, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


query = registrar(QUERIES, ORACLE)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(label, doc_id, y, score, cluster): two labels, scored by the document's length."""
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return both.select("doc_id", F.col("n_chars").cast("double").alias("score"), F.col("source").alias("cluster"), F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("label", "y"))


S = """s AS (SELECT l.doc_id, label, y, CAST(d.n_chars AS DOUBLE) AS score, d.source AS cluster
 FROM (SELECT doc_id, 'quality' AS label, quality AS y FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) l JOIN documents d ON l.doc_id = d.doc_id)"""
AUC = """t AS (SELECT label, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY label, score),
 u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
 a AS (SELECT label, CAST(sum(p) AS DOUBLE) AS n_pos, CAST(sum(n) AS DOUBLE) AS n_neg, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM u GROUP BY label)"""


@query("auc_per_label", f"WITH {S}, {AUC} SELECT label, n_pos, n_neg, round(auc, 6) AS auc FROM a")
def auc_per_label(spark, sf):
    return rounded(ev.auc(scores(spark, sf), ["label"]))


@query("auc_macro", f"WITH {S}, {AUC} SELECT 'length' AS model, round(avg(auc), 6) AS macro_auc, count(auc) AS n_labels FROM a")
def auc_macro(spark, sf):
    return rounded(ev.macro(ev.auc(scores(spark, sf), ["label"]).withColumn("model", F.lit("length")), "auc", ["model"]))


@query("hanley_mcneil", f"""WITH {S}, {AUC}, v AS (SELECT *, sqrt(greatest((auc*(1-auc) + (n_pos-1)*(auc/(2-auc)-auc*auc) + (n_neg-1)*(2*auc*auc/(1+auc)-auc*auc)) / (n_pos*n_neg), 0)) AS se FROM a)
 SELECT label, round(auc, 6) AS auc, round(greatest(auc - 1.959963984540054*se, 0), 6) AS low, round(least(auc + 1.959963984540054*se, 1), 6) AS high FROM v""")
def hanley_mcneil(spark, sf):
    a = ev.auc(scores(spark, sf), ["label"])
    low, high = ev.hanley_mcneil(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return rounded(a.select("label", "auc", low.alias("low"), high.alias("high")))


DRAWS = """k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS n FROM (SELECT DISTINCT cluster FROM s)),
 m AS (SELECT b.draw, cluster, (n * 7919 + b.draw * 104729) % 3 AS mult FROM k, (SELECT unnest(range(1, 21)) AS draw) b),
 t AS (SELECT draw, label, score, sum(y * mult) AS p, sum((1 - y) * mult) AS n FROM s JOIN m ON s.cluster = m.cluster GROUP BY ALL),
 u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY draw, label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t),
 a AS (SELECT draw, label, sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc FROM u GROUP BY draw, label)"""


def _draws(spark, sf, draws=20):
    from pyspark.sql import Window

    s = scores(spark, sf)
    names = s.select("cluster").distinct().withColumn("_n", F.row_number().over(Window.orderBy("cluster")))  # one row for a source
    tied = s.groupBy("cluster", "label", "score", "y").agg(F.count("*").alias("_c"))  # what the draws repeat is summed first
    weighted = tied.join(ev.multiplicities(names, draws), "cluster").withColumn("mult", F.col("mult") * F.col("_c"))
    return ev.auc(weighted, ["draw", "label"], weight="mult")


@query("cluster_bootstrap_auc", f"WITH {S}, {DRAWS} SELECT draw, label, round(auc, 6) AS auc FROM a")
def cluster_bootstrap_auc(spark, sf):
    return rounded(_draws(spark, sf).select(F.col("draw").cast("long").alias("draw"), "label", "auc"))


@query("bootstrap_ci", f"""WITH {S}, {DRAWS} SELECT label, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high,
 round(list_sort(list(auc))[greatest(CAST(floor(count(auc) * 0.025) AS INTEGER) - 1, 0) + 1], 6) AS low_at, round(stddev_pop(auc), 6) AS sd FROM a GROUP BY label""")
def bootstrap_ci(spark, sf):
    return rounded(ev.interval(_draws(spark, sf), ["label"], "auc"))


@query("retrieval_c2i", f"""WITH {S}, r AS (SELECT *, row_number() OVER w AS r, sum(y) OVER w AS c FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
 SELECT label, CAST(sum(y) AS BIGINT) AS n_pos, round(sum(CASE WHEN y = 1 THEN c / r END) / nullif(sum(y), 0), 6) AS ap, round(sum(CASE WHEN r <= 10 THEN y ELSE 0 END) / 10.0, 6) AS p_at_k,
 round(sum(CASE WHEN r <= 10 THEN y ELSE 0 END) / nullif(sum(y), 0), 6) AS r_at_k, round(1.0 / min(CASE WHEN y = 1 THEN r END), 6) AS rr FROM r GROUP BY label""")
def retrieval_c2i(spark, sf):
    return rounded(ev.ranking(scores(spark, sf), ["label"], "doc_id"))


DOTS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 c AS (SELECT label AS concept, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label),
 x AS (SELECT vec_id, concept, CAST(e.label = concept AS INTEGER) AS y, round(list_inner_product(v, c), 9) AS score FROM e, c)"""


def concept_scores(spark, sf):
    """(vec_id, concept, y, score): vectors against the centroid of each label."""
    from medlake.functions.vectors import dot, mean_vector

    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    c = mean_vector(e, ["label"], "v", "c").select(F.col("label").alias("concept"), "c")
    held = e.select("vec_id", "label", "v")
    both = beside(held, c, F.col("concept"))
    return both.select("vec_id", "concept", (F.col("label") == F.col("concept")).cast("int").alias("y"), F.round(dot("v", "c"), 9).alias("score"))


@query("retrieval_i2c", f"""WITH {DOTS}, z AS (SELECT vec_id, concept, y, round((score - avg(score) OVER (PARTITION BY concept)) / (stddev_pop(score) OVER (PARTITION BY concept) + 1e-8), 6) AS score FROM x),
 r AS (SELECT *, row_number() OVER w AS r, sum(y) OVER w AS c FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, concept ROWS UNBOUNDED PRECEDING))
 SELECT vec_id, CAST(sum(y) AS BIGINT) AS n_pos, round(sum(CASE WHEN y = 1 THEN c / r END) / nullif(sum(y), 0), 6) AS ap, round(sum(CASE WHEN r <= 3 THEN y ELSE 0 END) / 3.0, 6) AS p_at_k,
 round(sum(CASE WHEN r <= 3 THEN y ELSE 0 END) / nullif(sum(y), 0), 6) AS r_at_k, round(1.0 / min(CASE WHEN y = 1 THEN r END), 6) AS rr FROM r GROUP BY vec_id HAVING sum(y) > 0""")
def retrieval_i2c(spark, sf):
    z = ev.zscore(concept_scores(spark, sf), ["concept"], "score", "z").withColumn("z", F.round("z", 6))
    return rounded(ev.ranking(z, ["vec_id"], "concept", k=3, score="z").where("n_pos > 0"))


@query("retrieval_pooled", f"""WITH {DOTS}, t AS (SELECT concept, score, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY concept, score),
 q AS (SELECT concept, p, coalesce(sum(n) OVER (PARTITION BY concept ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY concept) AS q FROM t)
 SELECT concept, round(sum(p * pow(1 - q, 63)) / sum(p), 6) AS r_at_1,
 round(sum(p * (pow(1-q, 63) + 63*q*pow(1-q, 62) + 1953*pow(q, 2)*pow(1-q, 61) + 39711*pow(q, 3)*pow(1-q, 60) + 595665*pow(q, 4)*pow(1-q, 59))) / sum(p), 6) AS r_at_5,
 round(sum(p * CASE WHEN q = 0 THEN 1.0 ELSE (1 - pow(1 - q, 64)) / (64 * q) END) / sum(p), 6) AS mrr FROM q WHERE p > 0 GROUP BY concept""")
def retrieval_pooled(spark, sf):
    return rounded(ev.pooled_retrieval(concept_scores(spark, sf), ["concept"]))


@query("youden_point", f"""WITH {S}, t AS (SELECT label, score, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY label, score),
 r AS (SELECT label, score, sum(p) OVER w / sum(p) OVER (PARTITION BY label) AS tpr, sum(n) OVER w / sum(n) OVER (PARTITION BY label) AS fpr FROM t WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
 b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(tpr - fpr, 12) DESC, score DESC) AS k FROM r)
 SELECT label, score AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM b WHERE k = 1""")
def youden_point(spark, sf):
    return rounded(ev.youden(scores(spark, sf), ["label"]))


@query("brier_ap", f"""WITH {S}, r AS (SELECT *, score / 40000.0 AS prob, row_number() OVER w AS r, sum(y) OVER w AS c FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING))
 SELECT label, round(avg((prob - y) * (prob - y)), 6) AS brier, round(sum(CASE WHEN y = 1 THEN c / r END) / nullif(sum(y), 0), 6) AS ap FROM r GROUP BY label""")
def brier_ap(spark, sf):
    s = scores(spark, sf)
    brier = s.groupBy("label").agg(F.avg(F.pow(F.col("score") / 40000.0 - F.col("y"), F.lit(2))).alias("brier"))
    return rounded(brier.join(ev.ranking(s, ["label"], "doc_id").select("label", "ap"), "label"))


@query("min_positive_labels", f"WITH {S} SELECT label, CAST(sum(y) AS BIGINT) AS n_pos FROM s GROUP BY label HAVING sum(y) >= 50")
def min_positive_labels(spark, sf):
    return scores(spark, sf).groupBy("label").agg(F.sum("y").cast("long").alias("n_pos")).where("n_pos >= 50")


PRED = "p AS (SELECT label, cluster, y, CAST(score >= 2000 AS INTEGER) AS pred FROM s)"
CONF = "sum(CAST(y = 1 AND pred = 1 AS BIGINT)) AS tp, sum(CAST(y = 0 AND pred = 1 AS BIGINT)) AS fp, sum(CAST(y = 1 AND pred = 0 AS BIGINT)) AS fn"
PRF = "CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"


@query("prf_micro_macro", f"""WITH {S}, {PRED}, c AS (SELECT label, {CONF} FROM p GROUP BY label UNION ALL SELECT 'micro', {CONF} FROM p), r AS (SELECT label, {PRF} FROM c)
 SELECT * FROM r UNION ALL SELECT 'macro', NULL, NULL, NULL, round(avg(tp / nullif(tp + fp, 0)), 6), round(avg(tp / nullif(tp + fn, 0)), 6), round(avg(2 * tp / nullif(2 * tp + fp + fn, 0)), 6) FROM r WHERE label <> 'micro'""")
def prf_micro_macro(spark, sf):
    p = scores(spark, sf).withColumn("pred", (F.col("score") >= 2000).cast("int"))
    each = ev.prf(p, ["label"])
    micro = ev.prf(p.withColumn("label", F.lit("micro")), ["label"])
    none = F.lit(None).cast("long")
    total = each.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")).select(F.lit("macro").alias("label"), none.alias("tp"), none.alias("fp"), none.alias("fn"), "precision", "recall", "f1")
    return rounded(each.unionByName(micro).unionByName(total))


@query("label_agreement", f"""WITH {S}, {PRED}, r AS (SELECT label, cluster, avg(y) AS a, avg(pred) AS b, avg(CAST(y = pred AS INTEGER)) AS same FROM p GROUP BY label, cluster)
 SELECT round(avg(same), 6) AS agreement, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS prevalence_r, round(avg(abs(a - b)), 6) AS prevalence_mae FROM r""")
def label_agreement(spark, sf):
    p = scores(spark, sf).withColumn("pred", (F.col("score") >= 2000).cast("int"))
    r = p.groupBy("label", "cluster").agg(F.avg("y").alias("a"), F.avg("pred").alias("b"), F.avg((F.col("y") == F.col("pred")).cast("int")).alias("same"))
    return rounded(r.agg(F.avg("same").alias("agreement"), ev.correlation("a", "b").alias("prevalence_r"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("prevalence_mae")))


@query("seed_summary", "SELECT l_returnflag AS model, l_linenumber AS seed, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS std, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def seed_summary(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("seed"), "l_discount")
    return rounded(ev.seed_summary(li, ["model", "seed"], "l_discount"))


@query("mean_sem_ci", "SELECT l_returnflag AS model, count(l_tax) AS n, round(avg(l_tax), 6) AS mean, round(CASE WHEN count(l_tax) = 1 THEN 0.0 ELSE 1.96 * stddev_samp(l_tax) / sqrt(count(l_tax)) END, 6) AS half_width FROM lineitem GROUP BY ALL")
def mean_sem_ci(spark, sf):
    return rounded(ev.mean_sem(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "model"), ["model"], "l_tax"))


@query("holm_adjust", """WITH p AS (SELECT s_nationkey % 5 AS family, s_suppkey AS test, (s_suppkey * 37 % 101) / 1000.0 AS p FROM supplier),
 a AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS a FROM p)
 SELECT family, test, round(CAST(p AS DOUBLE), 6) AS p, round(CAST(max(a) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS p_adjusted FROM a""")
def holm_adjust(spark, sf):
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("family"), F.col("s_suppkey").alias("test"), ((F.col("s_suppkey") * 37 % 101) / 1000.0).alias("p"))
    return rounded(ev.holm(s, ["family"], "p", "test"))


@query("spearman", """WITH r AS (SELECT c_mktsegment AS g, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS b FROM customer)
 SELECT g AS c_mktsegment, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY g""")
def spearman(spark, sf):
    return rounded(ev.spearman(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey"))


@query("welch_t")
def welch_t(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("g", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(ev.welch(li, ["l_returnflag"], "g", "l_quantity"))

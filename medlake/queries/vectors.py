"""Embeddings, each as a query and as a bank row, and their label centroids; a nation tree as ontology; model fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions.vectors import dot, mean_vector, norm, normalize
from medlake.operators import ml, ontology
from medlake.operators import relational as rel
from medlake.operators import vectors as ve
from medlake.plans.shared import beside
from medlake.queries.common import registrar, rounded, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
N = "n AS (SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-9)) AS v FROM e)"
C = "c AS (SELECT label AS c_label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label)"


def emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def unit(spark, sf):
    return emb(spark, sf).withColumn("v", normalize("v"))


def centroids(spark, sf):
    return mean_vector(unit(spark, sf), ["label"], "v", "c").withColumnRenamed("label", "c_label")


def image_scores(spark, sf):
    return beside(unit(spark, sf), centroids(spark, sf), F.col("c_label"))


@query("vec_normalize", f"WITH {E}, {N} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first FROM n")
def vec_normalize(spark, sf):
    return rounded(unit(spark, sf).select("vec_id", norm("v").alias("norm"), F.get("v", F.lit(0)).alias("first")))


TOPK = "s AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, round(list_inner_product(q.v, b.v), 9) AS score FROM n q, n b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) AS rank FROM s)"


def searched(spark, sf, k=10, metric="dot", pool="true"):
    u = unit(spark, sf)
    return ve.top_k(u.select(F.col("vec_id").alias("query_id"), "v"), u.where(pool).select(F.col("vec_id").alias("bank_id"), "v"), k, metric)


@query("vec_topk", f"WITH {E}, {N}, {TOPK} SELECT query_id, bank_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vec_topk(spark, sf):
    return rounded(searched(spark, sf))


@query("pool_knn", f"WITH {E}, {N}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, round(-(list_inner_product(q.v, q.v) - 2 * list_inner_product(q.v, b.v) + list_inner_product(b.v, b.v)), 9) AS score FROM n q, n b WHERE b.label = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bank_id) AS rank FROM s) SELECT query_id, bank_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def pool_knn(spark, sf):
    return rounded(searched(spark, sf, 5, "l2", "label = 0"))


@query("knn_rerank", f"WITH {E}, {N}, {TOPK}, a AS (SELECT query_id, bank_id, score FROM r WHERE rank <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(greatest(0, 2 - 2 * score)), 6), bank_id) AS place FROM a) SELECT query_id, bank_id, round(sqrt(greatest(0, 2 - 2 * score)), 6) AS distance, place FROM b WHERE place <= 2")
def knn_rerank(spark, sf):
    near = searched(spark, sf).withColumn("distance", F.round(ve.unit_distance(F.col("score")), 6))
    return rel.keep_top(near.select("query_id", "bank_id", "distance"), ["query_id"], [F.col("distance"), F.col("bank_id")], 2, "place").withColumn("place", F.col("place").cast("bigint"))


@query("unit_distance", f"WITH {E}, {N}, {C} SELECT vec_id, c_label, round(sqrt(greatest(0, 2 - 2 * least(greatest(list_inner_product(v, c) / sqrt(list_inner_product(c, c)), -1), 1))), 6) AS distance FROM n, c")
def unit_distance(spark, sf):
    return rounded(image_scores(spark, sf).select("vec_id", "c_label", ve.unit_distance(dot("v", "c") / norm("c")).alias("distance")))


@query("group_centroids", f"WITH {E}, {N} SELECT label, i, round(avg(v[i]), 6) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i")
def group_centroids(spark, sf):
    c = centroids(spark, sf).select(F.col("c_label").alias("label"), F.posexplode("c").alias("p", "m"))
    return rounded(c.select("label", (F.col("p") + 1).cast("bigint").alias("i"), "m"))


@query("centroid_alignment", f"WITH {E}, {N}, {C}, s AS (SELECT vec_id, label, c_label, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(v, c), 9) DESC, c_label) AS r FROM n, c) SELECT label, count(CASE WHEN r = 1 THEN 1 END) AS n, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM s WHERE label = c_label GROUP BY label")
def centroid_alignment(spark, sf):
    s = image_scores(spark, sf).withColumn("s", F.round(dot("v", "c"), 9)).select("vec_id", "label", "c_label", "s")
    r = rel.keep_top(s, ["vec_id"], [F.col("s").desc(), F.col("c_label")], 10**6, "r").where("label = c_label")
    return rounded(r.groupBy("label").agg(F.count_if(F.col("r") == 1).alias("n"), F.avg((F.col("r") == 1).cast("double")).alias("top1"), F.avg((F.col("r") <= 3).cast("double")).alias("top3")))


@query("centroid_corr_distance", f"WITH {E}, {N}, g AS (SELECT label, i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) SELECT a.label AS a, b.label AS b, round(least(greatest(1 - corr(a.m, b.m), 0), 2), 6) AS distance FROM g a JOIN g b ON a.i = b.i AND a.label < b.label GROUP BY ALL")
def centroid_corr_distance(spark, sf):
    return rounded(ve.centroid_pairs(centroids(spark, sf), "c_label", "c"))


@query("zero_shot_score", f"WITH {E}, {N}, {C} SELECT n.vec_id, round(1 / (1 + exp(list_inner_product(n.v, b.c) - list_inner_product(n.v, a.c))), 6) AS p FROM n, c a, c b WHERE a.c_label = 0 AND b.c_label = 1")
def zero_shot_score(spark, sf):
    s = image_scores(spark, sf).select("vec_id", "c_label", dot("v", "c").alias("s")).groupBy("vec_id").pivot("c_label", [0, 1]).agg(F.first("s"))
    return rounded(s.select("vec_id", ve.zero_shot(F.col("0"), F.col("1")).alias("p")))


@query("presence_ensemble", f"WITH {E}, {N}, {C} SELECT n.vec_id, round(avg(1 / (1 + exp(-10 * (list_inner_product(n.v, a.c) - list_inner_product(n.v, r.c))))), 6) AS presence FROM n, c a, c r WHERE r.c_label = 0 AND a.c_label IN (1, 2, 3) GROUP BY 1")
def presence_ensemble(spark, sf):
    s = image_scores(spark, sf).select("vec_id", "c_label", dot("v", "c").alias("s"))
    ref = s.where("c_label = 0").select("vec_id", F.col("s").alias("r"))
    both = s.where(F.col("c_label").isin(1, 2, 3)).join(ref, "vec_id")
    return rounded(both.groupBy("vec_id").agg(F.avg(ve.zero_shot(10 * F.col("s"), 10 * F.col("r"))).alias("presence")))


@query("bank_projection", f"""WITH {E}, {N}, b AS (SELECT v, list_reverse(v) AS w FROM n), g AS (SELECT i, j, sum(v[i] * w[j]) AS g FROM b, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j),
 p AS (SELECT vec_id, j, sum(v[i] * g) AS x FROM n, g GROUP BY vec_id, j) SELECT vec_id, j, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-9), 6) AS x FROM p""")
def bank_projection(spark, sf):
    u = unit(spark, sf)
    bank = u.select(F.col("v").alias("a"), F.reverse("v").alias("b"))
    p = ve.project(u.select(F.col("vec_id").alias("id"), "v"), bank, "a", "b")
    return rounded(p.select(F.col("id").alias("vec_id"), F.posexplode("p").alias("_j", "x")).select("vec_id", (F.col("_j") + 1).cast("bigint").alias("j"), "x"))


MEAN = "m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS x FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)), d AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS d FROM n, m), k AS (SELECT vec_id, list_transform(d, lambda x: x / greatest(sqrt(list_inner_product(d, d)), 1e-9)) AS k FROM d)"
ALIGN = f"WITH {E}, {N}, {C}, {MEAN}, x AS (SELECT c_label, vec_id, list_inner_product(c, k) AS a, list_inner_product(c, k) / sqrt(list_inner_product(c, c)) AS cosine FROM c, k)"


def aligned(spark, sf):
    bank = ve.centred(unit(spark, sf).select("vec_id", "v"), "v", "k")
    both = beside(bank, centroids(spark, sf), F.col("c_label"))
    return both.select("c_label", "vec_id", dot("c", "k").alias("a"), (dot("c", "k") / norm("c")).alias("cosine"))


@query("alignment_raw", f"{ALIGN} SELECT c_label, vec_id, round(a, 6) AS alignment FROM x")
def alignment_raw(spark, sf):
    return rounded(aligned(spark, sf).select("c_label", "vec_id", F.col("a").alias("alignment")))


@query("alignment_cosine", f"{ALIGN} SELECT c_label, vec_id, round(cosine, 6) AS alignment FROM x")
def alignment_cosine(spark, sf):
    return rounded(aligned(spark, sf).select("c_label", "vec_id", F.col("cosine").alias("alignment")))


@query("signed_topk", f"{ALIGN}, r AS (SELECT c_label, vec_id, round(a, 9) AS a, row_number() OVER (PARTITION BY c_label, a > 0 ORDER BY abs(round(a, 9)) DESC, vec_id) AS rank, count(*) OVER (PARTITION BY c_label, a > 0) AS n FROM x WHERE round(a, 9) <> 0) SELECT c_label, CASE WHEN a > 0 THEN 'positive' ELSE 'negative' END AS side, rank, vec_id, round(a, 6) AS alignment, n FROM r WHERE rank <= 10")
def signed_topk(spark, sf):
    from pyspark.sql import Window

    s = aligned(spark, sf).withColumn("a", F.round("a", 9)).where("a <> 0").withColumn("side", F.when(F.col("a") > 0, "positive").otherwise("negative"))
    s = s.withColumn("n", F.count("*").over(Window.partitionBy("c_label", "side")))
    top = rel.keep_top(s, ["c_label", "side"], [F.abs("a").desc(), F.col("vec_id")], 10, "rank")
    return rounded(top.select("c_label", "side", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.col("a").alias("alignment"), "n"))


@query("sign_consistency", f"{ALIGN} SELECT vec_id, round(avg(CASE WHEN sign(round(a, 9)) = sign(round(p, 9)) THEN 1.0 ELSE 0.0 END), 6) AS consistency FROM (SELECT vec_id, a, avg(a) OVER (PARTITION BY vec_id) AS p FROM x) GROUP BY 1")
def sign_consistency(spark, sf):
    s = aligned(spark, sf)
    point = s.groupBy("vec_id").agg(F.avg("a").alias("p"))
    same = (F.signum(F.round("a", 9)) == F.signum(F.round("p", 9))).cast("double")
    return rounded(s.join(point, "vec_id").groupBy("vec_id").agg(F.avg(same).alias("consistency")))


@query("standardize", f"WITH {E}, s AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY i) SELECT vec_id, i, round((v[i] - m) / (s + 1e-8), 6) AS z FROM e, s")
def standardize(spark, sf):
    z = ml.standardize(emb(spark, sf), "v", "z").select("vec_id", F.posexplode("z").alias("_i", "z"))
    return rounded(z.select("vec_id", (F.col("_i") + 1).cast("bigint").alias("i"), "z"))


@query("masked_pool", f"WITH {E}, p AS (SELECT vec_id, v, CASE WHEN vec_id % 2 = 0 THEN v[1:8] END AS a, CASE WHEN vec_id % 3 = 0 THEN v[9:16] END AS b, i FROM e, (SELECT unnest(range(1, 9)) AS i)) SELECT vec_id, i, round((coalesce(a[i], 0) + coalesce(b[i], 0)) / greatest(CAST(a IS NOT NULL AS INTEGER) + CAST(b IS NOT NULL AS INTEGER), 1), 6) AS x FROM p")
def masked_pool(spark, sf):
    a, b = F.when(F.col("vec_id") % 2 == 0, F.slice("v", 1, 8)), F.when(F.col("vec_id") % 3 == 0, F.slice("v", 9, 8))
    p = emb(spark, sf).select("vec_id", F.posexplode(ve.masked_pool([a, b], 8)).alias("_i", "x"))
    return rounded(p.select("vec_id", (F.col("_i") + 1).cast("bigint").alias("i"), "x"))


@query("anchor_neighbors", f"WITH {E}, {N}, a AS (SELECT label, min(vec_id) AS anchor FROM n GROUP BY label), s AS (SELECT a.label, b.vec_id, b.label AS other, row_number() OVER (PARTITION BY a.label ORDER BY round(list_inner_product(q.v, b.v), 9) DESC, b.vec_id) AS r FROM a JOIN n q ON q.vec_id = anchor, n b WHERE b.vec_id <> anchor) SELECT label, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS same_family FROM s WHERE r <= 8 GROUP BY label")
def anchor_neighbors(spark, sf):
    u = unit(spark, sf)
    a = u.groupBy("label").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("query_id"))
    near = ve.top_k(a.select("query_id", "v"), u.select(F.col("vec_id").alias("bank_id"), "v"), 9).where("query_id <> bank_id")
    near = rel.keep_top(near, ["query_id"], [F.col("rank")], 8).join(a.select("query_id", "label"), "query_id").join(u.select(F.col("vec_id").alias("bank_id"), F.col("label").alias("other")), "bank_id")
    return rounded(near.groupBy("label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("same_family")))


@query("neighbour_purity", f"WITH {E}, {N}, s AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS r FROM n a, n b WHERE a.vec_id <> b.vec_id) SELECT label, round(avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END), 6) AS purity FROM s WHERE r <= 5 GROUP BY label")
def neighbour_purity(spark, sf):
    return rounded(ve.neighbour_purity(unit(spark, sf).withColumnRenamed("vec_id", "id"), 5))


@query("probe_retrieval", f"WITH {E}, {N}, p AS (SELECT unnest(['widget', 'bolt', 'zzz']) AS probe), h AS (SELECT probe, (SELECT min(p_partkey) FROM part WHERE contains(lower(p_name), probe)) AS part FROM p), s AS (SELECT probe, b.vec_id, row_number() OVER (PARTITION BY probe ORDER BY round(list_inner_product(q.v, b.v), 9) DESC, b.vec_id) AS r FROM h JOIN n q ON q.vec_id = part % 20, n b) SELECT h.probe, s.vec_id, s.r AS rank FROM h LEFT JOIN s ON h.probe = s.probe AND s.r <= 5")
def probe_retrieval(spark, sf):
    probes = spark.createDataFrame([("widget",), ("bolt",), ("zzz",)], "probe string")
    p = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("t"))
    hit = probes.join(p, F.contains("t", "probe"), "left").groupBy("probe").agg((F.min("p_partkey") % 20).alias("query_id"))
    u = unit(spark, sf)
    q = hit.join(u.select(F.col("vec_id").alias("query_id"), "v"), "query_id").select("query_id", "v").distinct()
    near = ve.top_k(q, u.select(F.col("vec_id").alias("bank_id"), "v"), 5)
    return hit.join(near, "query_id", "left").select("probe", F.col("bank_id").alias("vec_id"), "rank")


TREE = "t AS (SELECT 'r' || r_regionkey AS child, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def tree(spark, sf):
    edge = lambda name, key, up, parent: table(spark, sf, name).select(parent.alias("parent"), F.concat(F.lit(up), F.col(key).cast("string")).alias("child"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return edge("region", "r_regionkey", "r", F.lit("root")).union(edge("nation", "n_nationkey", "n", text("r", "n_regionkey"))).union(edge("supplier", "s_suppkey", "s", text("n", "s_nationkey")))


@query("hierarchy_closure", f"WITH RECURSIVE {TREE}, c AS (SELECT 'r1' AS node, 0 AS depth UNION ALL SELECT child, depth + 1 FROM c JOIN t ON parent = node) SELECT node, depth FROM c")
def hierarchy_closure(spark, sf):
    return ontology.descendants(tree(spark, sf), spark.createDataFrame([("r1",)], "node string"))


HOPS = f"WITH RECURSIVE {TREE}, u AS (SELECT parent AS x, child AS y FROM t UNION SELECT child, parent FROM t), w AS (SELECT 'n' || n_nationkey AS source, 'n' || n_nationkey AS node, 0 AS hops FROM nation UNION SELECT source, y, hops + 1 FROM w JOIN u ON x = node WHERE hops < 4), h AS (SELECT source, node, min(hops) AS hops FROM w GROUP BY ALL)"


def walked(spark, sf):
    src = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return ontology.hops(tree(spark, sf), src, 4)


@query("hop_distances", f"{HOPS} SELECT source, node, hops FROM h")
def hop_distances(spark, sf):
    return walked(spark, sf)


@query("hop_distance_stats", f"{HOPS} SELECT source, count(*) AS n, round(quantile_cont(hops, 0.25), 6) AS q25, round(quantile_cont(hops, 0.5), 6) AS median, round(quantile_cont(hops, 0.75), 6) AS q75, round(stddev_samp(hops), 6) AS sd FROM h GROUP BY source")
def hop_distance_stats(spark, sf):
    q = lambda p: F.percentile("hops", F.lit(p))
    return rounded(walked(spark, sf).groupBy("source").agg(F.count("*").alias("n"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.stddev_samp("hops").alias("sd")))


WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query("phrase_grounding", f"""WITH z AS (SELECT n_name AS term, n_nationkey AS node FROM nation UNION ALL SELECT r_name, r_regionkey + 1000 FROM region), t AS (SELECT array_to_string({WORDS.format('term')}, ' ') AS gram, min(node) AS node FROM z GROUP BY 1 HAVING count(DISTINCT node) = 1),
 p AS (SELECT n_nationkey * 2 AS phrase_id, {WORDS.format('n_name')} AS w FROM nation UNION ALL SELECT n_nationkey * 2 + 1, {WORDS.format("'goods from ' || n_name")} FROM nation), a AS (SELECT phrase_id, w, unnest(range(0, len(w))) AS s FROM p), b AS (SELECT phrase_id, w, s, unnest(range(s + 1, len(w) + 1)) AS e FROM a),
 h AS (SELECT phrase_id, len(w) AS size, s, e, node FROM b JOIN t ON gram = array_to_string(w[s + 1:e], ' ')), m AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.phrase_id = h.phrase_id AND o.s <= h.s AND o.e >= h.e AND o.e - o.s > h.e - h.s)),
 g AS (SELECT phrase_id, count(DISTINCT node) AS nodes, min(node) AS node, max(e - s) AS longest, any_value(size) AS size FROM m GROUP BY 1), o AS (SELECT p.phrase_id, g.node, CASE WHEN nodes IS NULL THEN 'no_term' WHEN nodes > 1 THEN 'several_nodes' WHEN longest >= 2 OR size = 1 THEN 'grounded' ELSE 'unsafe_single_token' END AS outcome FROM p LEFT JOIN g USING (phrase_id))
 SELECT phrase_id, outcome, CASE WHEN outcome = 'grounded' THEN node END AS node FROM o""")
def phrase_grounding(spark, sf):
    terms = table(spark, sf, "nation").select(F.col("n_name").alias("term"), F.col("n_nationkey").alias("node")).union(table(spark, sf, "region").select("r_name", (F.col("r_regionkey") + 1000)))
    phrases = table(spark, sf, "nation").select((F.col("n_nationkey") * 2).alias("phrase_id"), F.col("n_name").alias("phrase")).union(table(spark, sf, "nation").select((F.col("n_nationkey") * 2 + 1), F.concat(F.lit("goods from "), "n_name")))
    return ontology.ground(phrases, terms)


@query("linear_probe")
def linear_probe(spark, sf):
    z = ml.standardize(emb(spark, sf), "v", "z").withColumn("y", (F.col("label") == 0).cast("int"))
    return rounded(ml.probe(z, "z"), 4).select("intercept", F.size("coefficients").alias("n"))


@query("pca_scores", f"WITH {E}, {N}, m AS (SELECT i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1), x AS (SELECT vec_id, sum((v[i] - m) * (v[i] - m)) AS energy FROM n, m GROUP BY 1) SELECT vec_id, round(energy, 6) AS energy, true AS falling FROM x")
def pca_scores(spark, sf):
    """Scores on all components keep each vector's distance from the mean, and fall in variance."""
    from pyspark.sql import Window

    p = ml.pca(unit(spark, sf), "v", 64, "p").select("vec_id", "p")
    var = p.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    rises = var.withColumn("next", F.lead("s").over(Window.orderBy("i"))).agg(F.coalesce(F.bool_and(F.col("s") + 1e-9 >= F.col("next")), F.lit(True)).alias("falling"))  # one row a component
    return rounded(p.select("vec_id", dot("p", "p").alias("energy")).crossJoin(F.broadcast(rises)))  # one row


@query("rand_index", "WITH q AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS ij, CAST(sum(n) AS DOUBLE) AS t FROM q), y AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT a, sum(n) AS n FROM q GROUP BY 1)), z AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT b, sum(n) AS n FROM q GROUP BY 1)) SELECT round((ij - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari FROM x, y, z")
def rand_index(spark, sf):
    return rounded(ml.adjusted_rand(table(spark, sf, "embeddings").withColumn("cluster", F.col("vec_id") % 7), "label", "cluster"))


@query("cluster_agreement")
def cluster_agreement(spark, sf):
    return rounded(ml.adjusted_rand(ml.kmeans(unit(spark, sf), "v", 10), "label", "cluster"), 4)

"""Study designs over the tables: complete cases, nulls, pair samples, layouts, linkage, repair, sources and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions import clip
from medlake.functions.vectors import dot, mean_vector
from medlake.operators import ml, phenotype, probes
from medlake.operators import relational as rel
from medlake.operators import studies as st
from medlake.operators import vectors as ve
from medlake.plans.cache import cached
from medlake.plans.shared import new_path
from medlake.queries.common import registrar, rounded, table
from medlake.queries.vectors import E, HOPS, N, aligned, centroids, unit, walked
from medlake.sources import readers as rd
from medlake.streaming import calls

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)


@query("covered_columns", """WITH w AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT * FROM w WHERE quality IS NOT NULL AND toxic IS NOT NULL)
 SELECT 'quality' AS label, count(*) AS n, round(avg(quality), 6) AS prevalence FROM c UNION ALL SELECT 'toxic', count(*), round(avg(toxic), 6) FROM c""")
def covered_columns(spark, sf):
    wide = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("unseen", F.lit(None).cast("int"))
    cases, kept = st.complete_cases(wide.select("doc_id", "quality", "toxic", "unseen"), ["quality", "toxic", "unseen"])
    long = cases.select(F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in kept))).alias("x")).select("x.*")
    return rounded(long.groupBy("label").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence")))


HALVES = f"{E}, {N}, h AS (SELECT label, vec_id % 2 AS half, i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL), d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM h a JOIN h b ON a.i = b.i WHERE a.half = 1 AND b.half = 0 GROUP BY a.label, b.label)"


def halves(spark, sf):
    """Distances between the label centroids of odd ids and those of even ids."""
    c = mean_vector(unit(spark, sf).withColumn("half", F.col("vec_id") % 2), ["label", "half"], "v", "c")
    a, b = c.where("half = 1").select(F.col("label").alias("a"), F.col("c").alias("x")), c.where("half = 0").select(F.col("label").alias("b"), F.col("c").alias("y"))
    gap = F.zip_with("x", "y", lambda x, y: x - y)
    return a.crossJoin(b).withColumn("g", gap).select("a", "b", F.sqrt(dot("g", "g")).alias("d"))  # labels, not rows


@query("centroid_null", f"""WITH {HALVES}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS r, row_number() OVER (PARTITION BY a, a % 3 = b % 3 ORDER BY round(d, 9), b) AS k FROM d),
 o AS (SELECT count(*) AS n, avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END) AS top1, avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END) AS top3, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0 END) AS g FROM r WHERE a = b),
 l AS (SELECT DISTINCT b AS label FROM d), p AS (SELECT label, row_number() OVER (ORDER BY label) AS at FROM l), t AS (SELECT p, label AS turned, row_number() OVER (PARTITION BY p ORDER BY substr(md5('null:' || p || ':' || label), 1, 8), label) AS at FROM l, (SELECT unnest(range(0, 400)) AS p)),
 x AS (SELECT t.p, count(CASE WHEN t.turned = r.a THEN 1 END) AS hits FROM t JOIN p ON t.at = p.at JOIN r ON r.r = 1 AND r.b = p.label GROUP BY 1)
 SELECT n, round(top1, 6) AS top1, round(top3, 6) AS top3, round(g, 6) AS top1_in_group, round((SELECT avg(hits / n) FROM x), 6) AS null_mean, round((1 + (SELECT count(*) FROM x WHERE hits / n >= top1 - 1e-12)) / 401, 6) AS p_value FROM o""")
def centroid_null(spark, sf):
    return rounded(st.centroid_null(halves(spark, sf), F.col("b") % 3, 400))


MD5 = lambda *parts: "CAST('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8) AS BIGINT)"


@query("random_pairs", f"WITH k AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents), t AS (SELECT t AS attempt, {MD5(repr('7'), 't', repr('left'))} AS a, {MD5(repr('7'), 't', repr('right'))} AS b FROM (SELECT unnest(range(0, 2000)) AS t)), u AS (SELECT attempt, a % n AS l, (a % n + 1 + b % (n - 1)) % n AS r FROM t, (SELECT count(*) AS n FROM documents)) SELECT attempt, x.doc_id AS \"left\", y.doc_id AS \"right\" FROM u JOIN k x ON x.k = l JOIN k y ON y.k = r WHERE x.lang <> y.lang")
def random_pairs(spark, sf):
    return st.random_pairs(table(spark, sf, "documents"), "doc_id", "lang", 2000, "7")


@query("balanced_pairs", f"{HOPS}, p AS (SELECT source, node, hops, {MD5(repr('b'), 'source', 'node', 'hops')} AS k FROM h WHERE hops > 0), q AS (SELECT *, row_number() OVER (PARTITION BY hops, source ORDER BY k, source, node, hops) AS r FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY hops ORDER BY k, source, node, hops) AS z FROM q WHERE r <= 3) SELECT source, node, hops FROM s WHERE z <= 20")
def balanced_pairs(spark, sf):
    return st.balanced_pairs(walked(spark, sf).where("hops > 0").select("source", "node", "hops"), "hops", ["source"], 3, 20, "b")


def nation_sizes(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return n.join(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("size")), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "n_nationkey", "size")


SIZES = "z AS (SELECT n_name, n_nationkey, count(*) AS size FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2)"


@query("first_fit", f"""WITH RECURSIVE {SIZES}, s AS (SELECT n_name, size, row_number() OVER (ORDER BY n_nationkey) AS k FROM z), c AS (SELECT greatest(ceil(sum(size) / 4), max(size)) AS cap FROM s),
 w AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS n_name, -1 AS bin, [0.0, 0, 0, 0]::DOUBLE[] AS loads UNION ALL
 SELECT k, n_name, bin, list_transform(loads, lambda x, i: CASE WHEN i - 1 = bin THEN x + size ELSE x END) FROM (SELECT s.k, s.n_name, s.size, loads, CAST(coalesce(nullif(list_position(list_transform(loads, lambda x: x + s.size <= cap), true), 0), list_position(loads, list_min(loads))) - 1 AS INTEGER) AS bin FROM w JOIN s ON s.k = w.k + 1, c))
 SELECT n_name, bin FROM w WHERE k > 0""")
def first_fit(spark, sf):
    return st.first_fit(nation_sizes(spark, sf), "n_name", "size", ["n_nationkey"], 4)


@query("contiguous_parts", f"""WITH {SIZES}, s AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k, sum(size) OVER (ORDER BY n_nationkey) AS run FROM z), m AS (SELECT max(k) AS m, max(run) / 3 AS t FROM s),
 c AS (SELECT a.k AS a, b.k AS b, a.run - t AS x, b.run - a.run - t AS y, 2 * t - b.run AS z FROM s a JOIN s b ON a.k < b.k, m WHERE b.k < m), o AS (SELECT a, b FROM c ORDER BY round(greatest(abs(x), abs(y), abs(z)), 9), round(x * x + y * y + z * z, 9), a, b LIMIT 1)
 SELECT n_name, CAST(CASE WHEN k <= a THEN 0 WHEN k <= b THEN 1 ELSE 2 END AS INTEGER) AS part FROM s, o""")
def contiguous_parts(spark, sf):
    return st.contiguous_parts(nation_sizes(spark, sf), "n_name", "size", ["n_nationkey"], 3)


@query("complete_linkage")
def complete_linkage(spark, sf):
    return rounded(st.complete_linkage(ve.centroid_pairs(centroids(spark, sf), "c_label", "c")))


ODD = "CASE WHEN vec_id % 5 = 0 AND (k - 1) % 4 = 1 AND k < 12 THEN 0.0 WHEN vec_id % 7 = 0 AND (k - 1) % 4 = 2 THEN 100 * v[k] WHEN vec_id % 11 = 0 AND k = 4 THEN 'inf'::DOUBLE WHEN vec_id % 13 = 0 AND k = 1 THEN 'nan'::DOUBLE ELSE 10 * v[k] END"
NORM = [f"sqrt(a[{1 + c}] * a[{1 + c}] + a[{5 + c}] * a[{5 + c}] + a[{9 + c}] * a[{9 + c}])" for c in range(3)]
_fin = lambda x: f"isfinite({x})"
_clip = lambda x: f"least(greatest({x}, {st.SPACING_LOW}), {st.SPACING_HIGH})"


def _fresh(r: int, c: int) -> str:
    if r == 3:
        return str(float(c == 3))
    if c == 3:
        return f"CASE WHEN {_fin(f'a[{4 * r + 4}]')} THEN a[{4 * r + 4}] ELSE 0 END"
    if r != c:
        return "0.0"
    b = [f"abs(a[{4 * i + c + 1}])" for i in range(3)]
    lead = f"CASE WHEN {b[0]} >= {b[1]} AND {b[0]} >= {b[2]} THEN a[{c + 1}] WHEN {b[1]} >= {b[2]} THEN a[{c + 5}] ELSE a[{c + 9}] END"
    return f"CASE WHEN {_fin(NORM[c])} AND {NORM[c]} > {st.TINY} THEN {_clip(NORM[c])} * CASE WHEN {lead} < 0 THEN -1.0 ELSE 1.0 END ELSE 1.0 END"


def _scaled(r: int, c: int) -> str:
    x = f"a[{4 * r + c + 1}]"
    return f"CASE WHEN {NORM[c]} < {st.SPACING_LOW} OR {NORM[c]} > {st.SPACING_HIGH} THEN {x} * {_clip(NORM[c])} / {NORM[c]} ELSE {x} END" if r < 3 and c < 3 else x


DET = "a[1] * (a[6] * a[11] - a[7] * a[10]) - a[2] * (a[5] * a[11] - a[7] * a[9]) + a[3] * (a[5] * a[10] - a[6] * a[9])"
_cells = lambda f: "[" + ", ".join(f(r, c) for r in range(4) for c in range(4)) + "]"


@query("affine_repair", f"WITH {E}, a AS (SELECT vec_id, list_transform(range(1, 17), lambda k: {ODD}) AS a FROM e), b AS (SELECT vec_id, CASE WHEN len(list_filter(a, lambda x: NOT isfinite(x))) > 0 OR abs({DET}) <= {st.SINGULAR} THEN {_cells(_fresh)} ELSE {_cells(_scaled)} END AS b FROM a) SELECT vec_id, i, round(b[i], 6) AS x FROM b, (SELECT unnest(range(1, 17)) AS i)")
def affine_repair(spark, sf):
    k = F.sequence(F.lit(1), F.lit(16))
    own = lambda i: F.get("v", i - 1)
    i4 = lambda i: (i - 1) % 4
    odd = F.transform(k, lambda i: F.when((F.col("vec_id") % 5 == 0) & (i4(i) == 1) & (i < 12), 0.0).when((F.col("vec_id") % 7 == 0) & (i4(i) == 2), 100 * own(i)).when((F.col("vec_id") % 11 == 0) & (i == 4), float("inf")).when((F.col("vec_id") % 13 == 0) & (i == 1), float("nan")).otherwise(10 * own(i)))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", odd.alias("a"))
    return rounded(e.select("vec_id", F.posexplode(st.repair_affine(F.col("a"))).alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("i"), "x"))


@query("shard_concat", "SELECT p_partkey, p_name, CAST(p_partkey % 4 AS INTEGER) AS shard FROM part")
def shard_concat(spark, sf):
    """Parts written as four shards and read back in order, with the check that none is missing."""
    parts, root = table(spark, sf, "part").select("p_partkey", "p_name"), new_path(spark, "shards")
    parts.withColumn("s", F.col("p_partkey") % 4).write.partitionBy("s").parquet(root)
    return rd.read_shards(spark, [f"{root}/s={i}" for i in range(4)], rows=parts.count())


@query("cached_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2")
def cached_rollup(spark, sf):
    sums = lambda: table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    cached(sums(), "rollup")
    return cached(sums(), "rollup")  # the second reads what the first has written


@query("pair_mean_stats", f"{HOPS}, p AS (SELECT hops, substr(source, 1, 1) AS kind, node, source, length(source) + length(node) AS d FROM h), f AS (SELECT hops, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, quantile_cont(d, 0.25) AS q25, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS q75 FROM p GROUP BY 1), m AS (SELECT hops, count(*) AS n_pairs, avg(m) AS pair_mean FROM (SELECT hops, node, avg(d) AS m FROM p GROUP BY 1, 2) GROUP BY 1) SELECT hops, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(q25, 6) AS q25, round(median, 6) AS median, round(q75, 6) AS q75, n_pairs, round(pair_mean, 6) AS pair_mean FROM f JOIN m USING (hops)")
def pair_mean_stats(spark, sf):
    p = walked(spark, sf).withColumn("d", (F.length("source") + F.length("node")).cast("double"))
    return rounded(rel.two_level_stats(p, ["hops"], ["node"], "d"))


@query("composite_means", """WITH a AS (SELECT 'orders' AS source, unnest([{'c': 'price', 'm': avg(o_totalprice)}, {'c': 'key', 'm': avg(o_orderkey)}]) AS x FROM orders UNION ALL SELECT 'customer', unnest([{'c': 'price', 'm': avg(c_acctbal)}, {'c': 'key', 'm': avg(c_custkey)}]) FROM customer)
 SELECT source, x.c AS "column", round(x.m, 6) AS mean, row_number() OVER (PARTITION BY source ORDER BY x.m DESC NULLS LAST, x.c) AS rank FROM a""")
def composite_means(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key"))
    c = table(spark, sf, "customer").select(F.col("c_acctbal").alias("price"), F.col("c_custkey").alias("key"))
    return rounded(rel.sorted_means({"orders": o, "customer": c}, ["price", "key"]))


@query("paired_sources", "WITH d AS (SELECT vec_id, label, coalesce(nullif(trim(CASE WHEN vec_id % 5 = 0 THEN ' ' WHEN vec_id % 5 = 1 THEN NULL ELSE 'text ' || vec_id END), ''), ' ') AS t, CASE WHEN label % 2 = 0 THEN 0 ELSE 1 END AS s FROM embeddings) SELECT vec_id, t AS text, CASE s WHEN 0 THEN 'even' ELSE 'odd' END AS source, row_number() OVER (ORDER BY s, vec_id) - 1 AS ordinal FROM d")
def paired_sources(spark, sf):
    e = table(spark, sf, "embeddings")
    t = F.when(F.col("vec_id") % 5 == 0, " ").when(F.col("vec_id") % 5 != 1, F.concat(F.lit("text "), F.col("vec_id").cast("string")))
    named = {name: (e.where(F.col("label") % 2 == i).select("vec_id"), e.where(F.col("label") % 2 == i).select("vec_id", t.alias("text"))) for i, name in ((0, "even"), (1, "odd"))}
    return rel.paired(named, "vec_id", "text").select("vec_id", "text", "source", "ordinal")


@query("sign_ledger", "WITH x AS (SELECT o_custkey AS k, min(o_totalprice) AS a, arg_max(o_totalprice, o_orderkey) AS b FROM orders GROUP BY 1) SELECT c_custkey AS k, coalesce(sign(round(b - a, 9)) = sign(round(CASE WHEN k % 10 = 0 THEN a - b ELSE b - a END, 9)), false) AS consistent FROM customer LEFT JOIN x ON k = c_custkey WHERE c_nationkey < 5")
def sign_ledger(spark, sf):
    x = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("a"), F.max_by("o_totalprice", "o_orderkey").alias("b"))
    x = x.withColumn("delta", F.when(F.col("k") % 10 == 0, F.col("a") - F.col("b")).otherwise(F.col("b") - F.col("a")))
    return rel.sign_ledger(x, table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("k")), "k", "a", "b", "delta").select("k", "consistent")


@query("gather_missing", "WITH w AS (SELECT c_custkey AS k FROM customer), h AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT (SELECT count(*) FROM w JOIN h USING (k)) AS n_found, (SELECT count(*) FROM w WHERE k NOT IN (SELECT k FROM h)) AS n_missing")
def gather_missing(spark, sf):
    found, missing = rel.gathered(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct(), ["k"])
    return found.agg(F.count("*").alias("n_found")).crossJoin(missing)  # one row each


@query("range_gate", "SELECT count(*) AS n_rows, count(CASE WHEN turn < 0 OR turn >= 1000000 OR turn IS NULL THEN 1 END) AS outside, count(CASE WHEN role IS NULL THEN 1 END) AS no_role, count(*) - count(DISTINCT (conv_id, turn)) AS repeats FROM conversations")
def range_gate(spark, sf):
    c = table(spark, sf, "conversations")
    again = c.groupBy("conv_id", "turn").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeats"))
    return rel.profile(rel.require(c, {"outside": rel.in_range(F.col("turn"), 10**6)}), {"outside": rel.in_range(F.col("turn"), 10**6), "no_role": F.col("role").isNull()}, ["conv_id", "turn", "role", "text"]).crossJoin(again)  # one row each


@query("code_sector_override", "SELECT p_partkey, CASE WHEN round(c, 2) = 250.25 THEN 'special' WHEN c >= 0 AND c < 250 THEN 'low' WHEN c >= 250 AND c < 500 THEN 'middle' ELSE 'Other' END AS sector FROM (SELECT p_partkey, (p_partkey % 2400) / 4.0 AS c FROM part)")
def code_sector_override(spark, sf):
    code = ((F.col("p_partkey") % 2400) / 4.0).cast("string")
    return table(spark, sf, "part").select("p_partkey", phenotype.sector(code, [(0, 250, "low"), (250, 500, "middle")], overrides={250.25: "special"}).alias("sector"))


@query("even_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), w AS (SELECT DISTINCT CAST(floor(i * (n - 1) / 24) AS BIGINT) AS k FROM (SELECT unnest(range(0, 25)) AS i), (SELECT count(*) AS n FROM orders)) SELECT o_orderkey FROM r JOIN w USING (k)")
def even_sample(spark, sf):
    return rel.evenly_spaced(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 25).select("o_orderkey")


@query("validation_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha1('v' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= round_even(n * 0.05, 0) THEN 'val' ELSE 'train' END AS part FROM r")
def validation_split(spark, sf):
    return rel.share_split(table(spark, sf, "documents").select("doc_id"), "doc_id", {"val": 0.05, "train": 0.95}, "v")


@query("few_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha1('f' || doc_id), doc_id) AS r FROM documents) WHERE r <= 12")
def few_rows(spark, sf):
    """Twelve rows in hash order, as worked examples."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.orderBy(rel.hash_order("doc_id", "f"), "doc_id").limit(12)


@query("unsigned_topk", f"WITH {E}, {N}, c AS (SELECT label AS c_label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS m FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label), m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(v[i]) AS x FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY i)), d AS (SELECT vec_id, list_transform(list_zip(v, m), lambda z: z[1] - z[2]) AS d FROM n, m), k AS (SELECT vec_id, list_transform(d, lambda x: x / greatest(sqrt(list_inner_product(d, d)), 1e-9)) AS k FROM d), x AS (SELECT c_label, vec_id, round(list_inner_product(c, k), 9) AS a FROM c, k), r AS (SELECT *, row_number() OVER (PARTITION BY c_label ORDER BY a DESC, vec_id) AS rank, row_number() OVER (PARTITION BY c_label ORDER BY abs(a) DESC, vec_id) AS abs_rank FROM x) SELECT c_label, vec_id, round(a, 6) AS alignment, rank, abs_rank FROM r WHERE rank <= 10 OR abs_rank <= 10")
def unsigned_topk(spark, sf):
    """The best by value whatever its sign, and by size alone."""
    from pyspark.sql import Window

    a = aligned(spark, sf).select("c_label", "vec_id", F.round("a", 9).alias("a"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("c_label").orderBy(*by)).cast("bigint")
    r = a.withColumn("rank", rank(F.col("a").desc(), "vec_id")).withColumn("abs_rank", rank(F.abs("a").desc(), "vec_id"))
    return rounded(r.where("rank <= 10 or abs_rank <= 10").select("c_label", "vec_id", F.col("a").alias("alignment"), "rank", "abs_rank"))


@query("concept_importance", f"WITH {E}, s AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) + 1e-8 AS s FROM e, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), w AS (SELECT i, (avg(CASE WHEN label = 0 THEN (v[i] - m) / s END) - avg(CASE WHEN label <> 0 THEN (v[i] - m) / s END)) / any_value(s) AS w FROM e JOIN s ON true GROUP BY i) SELECT vec_id, round(sum(v[i] * w), 6) AS importance FROM e, w GROUP BY 1")
def concept_importance(spark, sf):
    """Concepts weighed by the difference of the classes' mean z-scores, in raw space."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(probes.importance(e, "v", F.col("label") == 0).select("vec_id", "importance"))


@query("anchor_phrases", f"""WITH {E}, {N}, t AS (SELECT vec_id, label, lower((['widget', 'no widget', 'steel bolt', 'bolt', 'ring seen', 'free of ring'])[1 + vec_id % 6] || ' ' || label) AS s FROM n), a AS (SELECT unnest(['widget', 'bolt', 'ring', 'zzz']) AS term), h AS (SELECT term, vec_id, s, label, row_number() OVER (PARTITION BY term ORDER BY regexp_matches(s, '\\b(no|without|negative|absent|absence|not|unremarkable|resolved|ruled out|free of)\\b'), length(s), vec_id) AS r FROM a JOIN t ON contains(s, term)),
 c AS (SELECT term, h.vec_id AS anchor, h.label AS family, h.s AS anchor_s, b.vec_id, t.s, t.label, round(list_inner_product(q.v, b.v), 9) AS score FROM h JOIN n q ON q.vec_id = h.vec_id, n b JOIN t ON t.vec_id = b.vec_id WHERE r = 1 AND b.vec_id <> h.vec_id AND t.s <> h.s),
 d AS (SELECT *, row_number() OVER (PARTITION BY term, s ORDER BY score DESC, vec_id) AS k FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, vec_id) AS z FROM d WHERE k = 1) SELECT term, anchor, count(*) AS n, round(avg(CASE WHEN label = family THEN 1.0 ELSE 0 END), 6) AS same_family FROM f WHERE z <= 8 GROUP BY 1, 2""")
def anchor_phrases(spark, sf):
    """Nearest concepts of the shortest affirmative phrase that holds a term; one for each text."""
    texts = F.array(*map(F.lit, ["widget", "no widget", "steel bolt", "bolt", "ring seen", "free of ring"]))
    u = unit(spark, sf).withColumn("s", F.lower(F.concat_ws(" ", F.get(texts, (F.col("vec_id") % 6).cast("int")), F.col("label").cast("string"))))
    return rounded(ve.anchors(u, ["widget", "bolt", "ring", "zzz"], 8))


@query("rerank_exact", f"WITH {E}, {N}, c AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v[1:16], b.v[1:16]), 9) DESC, b.vec_id) AS r, list_inner_product(q.v, b.v) AS s FROM n q, n b), d AS (SELECT query_id, bank_id, round(sqrt(greatest(0, 2 - 2 * s)), 6) AS distance FROM c WHERE r <= 11 AND query_id <> bank_id), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS place FROM d) SELECT query_id, bank_id, distance, place FROM p WHERE place <= 3")
def rerank_exact(spark, sf):
    """Candidates by a quarter of the dimensions, themselves left out, then by exact distance."""
    u = unit(spark, sf)
    short = u.select("vec_id", F.slice("v", 1, 16).alias("v"))
    near = ve.top_k(short.withColumnRenamed("vec_id", "query_id"), short.withColumnRenamed("vec_id", "bank_id"), 11)
    return ve.rerank(near, u.select("vec_id", "v"), 3)


@query("barycentric_places", f"WITH {E}, {N} SELECT vec_id FROM n WHERE vec_id % 2 = 1")
def barycentric_places(spark, sf):
    """Odd vectors placed among their even neighbours; that every one gets a place is what SQL can say."""
    u = unit(spark, sf)
    odd, even = u.where("vec_id % 2 = 1"), u.where("vec_id % 2 = 0")
    near = ve.top_k(odd.select(F.col("vec_id").alias("query_id"), "v"), even.select(F.col("vec_id").alias("bank_id"), "v"), 6, "l2")
    near = near.select("query_id", "bank_id", F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))).alias("distance"))
    places = even.select(F.col("vec_id").alias("bank_id"), F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y"))
    return st.barycentre(near, places).where("x is not null and y is not null and not isnan(x)").select(F.col("query_id").alias("vec_id"))


AGREE = "q AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT a, sum(n) AS na FROM q GROUP BY 1), b AS (SELECT b, sum(n) AS nb FROM q GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM q)"


@query("mutual_information", f"""WITH {AGREE}, mi AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS mi FROM q JOIN a USING (a) JOIN b USING (b), t), ha AS (SELECT -sum(na / t * ln(na / t)) AS ha FROM a, t), hb AS (SELECT -sum(nb / t * ln(nb / t)) AS hb FROM b, t),
 x AS (SELECT na, nb, t, unnest(range(greatest(1, CAST(na + nb - t AS BIGINT)), CAST(least(na, nb) AS BIGINT) + 1)) AS k FROM a, b, t),
 e AS (SELECT sum(k / t * ln(t * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(t - na + 1) + lgamma(t - nb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(t - na - nb + k + 1))) AS e FROM x)
 SELECT round(mi, 6) AS mi, round(e, 6) AS expected, round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM mi, ha, hb, e""")
def mutual_information(spark, sf):
    return rounded(probes.adjusted_mutual_information(table(spark, sf, "embeddings").withColumn("cluster", F.col("vec_id") % 7), "label", "cluster"))


@query("random_control", """WITH g AS (SELECT vec_id, label, list_transform(range(0, 8), lambda j: sqrt(-2 * ln((1 + CAST('0x' || substr(md5('r:' || vec_id || ':' || j), 1, 8) AS BIGINT)) / 4294967297.0)) * cos(2 * pi() * CAST('0x' || substr(md5('r:' || vec_id || ':' || j), 9, 8) AS BIGINT) / 4294967296.0)) AS g FROM embeddings), n AS (SELECT vec_id, label, list_transform(g, lambda x: x / greatest(sqrt(list_inner_product(g, g)), 1e-9)) AS v FROM g),
 s AS (SELECT a.vec_id, a.label, b.label AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS r FROM n a, n b WHERE a.vec_id <> b.vec_id), p AS (SELECT label, avg(CASE WHEN label = other THEN 1.0 ELSE 0.0 END) AS p FROM s WHERE r <= 5 GROUP BY label) SELECT round(avg(p), 6) AS macro_purity, round(1.0 / count(*), 6) AS chance FROM p""")
def random_control(spark, sf):
    """Purity of random vectors under the real labels, beside what chance gives."""
    r = probes.random_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", 8, "r")
    return rounded(ve.neighbour_purity(r, 5).agg(F.avg("purity").alias("macro_purity"), (1.0 / F.count("*")).alias("chance")))


SETS = "t AS (SELECT p_partkey, p_brand, CASE WHEN p_name LIKE '%widget%' THEN 'direct' WHEN p_name LIKE '%ring%' THEN 'associated' END AS tier, p_size AS score FROM part), o AS (SELECT p_brand, p_partkey, 'original' AS kind, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM t), d AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, tier, p_partkey) AS r FROM t WHERE tier IS NOT NULL), e AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS r FROM t WHERE tier = 'direct')"


@query("concept_sets", f"WITH {SETS} SELECT p_brand AS label, p_partkey AS concept, kind AS method, r AS place FROM o WHERE r <= 5 UNION ALL SELECT p_brand, p_partkey, 'trusted', r FROM d WHERE r <= 8 UNION ALL SELECT p_brand, p_partkey, 'direct', r FROM e WHERE r <= 8")
def concept_sets(spark, sf):
    tier = F.when(F.contains("p_name", F.lit("widget")), "direct").when(F.contains("p_name", F.lit("ring")), "associated")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("concept"), tier.alias("tier"), F.col("p_size").alias("score"))
    return probes.concept_sets(p, top=5, most=8)


@query("multilabel_probe")
def multilabel_probe(spark, sf):
    """Held-out macro AUROC of one linear head for all labels, stopped early."""
    u = unit(spark, sf).select("vec_id", "v", "label")
    return rounded(probes.multilabel(u, "vec_id", "v", "label", [0, 1, 2, 3]), 3)


@query("bottleneck_probe")
def bottleneck_probe(spark, sf):
    """A logistic probe on similarities to the label centroids."""
    z = probes.bottleneck(unit(spark, sf), centroids(spark, sf).select(F.col("c_label").alias("concept"), "c"), "v", "c").withColumn("y", (F.col("label") == 0).cast("int"))
    return rounded(ml.probe(ml.standardize(z, "s", "z"), "z"), 3).select("intercept", F.size("coefficients").alias("n"))


@query("probe_bootstrap")
def probe_bootstrap(spark, sf):
    """Share of resampled probes whose coefficient has the sign of the plain one, by dimension."""
    z = ml.standardize(unit(spark, sf), "v", "z").withColumn("y", (F.col("label") == 0).cast("int"))
    return rounded(probes.bootstrap_signs(z, "vec_id", "z", "y", seeds=4), 3)


@query("balanced_probes")
def balanced_probes(spark, sf):
    """A class-balanced probe for each label, and the constant one of a label that no row has."""
    z = ml.standardize(unit(spark, sf), "v", "z")
    return rounded(probes.per_label(z, "z", "label", [0, 1, -5], balanced=True), 3).select("label", "intercept", F.size("coefficients").alias("n"))


@query("retry_calls", "SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN upper(p_name) END AS result, CASE WHEN p_partkey % 5 >= 3 THEN 'TimeoutError: attempt 3' END AS error, CAST(least(p_partkey % 5 + 1, 3) AS INTEGER) AS attempts FROM part")
def retry_calls(spark, sf):
    """An outside service that answers a part's number of attempts late, stood in for by a function."""

    def service(text: str, attempt: int) -> str:
        key, name = text.split(" ", 1)
        if attempt <= int(key) % 5:
            raise TimeoutError(f"attempt {attempt}")
        return name.upper()

    asked = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name").alias("text"))
    return calls.call_each(asked, "p_partkey", "text", service, attempts=3, wait=0.0)


@query("clip_tokens")
def clip_tokens(spark, sf):
    """Seventy-seven ids for each document, from a public vocabulary file."""
    import public_tokenizers

    d = table(spark, sf, "documents").select("doc_id", clip.token_ids(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x > 0)).alias("used"))

"""Joins, splits, ranks and rollups over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from medlake.operators import relational as rel
from medlake.queries.common import registrar, rounded, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)


@query("semi_filter", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_filter(spark, sf):
    want = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(want, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("resume_antijoin", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


JOINED = "j AS (SELECT d.doc_id, l.quality, l.toxic, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.n_chars END AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("dropna_any_all", f"WITH {JOINED} SELECT count(*) AS n_rows, count(CASE WHEN quality IS NOT NULL AND n IS NOT NULL THEN 1 END) AS n_any, count(CASE WHEN quality IS NOT NULL OR n IS NOT NULL THEN 1 END) AS n_all FROM j")
def dropna_any_all(spark, sf):
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("n", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")))
    cols = ["quality", "n"]
    tagged = rel.union_tagged({"n_rows": j, "n_any": j.dropna("any", subset=cols), "n_all": j.dropna("all", subset=cols)}, "part")
    return tagged.groupBy().pivot("part", ["n_rows", "n_any", "n_all"]).count()


@query("map_recode", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction' WHEN 'MACHINERY' THEN 'Industry' ELSE 'Other' END AS segment, upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS title FROM customer")
def map_recode(spark, sf):
    from medlake.functions.text import recode, sentence_case

    return table(spark, sf, "customer").select("c_custkey", recode(F.col("c_mktsegment"), {"BUILDING": "Construction", "MACHINERY": "Industry"}, "Other").alias("segment"), sentence_case(F.lower("c_mktsegment")).alias("title"))


@query("key_parse", r"SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number, split_part(c_name, '#', 1) AS prefix, TRY_CAST(nullif(split_part(c_name, '#', 3), '') AS BIGINT) AS third FROM customer")
def key_parse(spark, sf):
    parts = F.split("c_name", "#")
    third = F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(""))
    return table(spark, sf, "customer").select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("bigint").alias("number"), F.try_element_at(parts, F.lit(1)).alias("prefix"), third.try_cast("bigint").alias("third"))


@query("truncate_by_ordinal", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS h FROM documents) WHERE h < 20")
def truncate_by_ordinal(spark, sf):
    return rel.keep_top(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [F.col("doc_id")], 20)


@query("range_check", "SELECT count(*) AS n_rows, count(CASE WHEN l_linenumber < 1 OR l_linenumber > 7 THEN 1 END) AS out_of_range, count(CASE WHEN l_discount IS NULL THEN 1 END) AS missing FROM lineitem")
def range_check(spark, sf):
    return rel.profile(table(spark, sf, "lineitem"), {"out_of_range": ~F.col("l_linenumber").between(1, 7), "missing": F.col("l_discount").isNull()})


@query("profile_checks", "SELECT count(*) AS n_rows, count(CASE WHEN value = 0 THEN 1 END) AS zero, count(CASE WHEN isnan(value) THEN 1 END) AS nans, count(CASE WHEN isinf(value) THEN 1 END) AS infs, count(CASE WHEN props IS NULL OR props = '' THEN 1 END) AS blank, count(CASE WHEN value < 0 OR value > 100 THEN 1 END) AS outside FROM events")
def profile_checks(spark, sf):
    v = F.col("value")
    return rel.profile(table(spark, sf, "events"), {"zero": v == 0, "nans": F.isnan(v), "infs": F.abs(v) == float("inf"), "blank": F.col("props").isNull() | (F.col("props") == ""), "outside": (v < 0) | (v > 100)})


@query("level1_means", "SELECT p_brand, round(avg(CASE WHEN p_size % 10 = 0 THEN p_retailprice END), 6) AS level1, round(avg(p_retailprice), 6) AS every FROM part GROUP BY p_brand")
def level1_means(spark, sf):
    code = F.when(F.col("p_size") % 10 == 0, (F.col("p_size") / 10).cast("int").cast("string")).otherwise(F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), F.col("p_size") % 10))
    p = table(spark, sf, "part").withColumn("code", code)
    return rounded(p.groupBy("p_brand").agg(F.avg(F.when(~F.contains("code", F.lit(".")), F.col("p_retailprice"))).alias("level1"), F.avg("p_retailprice").alias("every")))


@query("join_left_attach", "SELECT o.o_orderkey, c.c_nationkey FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON o.o_custkey = c.c_custkey")
def join_left_attach(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return rel.left_unique(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], [F.col("c_nationkey")]).select("o_orderkey", "c_nationkey")


@query("join_inner_dim", "SELECT l_returnflag, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (5, 15) GROUP BY ALL")
def join_inner_dim(spark, sf):
    p = table(spark, sf, "part").where(F.col("p_size").isin(5, 15)).select("p_partkey", "p_brand")
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return li.join(p, "p_partkey").groupBy("l_returnflag", "p_brand").agg(F.count("*").alias("n"))


@query("join_dedup_left", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM customer JOIN orders ON c_custkey = o_custkey) WHERE r = 1")
def join_dedup_left(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey")
    return rel.left_unique(c, o, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).dropna(subset=["o_orderkey"]).select("c_custkey", "o_orderkey", "o_totalprice")


@query("join_two_hop", "SELECT l.l_orderkey, l.l_linenumber, c.c_mktsegment FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey AND o_orderstatus = 'F' LEFT JOIN customer c ON o_custkey = c_custkey WHERE l_quantity > 45")
def join_two_hop(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return li.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").select("l_orderkey", "l_linenumber", "c_mktsegment")


@query("join_star_left", "SELECT r_name, n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def join_star_left(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    star = n.join(r, "n_regionkey", "left").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return star.select("r_name", "n_name", *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("customers", "suppliers")))


@query("join_orphans", "SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_mktsegment <> 'MACHINERY') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k GROUP BY 1")
def join_orphans(spark, sf):
    return rel.orphans(table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("join_replicate", "SELECT o_orderpriority, c_mktsegment, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_replicate(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").join(c, "o_custkey", "left").groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("n"))


@query("join_one_to_one", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def join_one_to_one(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(rel.keep_one(table(spark, sf, "labels"), ["doc_id"], [F.col("quality")]), "doc_id").select("doc_id", "quality")


@query("assert_complete", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_missing, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS n_duplicate")
def assert_complete(spark, sf):
    return rel.completeness(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])


@query("gather_split", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT vec_id FROM embeddings) AND source IS NOT NULL")
def gather_split(spark, sf):
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", "lang")
    return d.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")


@query("join_with_drift_gate", "SELECT CASE WHEN b IS NULL THEN 'missing' WHEN abs(a - b) > 0.02 * greatest(abs(a), 1e-12) THEN 'drift' ELSE 'ok' END AS outcome, count(*) AS n FROM (SELECT p_partkey, p_retailprice AS a, q.b FROM part LEFT JOIN (SELECT l_partkey, min(l_extendedprice / l_quantity) AS b FROM lineitem GROUP BY 1) q ON l_partkey = p_partkey) GROUP BY 1")
def join_with_drift_gate(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("b"))
    return rel.drift_gate(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a")), q, ["p_partkey"], "a", "b", 0.02)


@query("source_membership", "SELECT members, count(*) AS n FROM (SELECT key, string_agg(name, '+' ORDER BY name) AS members FROM (SELECT DISTINCT c_custkey AS key, 'customer' AS name FROM customer UNION SELECT DISTINCT o_custkey, 'orders' FROM orders UNION SELECT DISTINCT user_id, 'events' FROM events) GROUP BY key) GROUP BY 1")
def source_membership(spark, sf):
    named = {"customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "events": table(spark, sf, "events").select(F.col("user_id").alias("k"))}
    return rel.membership(named, "k").groupBy("members").agg(F.count("*").alias("n"))


@query("union_tagged", "SELECT origin, count(*) AS n, round(sum(bal), 2) AS total FROM (SELECT 'customer' AS origin, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier) GROUP BY 1")
def union_tagged(spark, sf):
    named = {"customer": table(spark, sf, "customer").select(F.col("c_acctbal").alias("bal")), "supplier": table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"))}
    return rel.union_tagged(named, "origin").groupBy("origin").agg(F.count("*").alias("n"), F.round(F.sum("bal"), 2).alias("total"))


@query("keep_last_per_key", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def keep_last_per_key(spark, sf):
    return rel.keep_one(table(spark, sf, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "value")


@query("provenance_bits", "SELECT user_id, bit_or(CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 4 END) AS bits FROM events GROUP BY 1")
def provenance_bits(spark, sf):
    bit = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).otherwise(4)
    return table(spark, sf, "events").groupBy("user_id").agg(F.bit_or(bit).alias("bits"))


CUST = "g AS (SELECT o_custkey AS k, count(*) AS size FROM orders GROUP BY 1)"


@query("greedy_budget_split", f"WITH {CUST}, r AS (SELECT k, size, sum(size) OVER (ORDER BY size, k ROWS UNBOUNDED PRECEDING) AS running FROM g) SELECT k, size, CAST(running AS BIGINT) AS running, running <= 550 OR running - size < 400 AS accepted FROM r")
def greedy_budget_split(spark, sf):
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("size"))
    return rel.greedy_budget(g, "size", "k", 500, 50, 100).select("k", "size", "running", "accepted")


@query("group_ratio_split", "WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha1('7' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT c_custkey, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.85, 0) THEN 'val' ELSE 'test' END AS part FROM r")
def group_ratio_split(spark, sf):
    return rel.share_split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", {"train": 0.7, "val": 0.15, "test": 0.15}, "7")


@query("stratified_split", "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('s' || c_custkey), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, CASE WHEN r <= greatest(round_even(n * 0.2, 0), 1) THEN 'test' ELSE 'train' END AS part FROM r")
def stratified_split(spark, sf):
    return rel.share_split(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", {"test": 0.2, "train": 0.8}, "s", by=["c_mktsegment"], least=1)


@query("split_leak_check", "SELECT o_custkey, count(DISTINCT o_orderkey % 2) AS n_parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 2) > 1")
def split_leak_check(spark, sf):
    return rel.split_leaks(table(spark, sf, "orders").withColumn("part", F.col("o_orderkey") % 2), "o_custkey", "part")


@query("balanced_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('b' || doc_id), doc_id) AS r FROM documents) WHERE r <= 25")
def balanced_sample(spark, sf):
    return rel.sample_each(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 25, "b")


@query("rollup_any_first", "SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS any_returned, arg_min(CASE WHEN l_linestatus = 'O' THEN l_suppkey END, l_linenumber * 1000000 + l_suppkey) FILTER (l_linestatus = 'O') AS first_open FROM lineitem GROUP BY 1")
def rollup_any_first(spark, sf):
    open_ = F.col("l_linestatus") == "O"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("any_returned"), F.min_by(F.when(open_, F.col("l_suppkey")), F.when(open_, F.col("l_linenumber") * 1000000 + F.col("l_suppkey"))).alias("first_open"))


@query("group_size_stats", f"WITH {CUST} SELECT count(*) AS groups, min(size) AS least, max(size) AS most, round(avg(size), 6) AS mean FROM g")
def group_size_stats(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return rounded(g.agg(F.count("*").alias("groups"), F.min("size").alias("least"), F.max("size").alias("most"), F.avg("size").alias("mean")))


@query("family_support", "SELECT p_brand AS family, count(*) AS occurrences, count(DISTINCT l_orderkey) AS reports, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS in_r, count(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS in_other FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(CASE WHEN l_returnflag = 'R' THEN 1 END) >= 20 AND count(CASE WHEN l_returnflag <> 'R' THEN 1 END) >= 20")
def family_support(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("family"))
    r = F.col("l_returnflag") == "R"
    j = table(spark, sf, "lineitem").join(p, "l_partkey")
    return j.groupBy("family").agg(F.count("*").alias("occurrences"), F.count_distinct("l_orderkey").alias("reports"), F.count_if(r).alias("in_r"), F.count_if(~r).alias("in_other")).where("in_r >= 20 and in_other >= 20")


@query("category_share", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM events GROUP BY 1")
def category_share(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return rounded(n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))


@query("banded_weighted_sum", "SELECT l_orderkey, round(sum((CASE WHEN l_quantity < 13 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 30 THEN 2 WHEN l_quantity < 40 THEN 3 ELSE 4 END) * l_discount), 6) AS score, max(CASE WHEN l_quantity >= 13 THEN 1 ELSE 0 END) AS present FROM lineitem GROUP BY 1")
def banded_weighted_sum(spark, sf):
    from medlake.functions.measures import band

    w = band(F.col("l_quantity"), [13, 20, 30, 40])
    return rounded(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(w * F.col("l_discount")).alias("score"), F.max((w > 0).cast("int")).alias("present")))


@query("majority_theme", "SELECT l_suppkey, theme FROM (SELECT l_suppkey, l_returnflag AS theme, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, min(l_orderkey * 10 + l_linenumber)) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def majority_theme(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("theme")).agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return rel.keep_one(n, ["l_suppkey"], [F.col("n").desc(), F.col("first")]).select("l_suppkey", "theme")


TOP = "t AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_extendedprice) DESC, l_partkey) AS r FROM lineitem GROUP BY 1, 2)"


@query("retention_summary", f"WITH {TOP}, k AS (SELECT l_suppkey, count(CASE WHEN l_partkey % 3 = 0 THEN 1 END) AS kept FROM t WHERE r <= 10 GROUP BY 1) SELECT CASE WHEN kept = 0 THEN 'none' WHEN kept = 10 THEN 'all' ELSE 'partial' END AS state, count(*) AS labels, CAST(sum(kept) AS BIGINT) AS kept FROM k GROUP BY 1")
def retention_summary(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    k = rel.keep_top(g, ["l_suppkey"], [F.col("v").desc(), F.col("l_partkey")], 10).groupBy("l_suppkey").agg(F.count_if(F.col("l_partkey") % 3 == 0).alias("kept"))
    return k.groupBy(F.when(F.col("kept") == 0, "none").when(F.col("kept") == 10, "all").otherwise("partial").alias("state")).agg(F.count("*").alias("labels"), F.sum("kept").alias("kept"))


@query("topk_overlap", f"WITH {TOP} SELECT l_suppkey, l_partkey, count(*) OVER (PARTITION BY l_partkey) AS n_labels FROM t WHERE r = 1")
def topk_overlap(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return rel.shared_top(g, "l_suppkey", "l_partkey", [F.col("v").desc(), F.col("l_partkey")])


@query("pivot_matrix", "SELECT o_orderpriority, arg_max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, o_orderkey) FILTER (o_orderstatus = 'F') AS f, arg_max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END, o_orderkey) FILTER (o_orderstatus = 'O') AS o, arg_max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END, o_orderkey) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_matrix(spark, sf):
    o = table(spark, sf, "orders").withColumn("s", F.lower("o_orderstatus"))
    return o.groupBy("o_orderpriority").pivot("s", ["f", "o", "p"]).agg(F.max_by("o_totalprice", "o_orderkey"))


@query("argmax_per_group", "SELECT o_orderpriority, arg_max(o_orderkey, o_totalprice) AS best, max(o_totalprice) AS value FROM orders GROUP BY 1")
def argmax_per_group(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", "o_totalprice").alias("best"), F.max("o_totalprice").alias("value"))


@query("method_rollup", "SELECT l_returnflag AS method, count(*) AS n, round(avg(l_discount), 6) AS mean, round(median(l_quantity), 6) AS median_n FROM lineitem GROUP BY 1")
def method_rollup(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"), F.median("l_quantity").alias("median_n")))


WIN = "w AS (SELECT l_partkey, avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS a, avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS b FROM lineitem GROUP BY 1)"


@query("winrate_by_group", f"WITH {WIN}, x AS (SELECT p_brand AS g, a, b FROM w JOIN part ON l_partkey = p_partkey WHERE a IS NOT NULL AND b IS NOT NULL) SELECT g, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(CASE WHEN round(a - b, 9) > 0 THEN 1 END) AS wins, round(count(CASE WHEN round(a - b, 9) > 0 THEN 1 END) / count(*), 6) AS win_rate FROM x GROUP BY 1")
def winrate_by_group(spark, sf):
    side = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_tax")))
    w = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(side("O").alias("a"), side("F").alias("b")).dropna()
    x = w.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("g")), "p_partkey")
    win = F.round(F.col("a") - F.col("b"), 9) > 0
    return rounded(x.groupBy("g").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count_if(win).alias("wins"), F.avg(win.cast("int")).alias("win_rate")))


@query("rank_by_delta", "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name, c_custkey) AS rank FROM customer")
def rank_by_delta(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_name", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.row_number().over(w).cast("bigint").alias("rank"))


@query("balanced_extremes", "WITH r AS (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS t, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS b FROM customer) SELECT c_mktsegment, c_custkey, c_acctbal, CASE WHEN t <= 4 THEN 'head' ELSE 'tail' END AS side FROM r WHERE t <= 4 OR b <= 4")
def balanced_extremes(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    top = lambda o: rel.keep_top(c, ["c_mktsegment"], [o, F.col("c_custkey")], 4)
    return rel.union_tagged({"head": top(F.col("c_acctbal").desc()), "tail": top(F.col("c_acctbal"))}, "side")


@query("nested_topn", "WITH o AS (SELECT c_custkey, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1 ORDER BY total DESC, c_custkey LIMIT 10), i AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS item FROM orders WHERE o_custkey IN (SELECT c_custkey FROM o)) SELECT o_custkey, o_orderkey, item FROM i WHERE item <= 3")
def nested_topn(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").join(c, "o_custkey", "left_semi")
    best = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).orderBy(F.col("total").desc(), "o_custkey").limit(10)
    return rel.keep_top(o.join(best, "o_custkey", "left_semi"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, "item").select("o_custkey", "o_orderkey", F.col("item").cast("bigint").alias("item"))


@query("selection_gate", "WITH g AS (SELECT l_suppkey, avg(l_discount) AS metric, bool_and(l_tax >= 0) AS all_ok, count(DISTINCT l_returnflag) AS families, arg_max(l_shipdate, l_orderkey * 10 + l_linenumber) AS latest, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n_match FROM lineitem GROUP BY 1) SELECT l_suppkey, round(metric, 6) AS metric, families FROM g WHERE metric >= 0.049 AND all_ok AND families >= 3 AND n_match >= 5")
def selection_gate(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("metric"), F.collect_list("l_tax").alias("seeds"), F.count_distinct("l_returnflag").alias("families"), F.count_if(F.col("l_returnflag").rlike("^N$")).alias("n_match"))
    return rounded(g.where("metric >= 0.049 and families >= 3 and n_match >= 5").where(F.forall("seeds", lambda x: x >= 0)).select("l_suppkey", "metric", "families"))


@query("pick_canonical", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice <= 1000 THEN 9999999 ELSE o_totalprice END, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1")
def pick_canonical(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    cost = F.when(F.col("o_totalprice") <= 1000, 9999999.0).otherwise(F.col("o_totalprice"))
    return rel.keep_one(o, ["o_custkey"], [cost, F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("runs_islands", "WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS length FROM r GROUP BY 1, 2")
def runs_islands(spark, sf):
    return rel.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("ordered_within_group", "WITH m AS (SELECT p_brand, p_partkey, p_retailprice, avg(p_retailprice) OVER (PARTITION BY p_brand) AS gm FROM part) SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS place, CAST(dense_rank() OVER (ORDER BY round(gm, 6), p_brand) AS BIGINT) AS group_place FROM m")
def ordered_within_group(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    g = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("gm"))
    g = g.select("p_brand", F.row_number().over(Window.orderBy(F.round("gm", 6), "p_brand")).cast("bigint").alias("group_place"))  # one row for a brand
    return p.join(g, "p_brand").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).cast("bigint").alias("place"), "group_place")


@query("quantile_box_purity", "WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.25) AS lo, quantile_cont(c_acctbal, 0.75) AS hi FROM customer GROUP BY 1) SELECT g, count(*) AS inside, round(avg(CASE WHEN c_mktsegment = g THEN 1.0 ELSE 0.0 END), 6) AS purity FROM q JOIN customer ON c_acctbal BETWEEN lo AND hi GROUP BY 1")
def quantile_box_purity(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal")
    q = c.groupBy(F.col("c_mktsegment").alias("g")).agg(F.percentile("c_acctbal", F.lit(0.25)).alias("lo"), F.percentile("c_acctbal", F.lit(0.75)).alias("hi"))
    inside = c.join(F.broadcast(q), F.col("c_acctbal").between(F.col("lo"), F.col("hi")))  # one box for a segment
    return rounded(inside.groupBy("g").agg(F.count("*").alias("inside"), F.avg((F.col("g") == F.col("c_mktsegment")).cast("double")).alias("purity")))

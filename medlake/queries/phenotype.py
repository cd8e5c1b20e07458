"""Events stand in for coded records: a user's first purchase is the anchor, event types are codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from medlake.functions import measures as ms
from medlake.functions import text as tx
from medlake.operators import phenotype as ph
from medlake.queries.common import registrar, rounded, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

A = "a AS (SELECT user_id, min(event_id) AS key, min(ts) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1)"


def anchors(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("key"), F.min("ts").alias("at"))


def labels(spark, sf, **window):
    return ph.window_labels(anchors(spark, sf), table(spark, sf, "events"), "user_id", "key", "at", "ts", "event_type", **window)


@query("label_same_group", f"WITH {A} SELECT DISTINCT key, event_type FROM a JOIN events e ON a.user_id = e.user_id AND CAST(e.ts AS DATE) = CAST(a.at AS DATE)")
def label_same_group(spark, sf):
    a = anchors(spark, sf).select("user_id", "key", F.to_date("at").alias("visit"))
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("visit"), "event_type")
    return a.join(e, ["user_id", "visit"]).select("key", "event_type").distinct()


@query("label_prior_all", f"WITH {A} SELECT DISTINCT key, event_type FROM a JOIN events e ON a.user_id = e.user_id AND e.ts <= a.at")
def label_prior_all(spark, sf):
    return labels(spark, sf)


W = f"{A}, w AS (SELECT DISTINCT key, event_type FROM a JOIN events e ON a.user_id = e.user_id AND e.ts BETWEEN a.at - INTERVAL 10 DAY AND a.at + INTERVAL 1 DAY)"
SPAN = {"before": "INTERVAL '10' DAY", "after": "INTERVAL '1' DAY"}


@query("label_prior_window", f"WITH {W} SELECT * FROM w")
def label_prior_window(spark, sf):
    return labels(spark, sf, **SPAN)


TYPES = ["click", "purchase", "signup", "view", "error"]


@query("multi_hot_pivot", f"WITH {W} SELECT a.key, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END) AS INTEGER) AS {t}" for t in TYPES) + " FROM a LEFT JOIN w ON a.key = w.key GROUP BY 1")
def multi_hot_pivot(spark, sf):
    return ph.multi_hot(anchors(spark, sf), labels(spark, sf, **SPAN), "key", "event_type", TYPES)


@query("label_prevalence", f"WITH {W} SELECT event_type, round(count(*) / (SELECT count(*) FROM a), 6) AS prevalence FROM w GROUP BY 1")
def label_prevalence(spark, sf):
    return rounded(ph.prevalence(labels(spark, sf, **SPAN), anchors(spark, sf).count(), "event_type"))


@query("id_normalize", r"SELECT o_orderkey, regexp_replace(trim(' ' || o_orderkey || '.0 '), '[.]0+$', '') AS id FROM orders")
def id_normalize(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.canonical_id(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))).alias("id"))


CODE = "(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0'))"


def coded(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")).alias("code"))


@query("code_canon", f"SELECT p_partkey, replace(upper(trim(' e' || {CODE} || ' ')), '.', '') AS code FROM part")
def code_canon(spark, sf):
    return coded(spark, sf).select("p_partkey", tx.canonical_code(F.concat(F.lit(" e"), "code", F.lit(" "))).alias("code"))


@query("code_map", f"SELECT DISTINCT code, p_brand FROM (SELECT replace({CODE}, '.', '') AS code, p_brand FROM part WHERE p_size % 7 <> 0 UNION ALL SELECT upper(p_type), p_brand FROM part WHERE p_size % 7 <> 0)")
def code_map(spark, sf):
    p = coded(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 7 == 0, "yes").otherwise("0").alias("excluded")), "p_partkey")
    return ph.code_map(p, ["code", "p_type"], "p_brand", "excluded").withColumn("code", F.col("code"))


@query("code_expand", f"""WITH c AS (SELECT p_partkey, {CODE} AS code FROM part), k AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS k FROM part WHERE p_size % 2 = 0),
 x AS (SELECT p_partkey, code, code AS expanded FROM c UNION SELECT p_partkey, code, substr(code, 1, length(code) - 1) FROM c UNION SELECT p_partkey, code, split_part(code, '.', 1) FROM c)
 SELECT p_partkey, code, expanded FROM x WHERE expanded = code OR expanded IN (SELECT k FROM k)""")
def code_expand(spark, sf):
    known = table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_size").cast("string").alias("k")).distinct()
    return ph.expand_codes(coded(spark, sf).select("p_partkey", "code"), "code", known).select("p_partkey", "code", "expanded")


@query("code_sector", f"SELECT p_partkey, CASE WHEN CAST({CODE} AS DOUBLE) < 10 THEN 'low' WHEN CAST({CODE} AS DOUBLE) < 30 THEN 'mid' ELSE 'Other' END AS sector FROM part")
def code_sector(spark, sf):
    return coded(spark, sf).select("p_partkey", ph.sector(F.col("code"), [(0, 10, "low"), (10, 30, "mid")]).alias("sector"))


@query("code_numeric_order", "SELECT code, row_number() OVER (ORDER BY coalesce(TRY_CAST(code AS DOUBLE), 1e9), code) AS place FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS code FROM part UNION SELECT DISTINCT p_brand FROM part)")
def code_numeric_order(spark, sf):
    from pyspark.sql import Window

    p = table(spark, sf, "part")
    codes = p.select(F.col("p_size").cast("string").alias("code")).union(p.select("p_brand")).distinct()
    return codes.select("code", F.row_number().over(Window.orderBy(*ph.numeric_first(F.col("code")))).cast("bigint").alias("place"))  # a code list


@query("survival_endpoint", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') <= 730 THEN 1 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 730 THEN 0 END AS y FROM orders")
def survival_endpoint(spark, sf):
    days = F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", ms.survival_endpoint((F.col("o_orderstatus") == "F").cast("int"), days).alias("y"))


@query("endpoint_binary", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 WHEN o_orderpriority IN ('5-LOW') THEN 0 END AS y, CAST(starts_with(o_orderpriority, '1') AS INTEGER) AS stage_one FROM orders")
def endpoint_binary(spark, sf):
    p = F.col("o_orderpriority")
    return table(spark, sf, "orders").select("o_orderkey", ms.endpoint(p, ["1-URGENT", "2-HIGH"], ["5-LOW"]).alias("y"), F.startswith(p, F.lit("1")).cast("int").alias("stage_one"))


LI = "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS k"


@query("resize_plan", f"WITH s AS (SELECT {LI}, l_quantity AS a, l_extendedprice / 100 AS b, least(224.0 / l_quantity, 224.0 / (l_extendedprice / 100)) AS scale FROM lineitem) SELECT k, round(scale, 6) AS scale, CAST(round_even(a * scale, 0) AS INTEGER) AS size0, CAST(round_even(b * scale, 0) AS INTEGER) AS size1, CAST(floor((224 - CAST(round_even(a * scale, 0) AS INTEGER)) / 2) AS INTEGER) AS pad0, CAST(floor((224 - CAST(round_even(b * scale, 0) AS INTEGER)) / 2) AS INTEGER) AS pad1 FROM s")
def resize_plan(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), ms.resize_plan([F.col("l_quantity"), F.col("l_extendedprice") / 100], [224, 224]).alias("p"))
    return rounded(li.select("k", "p.*"))


@query("hu_quantize", f"SELECT {LI}, CAST(floor((greatest(least(l_extendedprice / 10 - 3000, 1000), -1000) / 1000 + 1) / 2 * 255) AS INTEGER) AS byte FROM lineitem")
def hu_quantize(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), ms.hu_to_byte(F.col("l_extendedprice") / 10 - 3000).alias("byte"))


@query("band_ceiling", f"SELECT {LI}, round(least(greatest(ceil(round((0.6 + l_discount * 5) / 0.05, 9)) * 0.05, 0.7), 1.0), 6) AS band FROM lineitem")
def band_ceiling(spark, sf):
    return rounded(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), ms.band_ceiling(F.lit(0.6) + F.col("l_discount") * 5).alias("band")))


@query("box_iou", f"WITH b AS (SELECT {LI}, l_quantity AS w, l_discount * 100 AS x, greatest(least(l_quantity, l_discount * 100 + 20) - greatest(0, l_discount * 100), 0) AS ix FROM lineitem) SELECT k, round(ix * 10.0 / nullif(w * 10.0 + 20 * 20.0 - ix * 10.0, 0), 6) AS iou FROM b")
def box_iou(spark, sf):
    z, x = F.lit(0.0), F.col("l_discount") * 100
    iou = ms.box_iou((z, z, F.col("l_quantity"), F.lit(10.0)), (x, z, x + 20, F.lit(20.0)))
    return rounded(table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), iou.alias("iou")))

"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlake.llm import epsilon_join, language_id, minhash_dedup, order_minhash, packing, sentencepiece_codec, substring_dedup, token_counts, url_filter, warc
from medlake.plans.shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, fetched a day each by id over a year, against a list of dated host, path and domain entries."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("fetched_at"))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    h = hosts.withColumn("x", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    x = F.col("x")
    entry = lambda key, at, action, category: F.struct(key.alias("key"), at.alias("at"), F.lit(action).alias("action"), F.lit(category).alias("category"))
    per_host = h.select(
        F.explode(
            F.array(
                entry(F.when(x % 2 == 0, F.col("host")), day(x % 300), "add", "host"),
                entry(F.when(x % 6 == 0, F.col("host")), day(x % 300 + 1 + x % 60), "remove", "host"),
                entry(F.when(x % 5 == 0, F.concat("host", F.lit("/en"))), day(x % 200), "add", "path"),
            )
        ).alias("e")
    ).select("e.*")
    fixed = spark.createDataFrame([("example.net", 200, "add", "domain"), ("example.net", 230, "remove", "domain"), ("example.net", 300, "add", "domain")], "key string, n int, action string, category string")
    entries = per_host.union(fixed.select("key", day(F.col("n")), "action", "category"))
    return url_filter.filter_urls(pages, entries, "page_id")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(_table(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon_join.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.9)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edits(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), ["source", "lang", "text"], rule="first")


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_language_id": op3_language_id,
        "op4_url_filter": op4_url_filter,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_epsilon_join": op7_epsilon_join,
        "op8_order_minhash": op8_order_minhash,
        "op9_packing": op9_packing,
        "op10_token_counts": op10_token_counts,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS fetched_at,
         regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.+$', '') AS host,
         regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)', 1) AS seg
  FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS x FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
e AS (
  SELECT host AS key, x % 300 AS n, 'add' AS action, 'host' AS category FROM h WHERE x % 2 = 0
  UNION ALL SELECT host, x % 300 + 1 + x % 60, 'remove', 'host' FROM h WHERE x % 6 = 0
  UNION ALL SELECT host || '/en', x % 200, 'add', 'path' FROM h WHERE x % 5 = 0
  UNION ALL VALUES ('example.net', 200, 'add', 'domain'), ('example.net', 230, 'remove', 'domain'), ('example.net', 300, 'add', 'domain')),
v AS (
  SELECT key, action, category, DATE '2024-01-01' + CAST(n AS INTEGER) AS since,
         lead(DATE '2024-01-01' + CAST(n AS INTEGER)) OVER (PARTITION BY key ORDER BY n) AS until
  FROM e),
c AS (
  SELECT page_id, fetched_at, unnest(list_distinct(
           CASE WHEN host = '' THEN [] ELSE
             (CASE WHEN seg <> '' THEN [host || seg] ELSE [] END) || [host] ||
             (CASE WHEN regexp_matches(host, '^(\[.*\]|[0-9]+(\.[0-9]+){3})$') THEN [] ELSE [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FOR i IN range(1, greatest(len(string_split(host, '.')), 2))] END) END)) AS key
  FROM p),
m AS (
  SELECT page_id, fetched_at, arg_max({'key': c.key, 'category': category, 'since': since}, length(c.key)) AS m
  FROM c JOIN v ON c.key = v.key AND v.action = 'add' AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
  GROUP BY ALL)
SELECT p.page_id, p.fetched_at, m.m IS NOT NULL AS blocked, m.m.key AS matched_key, m.m.category AS category, m.m.since AS listed_since
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""


#: Smallest vertex that each linked one reaches, from links (a, b) in both directions.
REACHED = "r AS (SELECT a AS id, b AS m FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.m), c AS (SELECT id, min(least(id, m)) AS component_id FROM r GROUP BY id)"

OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w ELSE w[i:i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
h AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
{REACHED}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
g AS (SELECT doc_id, i FROM v JOIN f ON f.h = v.h WHERE first < doc_id),
x AS (SELECT DISTINCT doc_id, i + j AS i FROM g, (SELECT unnest(range(0, 50)) AS j)),
k AS (SELECT a.doc_id, string_agg(a.t, ' ' ORDER BY a.i) AS t, count(*) AS n FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d) a ANTI JOIN x ON x.doc_id = a.doc_id AND x.i = a.i GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

OP7_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v FROM e WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_inner_product(x, x) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND list_inner_product(p.v, q.v) >= 0.9),
k AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
{REACHED}
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM e LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.id = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_epsilon_join": OP7_SQL}

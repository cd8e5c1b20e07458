"""Temporal list join: which list entries were active for a URL when it was fetched.

Dated entries (key, at, action, category) become validity intervals: an ``add`` is in
force until the key's next entry.  A key is a host, a parent domain, or a host with its
first path segment.  Every capture is expanded to the keys that cover its URL, and an
as-of join on key and time finds the interval in force; the longest key decides.

Captures are reduced to the distinct (host, first segment, time), and these to distinct
(key, time), before they meet the list; what they find goes back class by class.  The
as-of join is one merge of times and intervals in order, a key's time cut into slices:
its work is the sum of both sides, and no key has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlake.llm.skew import join_classes
from medlake.plans.shared import materialize, scratch

SLICES = 64
HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
SEGMENT = r"^[a-z][a-z0-9+.\-]*://[^/?#]*(/[^/?#]+)"
#: Hosts that are addresses have no parent domains.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """Lower-case host, or bracketed address, without port, user or final dot; empty where there is none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", ""), F.lit(""))


def segment_of(url: Column) -> Column:
    """The first path segment with its slash, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), SEGMENT, 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, since, until, category) of the time each ``add`` is in force; ``until`` is exclusive, null if open.

    Among entries of one key at one time a removal wins, then the last category by name.
    Entries without key or time are ignored.
    """
    rows = entries.where("key is not null and key <> '' and at is not null")
    last = rows.groupBy("key", "at").agg(F.max_by(F.struct("action", "category"), F.struct(F.col("action") != "add", F.coalesce("category", F.lit("")))).alias("e"))
    after = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    timed = last.select("key", F.col("at").alias("since"), after.alias("until"), "e.action", "e.category")
    return timed.where("action = 'add'").drop("action")


def covering_keys(host: Column, segment: Column) -> Column:
    """Keys that cover a URL: host with segment, host, and for a name its parents of two labels and more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    own = F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(own, F.array(host), F.when(host.rlike(ADDRESS), none).otherwise(parents))))


def as_of(asked: DataFrame, valid: DataFrame) -> DataFrame:
    """(key, _at, n, category, since) of the rows (key, _at, n) of ``asked`` that have an interval in force at their time.

    Times are cut into slices of equal length.  An interval starts in one and is carried
    into each later one that it reaches, so a slice is merged on its own; a key's intervals
    don't overlap, so a slice gets at most one.
    """
    ends = asked.agg(F.min(F.unix_timestamp(F.to_timestamp("_at"))), F.max(F.unix_timestamp(F.to_timestamp("_at")))).first()
    if ends[0] is None:
        return asked.select("key", "_at", "n", F.lit(None).cast("string").alias("category"), F.col("_at").alias("since")).limit(0)
    width = max(1, -(-(ends[1] - ends[0] + 1) // SLICES))
    place = lambda t: F.greatest(F.least(F.floor((F.unix_timestamp(F.to_timestamp(t)) - ends[0]) / width), F.lit(SLICES - 1)), F.lit(0)).cast("int")
    e = F.struct("since", "until", "category").alias("e")
    until = F.when(F.col("until").isNull(), SLICES - 1).otherwise(place(F.col("until")))
    spread = valid.select("key", e, place(F.col("since")).alias("_first"), F.explode(F.sequence(place(F.col("since")), F.greatest(until, place(F.col("since"))))).alias("_slice"))
    starts = spread.select("key", "_slice", F.when(F.col("_slice") == F.col("_first"), F.col("e.since")).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("n"), "e")
    times = asked.select("key", place(F.col("_at")).alias("_slice"), "_at", F.lit(1).alias("_kind"), "n", F.lit(None).cast(dict(starts.dtypes)["e"]).alias("e"))
    w = Window.partitionBy("key", "_slice").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.union(times).withColumn("e", F.last("e", True).over(w)).where("_kind = 1")
    return found.where("e.since <= _at and (e.until is null or _at < e.until)").select("key", "_at", "n", "e.category", "e.since")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """(id, fetched_at, blocked, matched_key, category, listed_since) for every capture.

    Null or malformed URLs and null times match nothing.  Rows that share an id are each
    evaluated; other columns are ignored.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(at_col).alias("_at"), host_of(F.col(url_col)).alias("_host"), segment_of(F.col(url_col)).alias("_seg"))
    usable = F.coalesce((F.col("_host") != "") & F.col("_at").isNotNull(), F.lit(False))
    with scratch() as hand_over:
        asked = materialize(rows.where(usable).groupBy("_host", "_seg", "_at").agg(F.count("*").alias("_rows")), "asked")
        keys = materialize(asked.select("_host", "_seg", "_at", F.explode(covering_keys(F.col("_host"), F.col("_seg"))).alias("key")), "keys")
        hits = materialize(as_of(keys.groupBy("key", "_at").agg(F.count("*").alias("n")), intervals(entries)), "hits")
        best = join_classes(keys, hits, ["key", "_at"]).groupBy("_host", "_seg", "_at").agg(F.max_by(F.struct("key", "category", "since"), F.length("key")).alias("m"))
        found = materialize(asked.join(best, ["_host", "_seg", "_at"], "left"), "found")
        hand_over(found)
    both = join_classes(rows.where(usable), found, ["_host", "_seg", "_at"], "_rows").select("_id", "_at", "m")
    out = both.unionByName(rows.where(~usable).select("_id", "_at", F.lit(None).cast(dict(both.dtypes)["m"]).alias("m")))
    return out.select(F.col("_id").alias(id_col), F.col("_at").alias(at_col), F.col("m").isNotNull().alias("blocked"), F.col("m.key").alias("matched_key"), F.col("m.category").alias("category"), F.col("m.since").alias("listed_since"))

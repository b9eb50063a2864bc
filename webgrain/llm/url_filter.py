r"""URL filtering by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: on a date a key is added to or removed from a
list. Its entries become validity intervals, and an as-of join evaluates every
capture against the intervals that hold its fetch time.

Keys are hosts, which also stand for their subdomains ("example.org"), and hosts
with a path prefix of whole segments ("example.org/shop"). A capture has a key
for each suffix of its host and for each path prefix under its host, so the join
is an equi-join on keys with a range condition on time, and no pattern is tried
against every capture.

The intervals are broadcast while they are few (they are counted first). Beyond
that both sides are shuffled by key and a salt: intervals are repeated for each
salt, so captures of one host spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More intervals than this, or with longer keys in all, are not broadcast.
MAX_BROADCAST, MAX_KEY_BYTES = 50_000, 16 << 20
SALTS = 32


def url_host(url: Column) -> Column:
    """Host in lower case without user, port and closing dots; '' if there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def url_path(url: Column) -> Column:
    """Path without query, fragment and empty segments: 'a/b'; '' if there is none."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.array_join(F.filter(F.split(path, "/"), lambda s: s != ""), "/")


def url_keys(host: Column, path: Column) -> Column:
    """All keys under which a list could hold a capture, distinct."""
    labels = F.filter(F.split(host, r"\."), lambda s: s != "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    prefixes = F.transform(segments, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(suffixes, prefixes)))


def list_key(pattern: Column) -> Column:
    """A list's entry as a key: lower-case host, path without closing slashes."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(pattern), r"^\.*([^/]*)", 1)), r"\.+$", "")
    path = F.array_join(F.filter(F.split(F.regexp_extract(F.trim(pattern), r"^[^/]*(.*)$", 1), "/"), lambda s: s != ""), "/")
    return F.when(path == "", host).otherwise(F.concat(host, F.lit("/"), path))


def list_intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of a log with columns list, pattern, action, dated.

    Returns list, key, valid_from, valid_to (null: still valid), the start
    included and the end not. action 'add' opens and 'remove' closes; of entries
    of one list and key at one time, a removal wins. Rows with a null in any of the
    four columns, an empty key or another action raise no error and are left out. Repeated rows change nothing.
    """
    key = list_key(F.col("pattern"))
    at = (
        entries.filter(F.col("action").isin("add", "remove"))
        .select("list", key.alias("key"), F.col("dated").cast("timestamp").alias("dated"), (F.col("action") == "add").alias("adds"))
        .filter(F.col("list").isNotNull() & F.col("dated").isNotNull() & (F.length("key") > 0))
        .groupBy("list", "key", "dated")
        .agg(F.min("adds").alias("adds"))
    )
    in_time = Window.partitionBy("list", "key").orderBy("dated")
    spans = at.withColumn("valid_to", F.lead("dated").over(in_time)).filter("adds")
    return spans.select("list", "key", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    url_col: str = "url",
    fetched_col: str = "fetched_at",
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Every capture with what the lists said when it was fetched.

    Adds host, n_matches (long), matches (array of 'list:key', sorted) and
    blocked (n_matches > 0), in place of columns so named. A capture with a null
    or unparseable URL, or a null fetch time, matches nothing and stays. Repeated
    captures each give a row. Empty lists block nothing.
    """
    keep = [c for c in captures.columns if c not in ("host", "n_matches", "matches", "blocked")]
    host = url_host(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    path = url_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    rows = captures.select(
        F.struct(*keep).alias("capture"),
        F.monotonically_increasing_id().alias("at"),
        host.alias("host"),
        path.alias("path"),
        F.col(fetched_col).cast("timestamp").alias("fetched"),
    )
    keyed = rows.select("capture", "at", "host", "fetched", F.explode_outer(url_keys(F.col("host"), F.col("path"))).alias("key"))
    spans = list_intervals(entries)
    on = ["key"]
    size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("list")), F.lit(0)).alias("bytes")).collect()[0]
    if size["n"] <= max_broadcast and size["bytes"] <= MAX_KEY_BYTES:
        spans = F.broadcast(spans)
    else:
        on = ["key", "salt"]
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
        spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    k, s = keyed.alias("k"), spans.alias("s")
    active = (F.col("s.valid_from") <= F.col("k.fetched")) & (F.col("s.valid_to").isNull() | (F.col("k.fetched") < F.col("s.valid_to")))
    same = [F.col(f"k.{c}") == F.col(f"s.{c}") for c in on]
    hits = k.join(s, [*same, active], "left").select(
        "k.at", "k.capture", "k.host", F.when(F.col("s.key").isNotNull(), F.concat_ws(":", "s.list", "s.key")).alias("hit")
    )
    found = hits.groupBy("at").agg(
        F.first("capture").alias("capture"), F.first("host").alias("host"), F.sort_array(F.collect_set("hit")).alias("matches")
    )
    return found.select(
        *(F.col(f"capture.{c}").alias(c) for c in keep),
        "host",
        F.size("matches").cast("long").alias("n_matches"),
        "matches",
        (F.size("matches") > 0).alias("blocked"),
    )

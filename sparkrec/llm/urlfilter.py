"""URL filters as a temporal list join, in DataFrame functions.

List entries are dated: an entry sets the action of a pattern (``block``,
``allow`` or ``remove``) from its day on. Each (list, pattern) becomes validity
intervals by looking one entry ahead, and a capture is judged by the intervals
that hold its day of fetching.

Patterns are written as keys, so matching is an equi-join:

* ``d:example.com``: the domain and all below it,
* ``h:www.example.com``: that host alone,
* ``p:www.example.com/a/b``: that host and path, and all below the path.

A capture looks up its host, its domain suffixes and its path prefixes, no
deeper than the lists go (deeper keys cannot match). The most specific active
pattern decides, by kind and then depth; among equals the later entry, then
``allow`` before ``block``, then the list's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import broadcast_if_under, materialize

BROADCAST_ROWS = 500_000
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without a trailing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)), r"\.$", "")


def url_segments(url: Column) -> Column:
    """Non-empty segments of the path, as written."""
    return F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2), "/"), lambda s: s != "")


def lookup_keys(url: Column, most_labels: Column, most_segments: Column) -> Column:
    """Array of the keys that may match the URL (none without a host)."""
    host, segments = url_host(url), url_segments(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    k = F.least(n, most_labels)
    domains = F.when(k >= 1, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))).otherwise(F.array())
    m = F.least(F.size(segments), most_segments)
    paths = F.when(m >= 1, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")))).otherwise(F.array())
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("h:"), host)), domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, pattern, action, day)`` -> ``(list, pattern, action,
    since, until)``, ``until`` exclusive and null while open.

    Of several entries of a list for a pattern on one day, ``remove`` counts over
    ``block`` over ``allow``. Entries with a null pattern, action or day are left
    out; repeated entries are one."""
    rank = F.when(F.col("action") == "remove", 2).when(F.col("action") == "block", 1).otherwise(0)
    e = entries.select("list", "pattern", "action", "day").dropna(subset=["pattern", "action", "day"])
    daily = e.groupBy("list", "pattern", "day").agg(F.max_by("action", rank).alias("action"))
    after = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return daily.withColumn("until", after).filter("action <> 'remove'").select("list", "pattern", "action", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """All rows and columns of ``captures`` with ``verdict`` (``block``, ``allow``
    or ``none``), ``rule``, ``since`` and ``by_list`` (replaced if they are there).

    A capture without a host or a day, or with no active pattern, is ``none``
    with null rule. Equal captures get equal verdicts, so each different (URL,
    day) is judged once and a URL that a third of all rows share costs one row.
    """
    valid = materialize(intervals(entries))
    size = valid.agg(F.count("*").alias("n"),
                     F.coalesce(F.max(F.when(F.col("pattern").startswith("d:"), F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"),
                     F.coalesce(F.max(F.when(F.col("pattern").startswith("p:"), F.size(F.split("pattern", "/")) - 1)), F.lit(0)).alias("segments")).first()
    asked = captures.select(F.col(url).alias("u"), F.col(day).alias("t")).filter("u is not null and t is not null").distinct()
    keys = asked.select("u", "t", F.explode(lookup_keys(F.col("u"), F.lit(size["labels"]), F.lit(size["segments"]))).alias("key"))
    active = (F.col("key") == F.col("pattern")) & (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until")))
    kind = F.when(F.col("key").startswith("p:"), 3).when(F.col("key").startswith("h:"), 2).otherwise(1)
    found = keys.join(broadcast_if_under(valid, size["n"], BROADCAST_ROWS), active)
    depth = F.size(F.split("key", "[./]"))
    best = F.max(F.struct(kind.alias("kind"), depth.alias("depth"), F.col("since"), (F.col("action") == "allow").alias("allow"), F.col("list"), F.col("key"), F.col("action"))).alias("b")
    won = found.groupBy("u", "t").agg(best).select("u", "t", F.col("b.action").alias("verdict"), F.col("b.key").alias("rule"), F.col("b.since").alias("since"), F.col("b.list").alias("by_list"))
    own = [c for c in captures.columns if c not in ("verdict", "rule", "since", "by_list")]
    base = captures.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(own)], F.col(url).alias("_u"), F.col(day).alias("_t"))
    joined = base.join(won, (F.col("_u") == F.col("u")) & (F.col("_t") == F.col("t")), "left")
    return joined.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(own)], F.coalesce("verdict", F.lit("none")).alias("verdict"), "rule", "since", "by_list")

"""Query of URL filters over all pages, and its DuckDB SQL.

The test tables have neither lists nor fetch days, so Spark derives both from
``pages``: a page is fetched on day ``page_id % 366``; every domain, host and
first path segment of the pages is listed if its md5 says so, and changes its
action on later days.
"""

from pyspark.sql import functions as F

from sparkrec.llm import urlfilter
from sparkrec.llm.common import table


def derived_entries(pages):
    """``(list, pattern, action, day)`` of all hosts, domains and first segments."""
    host, segments = urlfilter.url_host(F.col("url")), urlfilter.url_segments(F.col("url"))
    names = pages.select(host.alias("host"), F.get(segments, F.lit(0)).alias("first")).filter("host <> ''").distinct()
    patterns = names.select(F.explode(F.array_compact(F.array(
        F.concat(F.lit("h:"), "host"), F.concat(F.lit("d:"), F.substring_index("host", ".", -2)), F.concat(F.lit("p:"), "host", F.lit("/"), "first")))).alias("pattern")).distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    step = patterns.withColumn("h", h).filter(F.col("h") % 3 < 2).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    action = F.element_at(F.array(F.lit("block"), F.lit("remove"), F.lit("allow"), F.lit("block")), F.pmod(F.floor(F.col("h") / 7) + F.col("i"), F.lit(4)).cast("int") + 1)
    return step.select(F.concat(F.lit("list"), (F.col("h") % 2).cast("string")).alias("list"), "pattern", action.alias("action"), ((F.col("h") % 90) + F.col("i") * (30 + F.col("h") % 61)).alias("day"))


def op7_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(366)).cast("int"))
    found = urlfilter.judge(captures, derived_entries(pages))
    return found.select("page_id", "url", "day", "verdict", "rule", "since", "by_list")


_HOST = r"regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 1)), '\.$', '')"
_SEGMENTS = r"[s FOR s IN string_split(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)', 2), '/') IF s <> '']"

ORACLES = {"op7_url_filters": rf"""
WITH c AS (SELECT row_number() OVER () AS r, page_id, url, CAST(((coalesce(page_id, 0) % 366) + 366) % 366 AS INTEGER) AS day, {_HOST} AS host, {_SEGMENTS} AS segs FROM pages),
names AS (SELECT DISTINCT host, string_split(host, '.') AS labels, segs[1] AS first FROM c WHERE host <> ''),
patterns AS (SELECT 'h:' || host AS pattern FROM names UNION
             SELECT 'd:' || array_to_string(list_slice(labels, greatest(len(labels) - 1, 1), len(labels)), '.') FROM names UNION
             SELECT 'p:' || host || '/' || first FROM names WHERE first IS NOT NULL),
hashed AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS INTEGER) AS h FROM patterns),
entries AS (SELECT 'list' || (h % 2) AS list, pattern, ['block', 'remove', 'allow', 'block'][((h // 7 + i) % 4) + 1] AS action, CAST(h % 90 + i * (30 + h % 61) AS INTEGER) AS day
            FROM hashed, range(0, 4) t(i) WHERE h % 3 < 2),
keys AS (SELECT r, day, 'h:' || host AS key, 2 AS kind FROM c WHERE host <> '' UNION ALL
         SELECT r, day, 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), 1
         FROM (SELECT r, day, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM c WHERE host <> '') UNION ALL
         SELECT r, day, 'p:' || host || '/' || array_to_string(list_slice(segs, 1, i), '/'), 3
         FROM (SELECT r, day, host, segs, unnest(range(1, len(segs) + 1)) AS i FROM c WHERE host <> '')),
pairs AS (SELECT DISTINCT k.r, k.day, k.key, k.kind, e.list FROM keys k JOIN (SELECT DISTINCT list, pattern FROM entries) e ON e.pattern = k.key),
live AS (SELECT p.r, p.key, p.kind, p.list, e.action, e.day AS since FROM pairs p ASOF JOIN entries e ON p.key = e.pattern AND p.list = e.list AND p.day >= e.day),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY kind DESC, len(regexp_split_to_array(key, '[./]')) DESC, since DESC, action = 'allow' DESC, list DESC, key DESC) AS o
         FROM live WHERE action <> 'remove')
SELECT c.page_id, c.url, c.day, coalesce(b.action, 'none') AS verdict, b.key AS rule, b.since, b.list AS by_list
FROM c LEFT JOIN best b ON b.r = c.r AND b.o = 1
"""}
QUERIES = {"op7_url_filters": op7_url_filters}

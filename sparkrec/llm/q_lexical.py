"""Query of ranked lexical search: all documents for each benchmark item, and its DuckDB SQL."""

from sparkrec.llm import lexical
from sparkrec.llm.common import table


def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {"op12_lexical_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, {_TERMS} AS w FROM benchmark)),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
length AS (SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(w) AS BIGINT) * total.n) // total.l) AS m FROM d, total WHERE len(w) > 0),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * total.n + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
asked AS (SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY q, item_id, term),
scored AS (SELECT q, item_id, r, doc_id, sum(c * weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m))) AS score
           FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN length USING (r) WHERE doc_id IS NOT NULL GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""}

"""Vector queries: exact top-k search, blending, normalisation, index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.search import attach_metadata, top_k_search
from . import standins as S
from .registry import query


@query(
    "vector_topk",
    oracle=f"""
WITH it AS ({S.ITEMS_SQL}),
s AS (SELECT q.faiss_idx AS query_id, i.faiss_idx, i.movie_id,
             list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])) AS score
      FROM it q CROSS JOIN it i),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, faiss_idx) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, movie_id, round(score, 6) AS score FROM r WHERE rank <= 5
""",
)
def vector_topk(spark, d):
    """Every catalogue vector searched against the whole catalogue (top 5)."""
    items = S.items(spark, d)
    queries = items.select(F.col("faiss_idx").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = top_k_search(queries, items, 5)
    return attach_metadata(hits, items.select("faiss_idx", "movie_id")).select(
        "query_id", "rank", "movie_id", F.round("score", 6).alias("score")
    )

"""Domain views over the driver tables (see README, "Data mapping").

* items   <- embeddings: faiss_idx = movie_id = vec_id, 64-d unit vectors
* movies  <- part: movie_id = p_partkey, MovieLens-style title ``name (year)``
             (PROMO parts carry no year), genres ``p_type|p_brand``
* ratings <- orders x lineitem: user = o_custkey, item = l_partkey,
             rating = least(5, 1 + floor(l_quantity / 10)), ts = l_shipdate
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("faiss_idx"),
        F.col("vec_id").alias("movie_id"),
        F.col("embedding"),
        F.col("label"),
    )


def movies(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    title = F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(
        F.concat(F.col("p_name"), F.lit(" ("), (F.lit(1940) + F.col("p_size")).cast("string"), F.lit(")"))
    )
    return p.select(
        F.col("p_partkey").alias("movie_id"),
        title.alias("title"),
        F.concat_ws("|", F.col("p_type"), F.col("p_brand")).alias("genres"),
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.least(F.lit(5.0), F.lit(1.0) + F.floor(F.col("l_quantity") / 10)).cast("double").alias("rating"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_extendedprice").alias("price"),
    )


# SQL text of the same views for the DuckDB oracles (computed from raw tables).
ITEMS_SQL = "SELECT vec_id AS faiss_idx, vec_id AS movie_id, embedding, label FROM embeddings"
MOVIES_SQL = (
    "SELECT p_partkey AS movie_id, CASE WHEN p_type = 'PROMO' THEN p_name "
    "ELSE p_name || ' (' || CAST(1940 + p_size AS VARCHAR) || ')' END AS title, "
    "p_type || '|' || p_brand AS genres FROM part"
)
RATINGS_SQL = (
    "SELECT o_custkey AS user_id, l_partkey AS item_id, "
    "CAST(least(5.0, 1.0 + floor(l_quantity / 10)) AS DOUBLE) AS rating, l_shipdate AS ts, "
    "l_orderkey AS order_key, l_linenumber AS line_number, l_extendedprice AS price "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
)

"""Keyword dictionaries as tables: many raw-substring patterns against many texts.

A text can hold a keyword only if it holds the keyword's grams. Each keyword is
filed under one of its grams, the one that fewest keywords have (GRAM characters,
or the whole keyword if it is shorter). The distinct texts are exploded to their
distinct grams of the lengths in use, joined with the keywords by an equi-join, and
every meeting is verified by ``instr``; no text meets a keyword without sharing a
rare gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..sources.io import materialize
from .bridge import broadcast_if_small

GRAM = 3


def dictionary_table(spark: SparkSession, kind: str, keywords: dict[str, list[str]]) -> DataFrame:
    """``(kind, place, category, keyword)`` of a dictionary in its order."""
    rows = [(kind, i, c, w) for i, (c, ws) in enumerate(keywords.items()) for w in ws]
    return spark.createDataFrame(rows, "kind string, place int, category string, keyword string")


def filed(dictionary: DataFrame) -> DataFrame:
    """``(gram, kind, place, category, keyword)``: each keyword under its rarest gram."""
    words = dictionary.select("keyword").where(F.length("keyword") > 0).distinct()
    size = F.least(F.length("keyword"), F.lit(GRAM))
    grams = words.select("keyword", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("keyword") - size + 1), lambda i: F.substr(F.col("keyword"), i, size)))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(held, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return dictionary.join(rarest, "keyword").select("gram", "kind", "place", "category", "keyword")


def match_dictionary(texts: DataFrame, dictionary: DataFrame, *, text: str = "text", config: Config = DEFAULT) -> DataFrame:
    """``(text, kind, categories)`` for every different text and dictionary kind with
    a match: the categories, in dictionary order, of which a keyword occurs in the
    lower-cased text. Null texts and empty keywords match nothing."""
    index = materialize(filed(dictionary))
    lengths = sorted(r[0] for r in index.select(F.length("gram")).distinct().collect())  # 1 .. GRAM
    distinct = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct().withColumn("low", F.lower("text"))
    none = distinct.select("text", F.lit(None).cast("string").alias("kind"), F.array().cast("array<string>").alias("categories")).where(F.lit(False))
    if not lengths:
        return none

    def grams(n: int):
        places = F.when(F.length("low") >= n, F.sequence(F.lit(1), F.length("low") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substr(F.col("low"), i, F.lit(n)))

    every = distinct.select("text", "low", F.explode(F.array_distinct(F.flatten(F.array(*[grams(n) for n in lengths])))).alias("gram"))
    keys = broadcast_if_small(index.select("gram").distinct(), config)
    met = every.join(keys, "gram", "left_semi").join(_sized(index, config), "gram").where(F.instr(F.col("low"), F.col("keyword")) > 0)
    hit = met.select("text", "kind", "place", "category").distinct()
    lists = hit.groupBy("text", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "category"))).alias("c"))  # a dictionary's categories at most
    return lists.select("text", "kind", F.col("c.category").alias("categories"))


def _sized(index: DataFrame, config: Config) -> DataFrame:
    """Broadcast hint where the counted bytes allow it."""
    size = index.agg(F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("keyword") + F.octet_length("category") + 64), F.lit(0))).first()[0]
    return F.broadcast(index) if size <= config.broadcast_limit_bytes else index

"""Query of approximate nearest neighbours over all embeddings."""

from pyspark.sql import functions as F

from sparkrec.llm import ann
from sparkrec.llm.common import table


def op3_nearest_neighbours(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("query_id") % 20 == 0, 20)


QUERIES = {"op3_nearest_neighbours": op3_nearest_neighbours}
ORACLES = {}

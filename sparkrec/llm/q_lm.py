"""Query of language-model scoring over all documents."""

from pyspark.sql import functions as F

from sparkrec.llm import lm
from sparkrec.llm.common import crc_remainder, table


def op8_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lm.score(docs, crc_remainder(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_lm_scoring": op8_lm_scoring}
ORACLES = {}

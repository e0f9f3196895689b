"""Query of SimHash near-duplicates over all documents."""

from pyspark.sql import functions as F

from sparkrec.llm import simhash
from sparkrec.llm.common import materialize, table


def op4_simhash_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(docs.select("doc_id", simhash.fingerprint(docs, "text", 3).alias("fp")))
    found = simhash.near_duplicates(prints, "doc_id", "fp", 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLES = {}

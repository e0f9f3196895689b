"""Query of language identification over all documents."""

from pyspark.sql import functions as F

from sparkrec.llm import langid
from sparkrec.llm.common import crc_remainder, table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.filter(~held_out))
    return (docs.select("doc_id", held_out.alias("held_out"), langid.language(docs, model).alias("l"))
            .select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.phrases").alias("phrases")))


QUERIES = {"op1_language_id": op1_language_id}
ORACLES = {}

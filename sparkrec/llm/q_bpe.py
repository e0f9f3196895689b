"""Query of byte-level BPE: all documents encoded and decoded."""

import public_tokenizers
from pyspark.sql import functions as F

from sparkrec.llm import bpe
from sparkrec.llm.common import table


def op11_byte_bpe(spark, sf_dir):
    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLES = {}

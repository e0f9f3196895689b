"""Query of sequence packing over all documents."""

import public_tokenizers
from pyspark.sql import functions as F

from sparkrec.llm import packing
from sparkrec.llm.common import table


def op5_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op5_packing": op5_packing}
ORACLES = {}

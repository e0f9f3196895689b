"""Query of the token files: all documents written and read back."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from sparkrec.llm import tokenfile
from sparkrec.llm.common import table
from sparkrec.sources.io import stage_folder


def op6_token_files(spark, sf_dir):
    path = f"{stage_folder(spark)}/tokens-{uuid.uuid4().hex}"  # dropped with the application's stage tables
    tokenfile.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_files": op6_token_files}
ORACLES = {}

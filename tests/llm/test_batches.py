import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkrec.llm import langid, packing, simhash
from sparkrec.llm.common import BATCH_BYTES

MODEL = langid.build_model({"aa": "abcd " * 400})


@pytest.mark.parametrize("operator", [
    lambda d: langid.language(d, MODEL), lambda d: simhash.fingerprint(d), lambda d: packing.pack(d, public_tokenizers.path("byte_bpe_50k.json"))])
def test_texts_reach_workers_in_small_batches(spark, operator):
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 1000).alias("text"))  # 20 MB

    def largest(batches):
        sizes = [b.nbytes for b in batches]
        yield pa.record_batch([pa.array([max(sizes, default=0)], pa.int64())], names=["n"])

    own = spark.conf.get(BATCH_BYTES, None)
    try:
        spark.conf.unset(BATCH_BYTES)
        operator(docs)
        assert docs.mapInArrow(largest, "n long").agg(F.max("n")).first()[0] < 8_000_000
        spark.conf.set(BATCH_BYTES, "32m")
        operator(docs)
        assert spark.conf.get(BATCH_BYTES) == "32m"
    finally:
        spark.conf.unset(BATCH_BYTES) if own is None else spark.conf.set(BATCH_BYTES, own)

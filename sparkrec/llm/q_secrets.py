"""Query of the secret scan over all documents."""

from pyspark.sql import functions as F

from sparkrec.llm import secrets
from sparkrec.llm.common import table


def op10_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES = {}

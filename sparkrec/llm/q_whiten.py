"""Query of embedding whitening over all embeddings."""

from sparkrec.llm import whiten
from sparkrec.llm.common import table


def op13_embedding_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLES = {}

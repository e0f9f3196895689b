"""Query of main-text extraction over all pages."""

from pyspark.sql import functions as F

from sparkrec.llm import htmlmain
from sparkrec.llm.common import table


def op2_html_extraction(spark, sf_dir):
    found = htmlmain.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES = {}

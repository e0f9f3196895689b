"""Chat prompt text from ranked recommendations (one prompt per query)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prompt frame text.
PROMPT_HEAD = 'The user asked: "{query}"\nBased on their taste profile and history, here are the top recommendations:\n'
PROMPT_TAIL = ("\nGenerate a natural, conversational response presenting these recommendations. "
               "Explain briefly why each might appeal to the user based on their query.")
UNKNOWN_TITLE = "Unknown"
# End of fixed values.


def _part(c, fmt_prefix, fmt_suffix=""):
    c = F.col(c).cast("string")
    return F.when(c.isNotNull() & (c != "") & (c != "0"), F.concat(F.lit(fmt_prefix), c, F.lit(fmt_suffix))).otherwise("")


def format_prompts(query_text: DataFrame, recs: DataFrame, *, key: str = "query_id", max_recs: int = 5) -> DataFrame:
    """query_text: ``key, query``; recs: ``key, rank, title, year, genres,
    plot_snippet``. Lines ``i. title (year) - genres - snippet`` for the first
    ``max_recs`` ranks; falsy parts skipped, missing title -> ``Unknown``."""
    r = recs.where(F.col("rank") <= max_recs)
    line = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.coalesce(F.col("title"), F.lit(UNKNOWN_TITLE)),
        _part("year", " (", ")"), _part("genres", " - "), _part("plot_snippet", " - "), F.lit("\n"),
    )
    lines = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "")
    head, tail = PROMPT_HEAD.split("{query}")
    out = query_text.join(lines, key, "left").select(
        key, F.concat(F.lit(head), F.coalesce(F.col("query"), F.lit("")), F.lit(tail),
                      F.coalesce(body, F.lit("")), F.lit(PROMPT_TAIL)).alias("prompt"))
    return out

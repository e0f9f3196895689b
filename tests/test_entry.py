import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

ROWS_ONLY = {"als_topk"}


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in set(q) - set(o) if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own == ROWS_ONLY


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "movie_id"]
    assert df.count() > 0

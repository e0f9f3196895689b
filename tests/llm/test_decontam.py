import hashlib
import re

import duckdb

from sparkrec.llm.q_decontam import ORACLES, op9_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s:s + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w = words(text)
        hit, held = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s:s + n]))
                if own:
                    hit.update(range(s, s + n))
                    held |= own
        ids = sorted(str(i) for i in held if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=str)


def run(spark, path):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(map(tuple, op9_decontamination(spark, path).select(*cols).collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert run(spark, sf) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.execute(ORACLES["op9_decontamination"])
    cols = [d[0] for d in rel.description]
    at = [cols.index(c) for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str) == want


LONG = " ".join(f"w{i}" for i in range(14))


def test_odd_rows(spark, tables):
    docs = [(1, None), (2, ""), (3, "..."), (4, LONG.upper()), (5, "x " + LONG.replace(" ", ", ") + " y " + LONG), (6, LONG[:20]), (7, "One two"), (8, "one. TWO three"),
            (9, "É é solo"), (None, LONG), (4, LONG.upper()), (10, "a " * 20_000 + "solo"), (11, "the the the the the the the the the the the the"), (12, "w0 w1 w2 w3 w4 w5 w6 w7 w8 x9")]
    items = [(10, LONG), (9, LONG), (11, "one two"), (12, "SOLO"), (13, None), (14, "!!"), (None, "One two three"), (15, "the " * 11), (16, "É"), (10, "again w3 w4")]
    path = tables(documents=("doc_id long, text string, n_words int, w string, item string", [(*r, 1, "x", "y") for r in docs]),
                  benchmark=("item_id long, text string, win string, token string", [(*r, "x", "y") for r in items]))
    assert run(spark, path) == brute(docs, items)


def test_empty_tables(spark, tables, tmp_path):
    path = tables(documents=("doc_id long, text string", [(1, "a b")]), benchmark=("item_id long, text string", []))
    assert run(spark, path) == brute([(1, "a b")], [])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert run(spark, f"{tmp_path}/none") == []

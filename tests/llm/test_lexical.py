import math
import random
import re
from collections import Counter

import numpy as np

from sparkrec.llm import lexical
from sparkrec.llm.q_lexical import op12_lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k=20):
    held = [(d, Counter(x.translate(LOWER) for x in TERM.findall(t or ""))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, total, df = len(held), sum(x[2] for x in held), Counter(w for _, c, _ in held for w in c)
    out = {}
    for item, text in set(items):
        asked, scores = Counter(x.translate(LOWER) for x in TERM.findall(text or "")), []
        for d, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(a * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w, a in asked.items() if w in c)
            if s > 0 and d is not None:
                scores.append((-s, d))
        for r, (s, d) in enumerate(sorted(scores)[:k]):
            out[(item, text, r + 1)] = (d, -s)
    return sorted(((i, r, d, s) for (i, _, r), (d, s) in out.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_all_items_as_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op12_lexical_search(spark, sf)) == brute(docs, items)


def test_odd_rows_and_crowded_sketches(spark, monkeypatch):
    """Few sketch places and small blocks and sets, so that bounds are loose and thresholds carry over."""
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 7)
    monkeypatch.setattr(lexical, "SET_ITEMS", 5)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["É", "漢字", "x_y", "A-B", "İ"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(150)]
    docs += [(i, "same Same w1 w2") for i in range(200, 260)] + [(3, docs[3][1]), (None, "w1 w2 same"), (300, None), (301, ""), (302, "w3 " * 60_000)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for i in range(12)] + [(50, "same w1 w1 w1"), (50, "same w1 w1 w1"), (51, None), (52, "--"), (53, "absent"), (None, "w5")]
    d = spark.createDataFrame([(*r, 1, 2.0) for r in docs], "doc_id long, text string, score int, rank double").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id int, text string, query int")
    for width in (3, 1024):
        assert got(lexical.search(d, q, 20, width=width)) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("q", "a")], "item_id string, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == brute([(1, "a b")], [("q", "a")])


def test_bounds_hold_and_spare_work():
    rnd = random.Random(4)
    words = [[f"w{min(int(rnd.paretovariate(0.4)), 900)}".encode() for _ in range(60)] for _ in range(800)]
    queries = lexical.Queries.of([b" ".join(w[:8]) for w in words[:40]], 256)
    stats = lexical.Statistics(800, 800 * 60, np.arange(len(queries.vocabulary), dtype=np.int64) % 900 + 50)
    block = lexical.Block(words, queries, stats, queries.places())
    bounds, spent = block.bounds(queries.lookups()), 0
    for q, (held, counts) in enumerate(zip(queries.held, queries.counts)):
        exact = block.exact(np.arange(800), held, counts)
        assert (bounds[:, q] >= exact).all()
        best = lexical.Best(20)
        spent += lexical.rescore(block, bounds[:, q], np.arange(800), held, counts, best)
        order = np.lexsort((np.arange(800), -exact))[:20]
        assert best.ids.tolist() == order[exact[order] > 0].tolist()
    assert spent < 0.3 * 40 * 800

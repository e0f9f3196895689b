import random

import xxhash

from sparkrec.llm import simhash
from sparkrec.llm.q_simhash import op4_simhash_near_dedup


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{prints[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, path):
    return sorted(map(tuple, op4_simhash_near_dedup(spark, path).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, sf) == brute_classes(rows)


def test_odd_rows(spark, tables):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A\tb "), (None, "a b"), (None, "x y z w"), (4, "One"),
            (9, "\x85 É é"), (10, "é\x00 b c d"), (11, "w " * 3000 + "end"), (12, "w " * 3000 + "END")]
    path = tables(documents=("doc_id long, text string, fp string, key int, component_id int", [(*r, "x", 1, 5) for r in rows]))
    assert run(spark, path) == brute_classes(rows)


def test_empty_table(spark, tables):
    assert run(spark, tables(documents=("doc_id long, text string", []))) == []


def test_crowded_buckets_and_thresholds_lose_no_link(spark):
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:  # a dense cloud, chains that leave it, and strangers
        p = rnd.choice(sorted(prints)) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.choice([1, 2])))
        prints.add(p & (1 << 64) - 1)
    prints |= {rnd.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    for limit in (1, 4, 10**6):
        links = simhash.links(df.select("fp"), 2, bucket_limit=limit).collect()
        assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in links:
            root[find(r["u"])] = find(r["v"])
        for i, a in enumerate(signed):
            for b in signed[:i]:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                    assert find(a) == find(b)


def test_threshold_allocation_sums_and_is_least():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    est = [np.sort(rng.integers(0, 500, (20, 3)).astype(float), axis=1) for _ in range(3)]
    widths = [22, 21, 21]
    got = simhash.allocate(est, widths, 2)
    keys = [1, 1 + 21, 1 + 21 + 210]
    for r in range(20):
        def cost(ts):
            return sum(est[i][r, t] + [1, 1 + widths[i], 1 + widths[i] + widths[i] * (widths[i] - 1) // 2][t] for i, t in enumerate(ts) if t >= 0)

        assert got[r].sum() == 0
        assert cost(got[r]) == min(cost(ts) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 0)
    assert keys[0] == 1

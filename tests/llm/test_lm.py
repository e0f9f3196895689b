import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkrec.llm import lm
from sparkrec.llm.q_lm import op8_lm_scoring


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]


def brute_base(rows):
    count = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        toks = [*words(t), None]
        out.append((d, len(toks), sum(count[x] > 0 for x in toks), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in toks)))
    return out


def same(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and math.isclose(g[4], w[4], rel_tol=1e-9)


def test_base_exact_and_model_better(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = op8_lm_scoring(spark, sf).collect()
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], brute_base(rows))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark, tables):
    rows = [(i, f"a common line of words number {i}") for i in range(30)] + [(50, None), (51, ""), (52, "A\x85b \x0b C"), (None, "common words"), (50, None), (53, "w " * 30_000)]
    path = tables(documents=("doc_id long, text string, word string, score int, c int", [(*r, "x", 1, 2) for r in rows]))
    got = op8_lm_scoring(spark, path).collect()
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], brute_base(rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_empty_and_no_training_row(spark, tables, tmp_path):
    assert op8_lm_scoring(spark, tables(documents=("doc_id long, text string", []))).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    spark.createDataFrame([(held, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/h/documents.parquet")
    r = op8_lm_scoring(spark, f"{tmp_path}/h").first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and math.isfinite(r["score"])


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "PART_TOKENS", 20_000)
    monkeypatch.setattr(lm, "PILOT_TOKENS", 10_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    scores = []
    for n in (1, 8, 64):
        found = lm.score(docs.repartition(n), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
        scores.append({r["doc_id"]: (r["base_score"], r["score"]) for r in found})
    assert len(scores[0]) == docs.count() and len({round(b, 3) for b, _ in scores[0].values()}) > 100
    for other in scores[1:]:
        assert all(math.isclose(x, y, rel_tol=1e-9) for d, pair in scores[0].items() for x, y in zip(pair, other[d]))


def step_by_hand(p, w, x1, x2, k, class_count, rate):
    """One step of noise-contrastive estimation with Adagrad, written out in loops."""
    share = [(c + 1) / sum(c + 1 for c in class_count) for c in class_count]
    noise = [math.log(lm.NOISE * s) for s in share]
    g = {name: {} for name in ("r", "q", "c", "b")}

    def add(name, at, v):
        g[name][at] = g[name].get(at, 0) + np.asarray(v, dtype=float)

    q, r, c, b = (p[n].astype(float) for n in ("q", "r", "c", "b"))
    for i in range(len(w)):
        h = r[x1[i]] * c[0] + r[x2[i]] * c[1]
        pull = 1 / (1 + math.exp(h @ q[w[i]] + b[w[i], 0] - noise[w[i]]))
        dh = pull * q[w[i]]
        add("q", w[i], pull * h)
        add("b", w[i], [pull])
        for j in k:
            push = 1 / (1 + math.exp(-(h @ q[j] + b[j, 0] - noise[j])))
            dh = dh - push * q[j]
            add("q", j, -push * h)
            add("b", j, [-push])
        add("r", x1[i], dh * c[0])
        add("r", x2[i], dh * c[1])
        add("c", 0, dh * r[x1[i]])
        add("c", 1, dh * r[x2[i]])
    out = {}
    for name in ("r", "q", "c", "b"):
        out[name] = p[name].astype(float)
        for at, v in g[name].items():
            size = float(p["g_" + name][at]) + (v * v).mean()
            out[name][at] += (rate if name in "rq" else 0.1 * rate) * v / math.sqrt(size + 1e-6)
    return out


def test_one_training_step_by_hand():
    rng = np.random.default_rng(12)
    count = rng.integers(1, 50, lm.HEAD + lm.TAIL).astype(float)
    p = lm.start_parameters(count)
    p["b"] += rng.normal(0, 0.2, p["b"].shape).astype(np.float32)
    seqs = [rng.integers(0, 40, n).astype(np.int32) for n in (9, 1, 14)]
    flat, w1, w2 = lm.contexts(seqs)
    draws = np.random.default_rng(3)
    order = draws.permutation(len(flat))
    ramp = np.cumsum((count + 1) / (count + 1).sum())
    k = np.minimum(np.searchsorted(ramp, draws.random(lm.NOISE)), len(ramp) - 1)
    want = step_by_hand(p, flat[order], w1[order], w2[order], k.tolist(), count, 0.1)
    got = lm.train({n: v.copy() for n, v in p.items()}, (flat, w1, w2), count, 0.1, 3)
    for name in ("r", "q", "c", "b"):
        assert np.abs(got[name] - want[name]).max() < 2e-5 and np.abs(got[name] - p[name]).max() > 1e-3


def test_scores_by_hand(spark, monkeypatch):
    """The query's scores against the softmax of the same parameters, word by word."""
    kept = {}
    fit = lm.fit
    monkeypatch.setattr(lm, "fit", lambda docs, vocab: kept.setdefault("p", (fit(docs, vocab), vocab))[0])
    rows = [(i, f"the cat{i % 7} sat on the mat{i % 11} and word{i} went") for i in range(60)] + [(70, ""), (71, "unseen zebra the"), (72, None)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 50).collect()}
    p, vocab = kept["p"]
    count = Counter(w for i, t in rows if i < 50 for w in words(t))
    tail = [0.0] * (lm.HEAD + lm.TAIL)
    for w, c in count.items():
        if w.encode() not in vocab.head:
            tail[lm.tail_class(w.encode())] += c + 1
    for d, t in rows:
        before, total = (0, 0), 0.0
        for w in [*words(t), None]:
            k = 0 if w is None else vocab.head.get(w.encode()) or lm.tail_class(w.encode())
            h = p["r"][before[0]].astype(float) * p["c"][0] + p["r"][before[1]].astype(float) * p["c"][1]
            scores = p["q"].astype(float) @ h + p["b"][:, 0]
            total += (scores[k] - np.log(np.exp(scores).sum())) / math.log(10)
            if k >= lm.HEAD:
                total += math.log10((count[w] + 1) / (tail[k] + 1))
            before = (k, before[0])
        assert math.isclose(got[d], total, rel_tol=1e-4)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    count = rng.integers(1, 50, lm.HEAD + lm.TAIL).astype(float)
    p = lm.start_parameters(count)
    flat = rng.integers(0, len(count), 5000).astype(np.int32)
    tokens = lm.contexts([flat[:2000], flat[2000:2001], flat[2001:]])
    lm.train(p, tokens, count, 0.1, 1)
    m = lm.normalised(p)
    for a, b in ((0, 0), (5, 9), (1500, 3)):
        every = np.arange(len(count))
        logs = lm.token_logs(m, (every, np.full(len(every), a), np.full(len(every), b)))
        assert math.isclose((10.0 ** logs).sum(), 1.0, rel_tol=1e-4)


def test_word_probabilities_within_tail_classes_sum_to_one(spark):
    counts = spark.createDataFrame([(f"word{i}".encode(), i + 1) for i in range(lm.HEAD + 500)], "word binary, c long")
    v = lm.vocabulary(counts, 10)
    mass = Counter()
    for i in range(lm.HEAD + 500):
        w = f"word{i}".encode()
        if w not in v.head:
            mass[lm.tail_class(w)] += (i + 2) / 10 ** v.tail_log[lm.tail_class(w)]
    for k, m in mass.items():
        assert math.isclose(m + 1 / 10 ** v.tail_log[k], 1.0)


def test_contexts_restart_at_documents():
    w, a, b = lm.contexts([np.array([5, 6, 0]), np.array([0]), np.array([7, 8, 9, 0])])
    assert a.tolist() == [0, 5, 6, 0, 0, 7, 8, 9] and b.tolist() == [0, 0, 5, 0, 0, 0, 7, 8] and len(w) == 8

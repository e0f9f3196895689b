"""Language-model scoring with a log-bilinear model trained by noise-contrastive
estimation (numpy), and an add-one unigram base score.

*Vocabulary.* The model predicts classes: the commonest training words are a
class each, all other words fall into ``tail`` classes by a hash of their last
letters. ``P(word | context) = P(class | context) * P(word | class)``; within a
tail class words have add-one probabilities from their counts over the whole
training text, with one place for an unseen word, so the product is normalised
over all training words and one unseen word a class.

*Log-bilinear part.* The vectors of the two words before predict
``h = r[w1] * c1 + r[w2] * c2`` and a class scores ``h . q[w] + b[w]``. The score
splits into a term of each context word, so two matrix products give every score
and ``exp(A1) @ exp(A2 + b).T`` gives the normaliser of every pair of context
classes at once: each token's probability is exact and costs four look-ups.

*Encoding.* Once the counts are known, the texts are split a second and last time
into a stage table: each document's classes in 16 bits, the part of its sums that
the commonest words give, and its other words. Training and scoring read that.

*Training.* A start model comes from a bounded sample of whole documents on the
driver. The training documents are dealt by a hash to parts of some ``PART_TOKENS``
tokens; each part trains a copy of the start model with noise-contrastive estimation
(class unigrams as noise, shared by a batch) over all its tokens, in the order of
another hash, and the copies are averaged by their tokens in a Spark aggregate of
whole numbers: the driver gets one model, the same for every layout of the table.

*Counts* cover the whole training text. The commonest words (``LOOKUP`` at most)
are sent to the workers; all others meet their counts in a join on the word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import materialize, ship
from sparkrec.llm.tokens import in_parts

HEAD, TAIL, DIM = 1024, 1024, 24  # word classes, hashed classes, vector size
END = 0  # class of the document end, also the context before the first words
LOOKUP = 100_000  # words whose counts every worker holds
PILOT_TOKENS, PILOT_ROUNDS = 1_000_000, 4  # of the start sample: about so many tokens, passes
PART_TOKENS, CHUNK_TOKENS = 3_000_000, 300_000  # trained as one copy; held and shuffled at a time
WHOLE = 1 << 20  # averaged numbers are counted in this fraction
NOISE, BATCH, RATE = 64, 2048, 0.1


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word[-3:]) % TAIL


@dataclass(frozen=True)
class Vocabulary:
    head: dict  # word -> class 1 .. HEAD - 1
    counts: dict  # the commonest words -> count
    end_count: int
    tokens: int  # N: words and ends of the training text
    types: int  # V: distinct words and the end
    class_count: np.ndarray  # training tokens of each class
    tail_log: np.ndarray  # log10 of the denominator of words in each tail class


@dataclass(frozen=True)
class Model:
    a1: np.ndarray  # scores by the word before (classes x classes)
    a2: np.ndarray  # scores by the word before that, plus the class bias
    log_z: np.ndarray  # normaliser by both context classes


def contexts(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, class before, class before that, of every token of the documents."""
    flat = np.concatenate(seqs)
    w1 = np.concatenate(([END], flat[:-1]))
    w2 = np.concatenate(([END, END], flat[:-2]))[:len(flat)]
    starts = np.cumsum([0] + [len(s) for s in seqs[:-1]])
    w1[starts] = END
    w2[starts] = END
    second = starts + 1
    w2[second[second < len(flat)]] = END  # a document of one token: its neighbour's start is set already
    return flat, w1, w2


def start_parameters(class_count: np.ndarray, dim: int = DIM, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    n = len(class_count)
    share = (class_count + 1.0) / (class_count + 1.0).sum()
    return {"r": rng.normal(0, 0.1, (n, dim)).astype(np.float32), "q": rng.normal(0, 0.1, (n, dim)).astype(np.float32),
            "c": np.ones((2, dim), dtype=np.float32), "b": np.log(share).astype(np.float32)[:, None],
            **{f"g_{name}": np.full(rows, 1e-2, dtype=np.float32) for name, rows in (("r", n), ("q", n), ("c", 2), ("b", n))}}


def _row_sums(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sum of the rows of each."""
    at = at.astype(np.uint16)  # sorted by radix
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0]
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def _ascend(p: dict, name: str, ids: np.ndarray, g: np.ndarray, rate: float) -> None:
    """Adagrad step with one accumulator a row."""
    size = p["g_" + name]
    size[ids] += (g * g).mean(axis=1)
    p[name][ids] += rate * g / np.sqrt(size[ids] + 1e-6)[:, None]


def train(p: dict, tokens: tuple, class_count: np.ndarray, rate: float, seed: int) -> dict:
    """One pass of noise-contrastive estimation over the tokens, in place."""
    rng = np.random.default_rng(seed)
    flat, w1, w2 = tokens
    noise_share = (class_count + 1.0) / (class_count + 1.0).sum()
    ramp = np.cumsum(noise_share)
    log_noise = np.log(NOISE * noise_share).astype(np.float32)
    order = rng.permutation(len(flat))
    one = np.ones((1, 1), dtype=np.float32)
    for at in range(0, len(order), BATCH):
        pick = order[at:at + BATCH]
        w, x1, x2 = flat[pick], w1[pick], w2[pick]
        k = np.minimum(np.searchsorted(ramp, rng.random(NOISE)), len(ramp) - 1)
        r1, r2, qw, qk = p["r"][x1], p["r"][x2], p["q"][w], p["q"][k]
        h = r1 * p["c"][0] + r2 * p["c"][1]
        pos = (h * qw).sum(axis=1) + p["b"][w, 0] - log_noise[w]
        neg = h @ qk.T + (p["b"][k, 0] - log_noise[k])
        gp = 1.0 / (1.0 + np.exp(np.clip(pos, -30, 30)))  # pull of the true class
        gn = 1.0 / (1.0 + np.exp(np.clip(-neg, -30, 30)))  # push of each noise class
        dh = gp[:, None] * qw - gn @ qk
        both = np.hstack([gp[:, None] * h, gp[:, None] * one])
        noise = np.hstack([-(gn.T @ h), -gn.sum(axis=0)[:, None]])
        ids, g = _row_sums(np.concatenate([w, k]), np.vstack([both, noise]))
        _ascend(p, "q", ids, g[:, :-1], rate)
        _ascend(p, "b", ids, g[:, -1:], 0.1 * rate)
        ids, g = _row_sums(np.concatenate([x1, x2]), np.vstack([dh * p["c"][0], dh * p["c"][1]]))
        _ascend(p, "r", ids, g, rate)
        _ascend(p, "c", np.arange(2), np.stack([(dh * r1).sum(axis=0), (dh * r2).sum(axis=0)]), 0.1 * rate)
    return p


def normalised(p: dict) -> Model:
    a1 = (p["r"] * p["c"][0]) @ p["q"].T
    a2 = (p["r"] * p["c"][1]) @ p["q"].T + p["b"].T
    m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
    z = np.exp(a1 - m1) @ np.exp(a2 - m2).T
    np.log(np.maximum(z, 1e-30, out=z), out=z)
    z += m1
    z += m2.T
    return Model(a1, a2, z)


def token_logs(m: Model, tokens: tuple) -> np.ndarray:
    """log10 of the class probabilities of the tokens."""
    w, w1, w2 = tokens
    return (m.a1[w1, w].astype(np.float64) + m.a2[w2, w] - m.log_z[w1, w2]) / np.log(10)


def slices(sizes: list[int], most: int):
    """Ranges of neighbours whose sizes add up to ``most``, or of one larger one."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield at, end
        at = end


def _batches(batches, column: int = 0):
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        for a, b in in_parts(texts):
            yield batch, a, b, texts[a:b]


def count_words(train_docs: DataFrame, text: str) -> DataFrame:
    """``(word, c)`` over all training texts; tasks count before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64())])

    def run(batches):
        for _, _, _, texts in _batches(batches):
            n = Counter()
            for t in texts:
                n.update(words(t))
            yield pa.record_batch([pa.array(list(n.keys()), pa.binary()), pa.array(list(n.values()), pa.int64())], schema=schema)

    return train_docs.select(text).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    """Totals, the commonest words and the class sums of ``counts(word, c)``.

    The commonest are all words above a step of the counts, the lowest step that
    leaves at most ``LOOKUP`` of them."""
    step = F.floor(F.log2("c") * 64).cast("int")  # counts within about 1 %; few hundred steps
    held, least = 0, 1 << 30
    for r in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        held += r["count"]
        if held > LOOKUP:
            break
        least = r["s"]
    common = counts.filter(step >= least).select("word", "c").toArrow()  # LOOKUP rows at most
    lookup = dict(sorted(zip(common.column(0).to_pylist(), common.column(1).to_pylist()), key=lambda x: (-x[1], x[0])))
    head = {w: i + 1 for i, w in enumerate(list(lookup)[:HEAD - 1])}
    own = F.crc32(F.when(F.octet_length("word") > 3, F.expr("substring(word, octet_length(word) - 2, 3)")).otherwise(F.col("word"))) % TAIL + HEAD
    sums = counts.groupBy(own.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_count, distinct = np.zeros(HEAD + TAIL), np.zeros(HEAD + TAIL)
    for r in sums:
        class_count[r["k"]], distinct[r["k"]] = r["c"], r["n"]
    total, types = class_count.sum(), distinct.sum()
    for w, k in head.items():  # head words leave the tail class they hash to
        class_count[k] = lookup[w]
        class_count[tail_class(w)] -= lookup[w]
        distinct[tail_class(w)] -= 1
    class_count[END] = documents
    return Vocabulary(head, lookup, documents, int(total) + documents, int(types) + (documents > 0), class_count, np.log10(class_count + distinct + 1))


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(doc_id, training, key, n_tokens, known, base, inside, classes, rare, times)``
    of every ``(doc_id, training, text)``: the classes with the end (16 bits each), how
    many tokens are among the commonest words, their logs in the base score and (of tail
    classes) in the model's, the document's other words and how often it holds them."""
    lookup = {w: i for i, w in enumerate(vocab.counts)}
    shared = rows.sparkSession.sparkContext.broadcast((lookup, vocab.head, np.fromiter(vocab.counts.values(), dtype=np.int64, count=len(lookup))))  # LOOKUP counts
    log_n, end, known_end = float(np.log10(vocab.tokens + vocab.types + 1.0)), float(np.log10(vocab.end_count + 1.0)), int(vocab.end_count > 0)

    def run(batches):
        lookup, head, counts = shared.value
        get, logs = lookup.get, np.append(np.log10(counts + 1.0), 0.0)
        classes = np.fromiter((head.get(w) or tail_class(w) for w in lookup), dtype=np.uint16, count=len(lookup))
        classes, inside = np.append(classes, END).astype(np.uint16), np.append(np.where(classes >= HEAD, logs[:-1], 0.0), 0.0)
        for batch, a, b, texts in _batches(batches, 2):
            split = [words(t) for t in texts]
            n = len(split)
            size = np.fromiter(map(len, split), dtype=np.int64, count=n)
            flat = [w for t in split for w in t]
            at = np.fromiter((get(w, -1) for w in flat), dtype=np.int64, count=len(flat))
            own = np.repeat(np.arange(n), size)
            other = np.nonzero(at < 0)[0]
            rare = [flat[i] for i in other.tolist()]
            k = classes[at]
            k[other] = np.fromiter((tail_class(w) for w in rare), dtype=np.uint16, count=len(rare))
            ends = np.cumsum(size)
            raw = np.insert(k, ends, END).tobytes()  # an end behind every document
            cuts = [0, *(2 * (ends + np.arange(1, n + 1))).tolist()]
            times = Counter(zip(own[other].tolist(), rare))
            first = np.cumsum([0, *np.bincount(np.fromiter((d for d, _ in times), dtype=np.int64, count=len(times)), minlength=n)])
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(size + 1),
                pa.array(size - np.bincount(own[other], minlength=n) + known_end), pa.array(np.bincount(own, logs[at], minlength=n) + end - (size + 1) * log_n),
                pa.array(np.bincount(own, inside[at], minlength=n)), pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array([w for _, w in times], pa.binary())),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(list(times.values()), pa.int64())),
            ], names=["doc_id", "training", "n_tokens", "known", "base", "inside", "classes", "rare", "times"])

    found = rows.select("doc_id", "training", "text").mapInArrow(
        run, "doc_id long, training boolean, n_tokens long, known long, base double, inside double, classes binary, rare array<binary>, times array<long>")
    return materialize(found.withColumn("key", F.monotonically_increasing_id()))


def dealt(encoded: DataFrame) -> DataFrame:
    """The training documents with a hash of the row, ``h``."""
    return encoded.filter("training").select("n_tokens", "classes", F.xxhash64("doc_id", "classes").alias("h"))


def pilot(train_docs: DataFrame, vocab: Vocabulary) -> dict:
    """Start model from whole documents picked by hash, about ``PILOT_TOKENS`` tokens
    in all and twice as many at most (the averaged training covers all documents)."""
    p = start_parameters(vocab.class_count)
    share = F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PILOT_TOKENS / max(1, vocab.tokens)))
    picked = train_docs.filter(share & (F.col("n_tokens") <= PILOT_TOKENS)).select("h", "classes").distinct().collect()
    seqs, held = [], 0
    for r in sorted(picked, key=lambda r: (r["h"], bytes(r["classes"]))):
        held += len(r["classes"]) // 2
        if held <= 2 * PILOT_TOKENS:
            seqs.append(np.frombuffer(r["classes"], dtype="<u2").astype(np.int32))
    if seqs:
        for i in range(PILOT_ROUNDS):
            train(p, contexts(seqs), vocab.class_count, RATE, i)
    return p


_TABLES: dict[int, Model] = {}


def tables(p: dict, key: int) -> Model:
    """The worker's score tables of the parameters known by ``key``: made once."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = normalised(p)
    return _TABLES[key]


def stacked(p: dict) -> np.ndarray:
    """A model's parameters as rows: those of each class, then those of the two places."""
    return np.vstack([np.hstack([p["r"], p["q"], p["b"]]), np.hstack([p["c"], p["c"], np.zeros((2, 1), dtype=np.float32)])]).astype(np.float64)


def train_part(start: dict, documents, class_count: np.ndarray) -> tuple[np.ndarray, int]:
    """Parameters after one pass over a part's documents (class arrays, in order), and its tokens."""
    p, seen, held, size = {k: v.copy() for k, v in start.items()}, 0, [], 0
    for seq in documents:
        held.append(seq)
        size += len(seq)
        if size >= CHUNK_TOKENS:
            train(p, contexts(held), class_count, RATE, seen)
            seen, held, size = seen + size, [], 0
    if held:
        train(p, contexts(held), class_count, RATE, seen)
    return stacked(p), seen + size


def fit(train_docs: DataFrame, vocab: Vocabulary) -> dict:
    """Parameters from averaged noise-contrastive training over all tokens."""
    spark = train_docs.sparkSession
    begin = pilot(train_docs, vocab)
    shared = spark.sparkContext.broadcast((begin, vocab.class_count))
    parts = max(1, round(vocab.tokens / PART_TOKENS))

    def documents(batches):
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def run(batches):
        start, class_count = shared.value
        for _, rows in groupby(documents(batches), key=lambda r: r[0]):
            values, seen = train_part(start, (np.frombuffer(c, dtype="<u2").astype(np.int32) for _, c in rows), class_count)
            whole = np.rint(values * (seen * WHOLE)).astype(np.int64)
            yield pa.record_batch({"row": pa.array(np.arange(len(whole))), "n": pa.array(np.full(len(whole), seen)), "v": pa.array(list(whole), pa.list_(pa.int64()))})

    width = 2 * DIM + 1
    rows = train_docs.select(F.pmod("h", F.lit(parts)).alias("part"), "h", "classes").repartitionByRange(parts, "part").sortWithinPartitions("part", "h", "classes")
    copies = rows.select("part", "classes").mapInArrow(run, "row long, n long, v array<long>")
    mean = copies.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)]).collect()  # one model
    p, n = {k: v.copy() for k, v in begin.items()}, len(vocab.class_count)
    for r in mean:
        v = np.array([r[f"v{j}"] for j in range(width)]) / (r["n"] * WHOLE)
        if r["row"] < n:
            p["r"][r["row"]], p["q"][r["row"]], p["b"][r["row"]] = v[:DIM], v[DIM:2 * DIM], v[-1]
        else:
            p["c"][r["row"] - n] = v[:DIM]
    return {name: p[name] for name in ("r", "q", "c", "b")}


def score(docs: DataFrame, train_on: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``train_on`` picks the training rows. A null or empty text is its end alone;
    repeated rows are scored (and, if picked, counted) each; null ids stay null;
    other columns, whatever their names, play no part; texts of any length are whole.
    With no training row every word is unseen: the base has one place for it and
    the model's classes are all but uniform. Scores do not depend on how the table
    is partitioned.
    """
    spark = ship(docs)
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train_on, F.lit(False)).alias("training"))
    train_rows = rows.filter("training")
    counts = materialize(count_words(train_rows, "text"))
    vocab = vocabulary(counts, train_rows.count())
    encoded = encode(rows, vocab)
    shared = spark.sparkContext.broadcast((fit(dealt(encoded), vocab), vocab.tail_log))  # parameters
    known_as = shared._jbroadcast.id()

    def run(batches):
        p, tail_log = shared.value
        m = tables(p, known_as)
        for batch in batches:
            sizes = np.asarray(batch.column(1)).tolist()
            for a, b in slices(sizes, 1_000_000):
                seqs = [np.frombuffer(c, dtype="<u2").astype(np.int32) for c in batch.column(2).slice(a, b - a).to_pylist()]
                tokens = contexts(seqs)
                logs = token_logs(m, tokens)
                logs -= np.where(tokens[0] >= HEAD, tail_log[tokens[0]], 0.0)
                total = np.add.reduceat(logs, np.cumsum([0, *sizes[a:b - 1]]))
                yield pa.record_batch({"key": batch.column(0).slice(a, b - a), "model": pa.array(total)})

    by_class = encoded.select("key", "n_tokens", "classes").mapInArrow(run, "key long, model double")
    whole = encoded.select("key", "doc_id", "n_tokens", "known", "base", F.col("inside").alias("score"))
    model = by_class.select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), F.col("model").alias("score"))
    rare = encoded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("key", F.col("r.rare").alias("word"), F.col("r.times").alias("n")).join(counts, "word")
    log_c = F.col("n") * F.log10(F.col("c") + F.lit(1.0))  # a word that was not counted adds nothing
    rare = rare.select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.col("n").alias("known"), log_c.alias("base"), log_c.alias("score"))
    by = whole.unionByName(model).unionByName(rare).groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return by.select("doc_id", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")

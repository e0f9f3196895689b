"""Ranked lexical search by hashed max-sketches.

The queries (items) are the given set, all documents the searched one. Two scans
of the documents, neither of which shuffles them:

1. **Statistics**: documents with terms, all terms, and the document frequency of
   every query term, counted in the tasks and summed by term.
2. **Search**, block by block inside a task. A document's impacts (weight times
   saturated count) fold into a sketch of ``width`` hashed places, each the
   *maximum* of the impacts that fall there. One product of the block's sketches
   with the queries' hashed term counts gives an upper bound for every (document,
   query) of the block. Each query then rescores documents exactly in descending
   bound until the next bound cannot enter its ``k`` best; these best carry over
   to the task's next blocks, so bounds meet a rising threshold.

A task returns ``k`` rows a query; a window ranks them. Terms no query holds add
nothing to any score, so sketches leave them out; they count in lengths. Queries
are handled in sets of bounded size, each broadcast and searched by itself.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import materialize, ship

SET_BYTES, SET_ITEMS = 2_000_000, 1024  # text and number of the queries of one set
BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000  # documents scored at a time
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_LOWER = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_LOWER).split()


@dataclass(frozen=True)
class Queries:
    vocabulary: dict[bytes, int]
    held: list[np.ndarray]  # each query's different terms
    counts: list[np.ndarray]  # and how often it holds them
    width: int

    @staticmethod
    def of(texts: list[bytes], width: int) -> Queries:
        words = [terms(t) for t in texts]
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
        pairs = [np.unique([vocabulary[x] for x in w], return_counts=True) if w else (np.zeros(0, int), np.zeros(0, int)) for w in words]
        return Queries(vocabulary, [p[0].astype(np.int64) for p in pairs], [p[1].astype(np.int64) for p in pairs], width)

    def places(self) -> np.ndarray:
        """The sketch place of each term."""
        return np.array([zlib.crc32(w) % self.width for w in self.vocabulary], dtype=np.int64)

    def lookups(self) -> np.ndarray:
        """Width x queries: how often a query looks up a place."""
        out, at = np.zeros((self.width, len(self.held))), self.places()
        for q, (t, c) in enumerate(zip(self.held, self.counts)):
            np.add.at(out[:, q], at[t], c)
        return out


@dataclass(frozen=True)
class Statistics:
    documents: int  # N: with at least one term
    length: int  # L: all terms
    weights: np.ndarray  # w of each vocabulary term


def blocks(batches):
    """``(ids, words)`` of at most BLOCK_ROWS documents and about BLOCK_BYTES."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        at = 0
        while at < len(texts):
            end, size, words = at, 0, []
            while end < len(texts) and end - at < BLOCK_ROWS and size < BLOCK_BYTES:
                raw = texts[end].as_py() or b""
                words.append(raw)
                size += len(raw)
                end += 1
            yield ids.slice(at, end - at).to_pylist(), [terms(w) for w in words]
            at = end


def occurrences(words: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the vocabulary terms that the rows hold, by row and term."""
    found = [[vocabulary[w] for w in ws if w in vocabulary] for ws in words]
    rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
    flat = np.fromiter((t for x in found for t in x), dtype=np.int64, count=len(rows))
    keys, tf = np.unique(rows * max(1, len(vocabulary)) + flat, return_counts=True)
    return keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), tf


def statistics(docs: DataFrame, queries: Queries) -> Statistics:
    """N, L and the weights of the query terms, from all rows of ``(id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)  # terms of one bounded set

    def count(batches):
        df, n, length = np.zeros(len(shared.value), dtype=np.int64), 0, 0
        for _, words in blocks(batches):
            n += sum(1 for w in words if w)
            length += sum(map(len, words))
            df += np.bincount(occurrences(words, shared.value)[1], minlength=len(df))
        held = np.nonzero(df)[0]
        yield pd.DataFrame({"term": [-2, -1, *held.tolist()], "n": [n, length, *df[held].tolist()]})

    def arrow(batches):
        for frame in count(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    sums = {r["term"]: r["n"] for r in docs.mapInArrow(arrow, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(-2, 0)
    weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * sums.get(t, 0) + 1))) for t in range(len(queries.vocabulary))]
    return Statistics(n, sums.get(-1, 0), np.array(weights, dtype=np.int64))


class Best:
    """The ``k`` best (score, id) of one query so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def enters(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether rows of such scores (or bounds of them) would be among the best."""
        if len(self.ids) < self.k:
            return scores > 0
        return (scores > self.scores[-1]) | (scores == self.scores[-1]) & (ids < self.ids[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        keep = np.lexsort((i, -s))[:self.k]
        keep = keep[s[keep] > 0]
        self.scores, self.ids = s[keep], i[keep]


class Block:
    """Exact impacts and sketches of a block of documents."""

    def __init__(self, words: list[list[bytes]], queries: Queries, stats: Statistics, places: np.ndarray):
        self.size = max(1, len(queries.vocabulary))
        n = np.array([len(w) for w in words], dtype=np.int64)
        m = 100 - 25 + (25 * n * stats.documents) // max(1, stats.length)
        rows, held, tf = occurrences(words, queries.vocabulary)
        self.keys = rows * self.size + held
        self.impacts = stats.weights[held] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
        self.sketches = np.zeros((len(words), queries.width))
        np.maximum.at(self.sketches, (rows, places[held]), self.impacts)

    def bounds(self, lookups: np.ndarray) -> np.ndarray:
        """Rows x queries; above 2**53 rounded up, as doubles have gaps there."""
        out = self.sketches @ lookups
        return out * (1 + 1e-9) if out.size and out.max() >= 2.0 ** 53 else out

    def exact(self, rows: np.ndarray, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        want = rows[:, None] * self.size + held
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return (np.where(self.keys[at] == want, self.impacts[at], 0) * counts).sum(axis=1) if len(self.keys) else np.zeros(len(rows), dtype=np.int64)


def rescore(block: Block, bound: np.ndarray, ids: np.ndarray, held: np.ndarray, counts: np.ndarray, best: Best, step: int = 32) -> int:
    """Exact scores in descending bound until no further row can enter; their number."""
    rows = np.nonzero(best.enters(bound, ids))[0]
    rows = rows[np.lexsort((ids[rows], -bound[rows]))]
    for at in range(0, len(rows), step):
        part = rows[at:at + step]
        part = part[best.enters(bound[part], ids[part])]
        if not len(part):
            return at
        best.add(block.exact(part, held, counts), ids[part])
    return len(rows)


def search_set(docs: DataFrame, queries: Queries, stats: Statistics, k: int) -> DataFrame:
    """``(query, doc_id, score)``: each task's ``k`` best of every query of the set."""
    shared = docs.sparkSession.sparkContext.broadcast((queries, stats))  # one bounded set

    def run(batches):
        queries, stats = shared.value
        places, lookups = queries.places(), queries.lookups()
        best = [Best(k) for _ in queries.held]
        for ids, words in blocks(batches):
            words = [w if i is not None else [] for i, w in zip(ids, words)]
            own = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            block = Block(words, queries, stats, places)
            bounds = block.bounds(lookups)
            for q, b in enumerate(best):
                rescore(block, bounds[:, q], own, queries.held[q], queries.counts[q], b)
        yield pa.record_batch({"query": pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
                               "doc_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(b.ids for b in best)]), pa.int64()),
                               "score": pa.array(np.concatenate([np.zeros(0, np.int64), *(b.scores for b in best)]), pa.int64())})

    return docs.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 1024) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each different item's ``k`` highest-scoring
    documents with a score above 0, equal scores by ascending id.

    A null or empty text has no terms; a document without an id counts in the
    statistics and is not ranked; repeated documents rank each for themselves;
    repeated items (same id and text) are one; empty tables give no rows.
    """
    spark = ship(docs)
    rows = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).alias("text"))
    asked = materialize(items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct())
    size = asked.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).first()
    sets = max(1, -(-size["n"] // SET_ITEMS), -(-(size["b"] or 0) // SET_BYTES))
    out = None
    for s in range(sets):
        part = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == s).collect()
        queries = Queries.of([(r["text"] or "").encode() for r in part], width)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], f"query int, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found = search_set(rows, queries, statistics(rows, queries), k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # one bounded set
        out = found if out is None else out.unionByName(found)
    return out

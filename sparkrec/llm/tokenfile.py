"""Binary token files with Elias-Fano document boundaries.

A shard holds consecutive documents in ascending id order:

    magic 'EFT1' | id width 2 or 4 | documents | ids | first document id
    Elias-Fano: ends of the documents in the id array
    Elias-Fano: document ids less the first (documents with a null id come first)
    the ids of all documents, concatenated, little-endian

An Elias-Fano sequence of n ascending numbers below u keeps the ``l =
floor(log2(u / n))`` low bits packed and the high parts in unary, about ``2 + l``
bits a number. ``select`` finds the k-th one in the unary part from a sample of
every 512th, so the place of any document is found without a table of 64-bit
offsets.

Shards are written through Spark as rows of a Parquet table (``shard``,
``n_docs``, ``n_ids``, ``image``): any store Spark reaches will do, and a lost
executor's files are never seen. ``shard`` ascends with the document ids, and
offsets over the whole table come from the running sum of ``n_ids``.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrec.llm.common import broadcast_if_under, ship
from sparkrec.llm.tokens import encoder, in_parts

MAGIC = b"EFT1"
SAMPLE = 512
SHARD_IDS = 250_000  # a shard is closed at the first document end beyond this
PARTITION_BYTES = 16_000_000  # bytes of text a partition is made for
_HEAD = struct.Struct("<4sIQQqQ")  # magic, id width, documents, ids, first id, documents with a null id
_EF = struct.Struct("<QQIQQ")  # n, universe, low bits, bytes of low part, bytes of high part


class EliasFano:
    """Ascending numbers (each at most ``universe``) with select and search."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.universe, self.l, self.low, self.high = n, universe, low_bits, low, high
        per_byte = np.bitwise_count(high).astype(np.int64)
        self._before = np.concatenate(([0], np.cumsum(per_byte)))[::64]  # ones before every 64th byte

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        l = max(0, (int(universe) // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << l) - 1)
        bits = ((low[:, None] >> np.arange(l, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[ones] = 1
        return cls(n, int(universe), l, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.universe, self.l, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, universe, l, a, b = _EF.unpack_from(raw, at)
        at += _EF.size
        low, high = np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, universe, l, low, high), at + a + b

    def select(self, k: int) -> int:
        """Place of the k-th one (from 0) in the unary part."""
        block = int(np.searchsorted(self._before, k, side="right")) - 1
        part = np.unpackbits(self.high[64 * block:64 * block + 64], bitorder="little")
        return 512 * block + int(np.nonzero(part)[0][k - int(self._before[block])])

    def get(self, k: int) -> int:
        if self.l == 0:
            return self.select(k) - k
        first, last = k * self.l // 8, -(-(k + 1) * self.l // 8)
        word = int.from_bytes(self.low[first:last].tobytes(), "little") >> (k * self.l - 8 * first)
        return ((self.select(k) - k) << self.l) | (word & ((1 << self.l) - 1))

    def all(self) -> np.ndarray:
        high = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.l].reshape(self.n, self.l)
        low = np.zeros(self.n, dtype=np.uint64)
        for j in range(self.l):
            low |= bits[:, j].astype(np.uint64) << np.uint64(j)
        return (high << np.uint64(self.l)) | low


def shard_image(docs: list, ids: list[bytes], width: int) -> bytes:
    """Bytes of one shard: ``docs`` ascending, nulls first; ``ids`` as 32-bit."""
    sizes = np.fromiter((len(i) // 4 for i in ids), dtype=np.int64, count=len(ids))
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    known = [d for d in docs if d is not None]
    first = known[0] if known else 0
    gaps = np.array([d - first for d in known], dtype=np.uint64)
    flat = np.frombuffer(b"".join(ids), dtype="<u4").astype("<u2" if width == 2 else "<u4")
    return b"".join([_HEAD.pack(MAGIC, width, len(docs), total, first, len(docs) - len(known)), EliasFano.encode(ends, total).to_bytes(),
                     EliasFano.encode(gaps, int(gaps[-1]) if known else 0).to_bytes(), flat.tobytes()])


class Shard:
    """Random access to a shard's bytes."""

    def __init__(self, image: bytes):
        raw = memoryview(image)
        magic, self.width, self.n_docs, self.n_ids, self._first, self._nulls = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ends, at = EliasFano.from_bytes(raw, _HEAD.size)
        self._docs, at = EliasFano.from_bytes(raw, at)
        self.ids = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", self.n_ids, at)

    def doc_id(self, k: int):
        return None if k < self._nulls else self._first + self._docs.get(k - self._nulls)

    def doc_ids(self) -> list:
        return [None] * self._nulls + [self._first + int(g) for g in self._docs.all()]

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.get(k - 1) if k else 0), self.ends.get(k)

    def document(self, k: int) -> np.ndarray:
        a, b = self.span(k)
        return self.ids[a:b]

    def find(self, doc_id: int) -> int:
        """Place of the first document with this id, -1 if it is not here."""
        lo, hi = self._nulls, self.n_docs
        while lo < hi:
            mid = (lo + hi) // 2
            if self.doc_id(mid) < doc_id:
                lo = mid + 1
            else:
                hi = mid
        return lo if lo < self.n_docs and self.doc_id(lo) == doc_id else -1


def _to_shards(tokenizer, end_id: int):
    schema = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer.value)
        width = 2 if max(enc.vocab_size - 1, end_id) < 1 << 16 else 4
        number = TaskContext.get().partitionId() << 32
        docs, ids, held = [], [], 0

        def close():
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((number, len(docs), held, shard_image(docs, ids, width)), schema)], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_parts(texts):
                for doc, own in zip(names[a:b], enc.encode(texts[a:b])):
                    docs.append(doc)
                    ids.append(own + tail)
                    held += len(own) // 4 + 1
                    if held >= SHARD_IDS:
                        yield close()
                        number, docs, ids, held = number + 1, [], [], 0
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, doc: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Write all documents in ascending id order (null ids first, equal ids by
    their text's hash). A null or empty text is the end id alone; repeated rows
    are written each; an empty table writes a table without shards."""
    spark = ship(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(max(1, -(-size // PARTITION_BYTES)), *order).sortWithinPartitions(*order)
    shards = sorted_rows.mapInArrow(_to_shards(shared, end_id), "shard long, n_docs long, n_ids long, image binary")
    shards.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """``(shard, base)``: the ids in all shards before each. Sums of blocks of 1,024
    written partitions are added up first, then the shards inside each block, so no
    task sees more than a block or the blocks' sums."""
    rows = shards.select("shard", "n_ids", F.shiftright("shard", 42).alias("block"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n_ids").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return rows.join(blocks, "block").select("shard", (F.col("before") + F.col("inside")).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, ids)`` of every document: ``start`` counts the ids of all
    documents before it, ``ids`` are little-endian unsigned 32-bit. Each document's
    place comes from the shard's ``select``; no table of offsets is made."""
    shards = spark.read.parquet(path)
    n = shards.count()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for first, image in zip(batch.column(0), batch.column(1)):
                s, base, at, out = Shard(image.as_py()), first.as_py(), 0, ([], [], [])
                for k in range(s.n_docs):
                    end = s.ends.get(k)
                    for column, value in zip(out, (s.doc_id(k), base + at, s.ids[at:end].astype("<u4").tobytes())):
                        column.append(value)
                    at = end
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    joined = shards.select("shard", "image").join(broadcast_if_under(shard_offsets(shards), n, 2_000_000), "shard")
    ship(shards)
    return joined.select("base", "image").mapInArrow(run, "doc_id long, start long, ids binary")

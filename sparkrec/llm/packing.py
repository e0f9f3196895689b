"""Packing of documents into fixed-length sequences: first-fit decreasing with a
tournament tree, in randomised groups.

A document is tokenised whole and cut into pieces of ``length`` ids and a rest.
Every piece goes to a group by a hash of its document, text and place, so the
pieces of a very long document spread over the groups and each group holds a
bounded, random mix. Within a group

* full pieces are sequences of their own;
* rests are placed in decreasing size, each into the first sequence that has
  room; a tournament tree over the free room (the maximum of each subtree) finds
  it in ``log2(n)`` steps;
* what gaps remain are filled by cutting pieces of the emptiest sequences, so at
  most one sequence a group is not full.

The number of groups follows from the bytes of text, one cheap scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import ship_texts
from sparkrec.llm.tokens import encoder, in_parts

GROUP_BYTES = 6_000_000  # bytes of text a group is made for
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class FirstFit:
    """Tournament tree over the free room of ``n`` sequences."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Number of the first sequence with room for ``size``, which it takes."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        found = i - self.leaves
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
        return found


@dataclass
class Piece:
    row: int  # row of the group's table
    start: int  # ids of that row before the piece
    length: int


def pack_sizes(sizes: list[int], length: int) -> list[list[Piece]]:
    """Sequences of pieces: first-fit decreasing, then gaps filled from the emptiest."""
    order = sorted(range(len(sizes)), key=lambda r: (-sizes[r], r))
    tree = FirstFit(max(1, len(sizes)), length)
    bins: list[list[Piece]] = []
    for r in order:
        if sizes[r] == 0:
            continue
        b = tree.place(sizes[r])
        while b >= len(bins):
            bins.append([])
        bins[b].append(Piece(r, 0, sizes[r]))
    fill = [sum(p.length for p in b) for b in bins]
    by_fill = sorted(range(len(bins)), key=lambda b: (fill[b], -b))
    lo, hi = 0, len(by_fill) - 1
    while lo < hi:
        giver, taker = by_fill[lo], by_fill[hi]
        if fill[taker] == length:
            hi -= 1
        elif not bins[giver]:
            lo += 1
        else:
            piece = bins[giver].pop()
            n = min(piece.length, length - fill[taker])
            if n < piece.length:
                bins[giver].append(Piece(piece.row, piece.start + n, piece.length - n))
            bins[taker].append(Piece(piece.row, piece.start, n))
            fill[taker] += n
            fill[giver] -= n
    return [b for b in bins if b]


def pack_group(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start", "doc_tokens"], kind="stable", na_position="first").reset_index(drop=True)
    group, sizes = int(pdf["grp"].iloc[0]), pdf["length"].to_numpy()
    full = np.nonzero(sizes == length)[0].tolist()
    rest = np.nonzero(sizes != length)[0].tolist()
    sequences = [[Piece(r, 0, length)] for r in full]
    sequences += [[Piece(rest[p.row], p.start, p.length) for p in b] for b in pack_sizes([int(sizes[r]) for r in rest], length)]
    rows, starts, lengths, seq, offsets, ids = [], [], [], [], [], []
    raw, width = pdf["ids"].tolist(), len(pdf["ids"].iloc[0]) // int(sizes[0])
    base = pdf["start"].tolist()
    for s, pieces in enumerate(sequences):
        at = 0
        for p in pieces:
            rows.append(p.row)
            starts.append(base[p.row] + p.start)
            lengths.append(p.length)
            seq.append((group << 32) | s)
            offsets.append(at)
            ids.append(raw[p.row][width * p.start:width * (p.start + p.length)])
            at += p.length
    return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows].array, "start": starts, "length": lengths, "doc_tokens": pdf["doc_tokens"].iloc[rows].array,
                         "sequence_id": seq, "offset": offsets, "ids": ids if width == 4 else [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]})


def cut_documents(tokenizer_json, end_id: int, length: int, groups: int, seed: int):
    """mapInArrow function: documents to the pieces of their ids, which cross the
    shuffle in 16 bits where the vocabulary has no more."""
    schema = pa.schema([("grp", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        enc = encoder(tokenizer_json.value)
        small = max(enc.vocab_size, end_id + 1) <= 1 << 16
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_parts(texts):
                out = ([], [], [], [], [], [])
                for doc, text, ids in zip(docs[a:b], texts[a:b], enc.encode(texts[a:b])):
                    ids += tail
                    n, width = len(ids) // 4, 4
                    if small:
                        ids, width = np.frombuffer(ids, "<u4").astype("<u2").tobytes(), 2
                    own = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
                    for start in range(0, n, length):
                        size = min(length, n - start)
                        row = (xxhash.xxh64_intdigest(f"{doc}:{own}:{start}", seed) % groups, doc, start, size, n, ids[width * start:width * (start + size)])
                        for c, v in zip(out, row):
                            c.append(v)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, doc: str = "doc_id", text: str = "text", end_id: int = 0, length: int = 1024, seed: int = 17) -> DataFrame:
    """Pieces of all documents, placed: ``(doc_id, start, length, doc_tokens,
    sequence_id, offset, ids)``, ``ids`` as little-endian unsigned 32-bit.

    ``doc_tokens`` counts the end id, which every document has: a null or empty
    text is that id alone. Repeated rows are packed each for themselves; null
    ids stay null; an empty table gives no piece.
    """
    spark = ship_texts(docs)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    groups = max(1, -(-((size["b"] or 0) + size["n"]) // GROUP_BYTES))
    cut = rows.mapInArrow(cut_documents(shared, end_id, length, groups, seed), "grp long, doc_id long, start long, length long, doc_tokens long, ids binary")
    return cut.groupBy("grp").applyInPandas(lambda pdf: pack_group(pdf, length), SCHEMA)

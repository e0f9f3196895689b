"""Byte-level BPE by recursive DuckDB queries, one in-process database a Python worker.

Spark partitions the documents; a task hands its texts, in parts of bounded size,
to its worker's in-memory database (one thread, a memory limit, no files):

* A pattern splits a text into words; each word is encoded apart. A text is
  first cut into pieces at places where a word surely begins (``cuts``: a single
  space between two other characters); pieces and words met before come from
  bounded tables.
* **Encoding** is a recursive query over token-position rows ``(word, place,
  id)``. Each round joins neighbouring tokens with the merge table ``(left,
  right, merged)``, finds every word's least merged rank and contracts the
  leftmost pair of that rank; a word without a pair left is done. A word that is a
  token itself needs no round.
* Rounds of words over LONG_BYTES are kept by word and place instead of being
  added up, and contract further pairs of the same rank in the same round, up
  to the first contraction that brings up a pair of a lower rank, which is what
  one-by-one contraction from the left does.
* **Decoding** joins the ids with the vocabulary and strings the tokens of a
  document together in an aggregate ordered by place.

The merge table is derived in the database from the rank file: every cut of a
token into two tokens is a pair that merges into it.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import ship
from sparkrec.llm.tokens import _CUT, _irregular, in_parts

KEEP = 400_000  # pieces kept by a worker, twice at most
KEEP_BYTES = 64  # longer ones are not kept
PART_CHARS = 2_000_000  # text handled at a time
STEP_BYTES = 400_000  # bytes of words, and ids of documents, of one query
LONG_BYTES = 200  # of a word, from which its rounds are kept by place

_SETUP = """
CREATE TABLE vocab AS SELECT * FROM file_rows;
CREATE TABLE merges AS
SELECT a.id AS l, b.id AS r, v.id AS k
FROM (SELECT id, token, unnest(range(1, length(token))) AS cut FROM vocab) v
JOIN vocab a ON a.token = substr(v.token, 1, cut) JOIN vocab b ON b.token = substr(v.token, cut + 1);
"""

# start(w, p, id): the bytes of the words; a place g is (word << 16 | place in the word)
_ENCODE = """
WITH RECURSIVE t(g, id, done) AS (
  SELECT (w::BIGINT << 16) | p, id, false FROM start
  UNION ALL
  (WITH active AS (SELECT g, id FROM t WHERE NOT done),
   pairs AS (SELECT g, id, lead(id) OVER o AS next, lead(g) OVER o AS g2 FROM active WINDOW o AS (ORDER BY g)),
   least AS (SELECT g >> 16 AS w, min((k::BIGINT << 32) | ((g & 65535) << 16) | (g2 & 65535)) AS b
             FROM pairs JOIN merges ON l = id AND r = next WHERE (g >> 16) = (g2 >> 16) GROUP BY g >> 16)
   SELECT a.g, CASE WHEN (a.g & 65535) = ((b >> 16) & 65535) THEN (b >> 32)::INT ELSE a.id END, b IS NULL
   FROM active a LEFT JOIN least ON least.w = (a.g >> 16) WHERE b IS NULL OR (a.g & 65535) <> (b & 65535))
)
SELECT (g >> 16)::INT AS w, id FROM t WHERE done ORDER BY g
"""

_ENCODE_LONG = """
WITH RECURSIVE t(w, p, id) USING KEY (w, p) AS (
  SELECT w, p, id FROM start
  UNION ALL
  (WITH pairs AS (
     SELECT w, p, id, lead(p) OVER o AS p2, lag(id) OVER o AS before, lead(id) OVER o AS next, lead(id, 2) OVER o AS after,
            row_number() OVER o AS i FROM t WHERE id IS NOT NULL WINDOW o AS (PARTITION BY w ORDER BY p)),
   ranked AS (SELECT q.*, m.k, min(m.k) OVER (PARTITION BY q.w) AS best FROM pairs q LEFT JOIN merges m ON m.l = q.id AND m.r = q.next),
   least AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY p) AS run FROM ranked WHERE k = best),
   apart AS (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS j FROM least),
   chosen AS (SELECT w, p, p2, k, CASE WHEN j > 1 THEN k ELSE before END AS before, after, row_number() OVER (PARTITION BY w ORDER BY p) AS h FROM apart WHERE j % 2 = 1),
   lower_next AS (SELECT c.w, min(c.h) AS h FROM chosen c LEFT JOIN merges x ON x.l = c.before AND x.r = c.k LEFT JOIN merges y ON y.l = c.k AND y.r = c.after
                  WHERE x.k < c.k OR y.k < c.k GROUP BY c.w),
   merged AS (SELECT c.* FROM chosen c LEFT JOIN lower_next s ON s.w = c.w WHERE s.h IS NULL OR c.h <= s.h)
   SELECT a.w, a.p, CASE WHEN g.keep THEN g.k WHEN g.keep IS NULL THEN a.id END
   FROM ranked a LEFT JOIN (SELECT w, p AS at, k, true AS keep FROM merged UNION ALL SELECT w, p2, k, false FROM merged) g ON g.w = a.w AND g.at = a.p
   WHERE a.best IS NOT NULL)
)
SELECT w, id FROM t WHERE id IS NOT NULL ORDER BY w, p
"""

_DECODE = "SELECT d, array_to_string(list(token ORDER BY p), '') AS text, count(*) AS n FROM ids JOIN vocab USING (id) GROUP BY d"


def slices(sizes: list[int], most: int):
    """Ranges of neighbours whose sizes add up to ``most``, or of one larger item."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield at, end
        at = end


class Known:
    """Ids by text in two generations: a full one becomes the old one, from which
    entries still in use move over."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.new) > KEEP:
            self.new, self.old = {}, self.new

    def fill(self, asked: set[str], learn):
        """Look-up function for all ``asked``; ``learn`` is given those not met before."""
        missing = asked.difference(self.new)
        again = {x for x in missing if x in self.old}
        self.new.update((x, self.old[x]) for x in again)
        missing -= again
        if not missing:
            return self.new.__getitem__
        fresh = learn(missing)
        long = {x: ids for x, ids in fresh.items() if len(x) > KEEP_BYTES}
        self.new.update(fresh if not long else ((x, ids) for x, ids in fresh.items() if x not in long))
        return (self.new | long).__getitem__ if long else self.new.__getitem__


class Bpe:
    """Encoder and decoder of one rank file (lines of base64 token and rank).

    A byte is the Latin-1 character of its value in the database. ``cuts`` says that
    the pattern begins a word at every single space between two other characters,
    and that such a space with ASCII letters up to the next is one word."""

    def __init__(self, rank_file: bytes, pattern: str, cuts: bool = True):
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        rows = [line.split() for line in rank_file.splitlines() if line.strip()]
        tokens, ids = [base64.b64decode(r[0]) for r in rows], [int(r[1]) for r in rows]
        self.token_id = {t: np.uint32(i).tobytes() for t, i in zip(tokens, ids)}
        if any(bytes([b]) not in self.token_id for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.byte_id = np.frombuffer(b"".join(self.token_id[bytes([b])] for b in range(256)), dtype=np.int32)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("file_rows", pd.DataFrame({"id": np.array(ids, dtype=np.int32), "token": [t.decode("latin-1") for t in tokens]}))
        self.db.execute(_SETUP)
        self.db.unregister("file_rows")
        self.cuts = cuts
        self.spaced, self.others = Known(), Known()  # what stands after a space; words without one

    def _query(self, sql: str, **tables) -> dict:
        for name, frame in tables.items():
            self.db.register(name, frame)
        found = self.db.execute(sql).fetchnumpy()
        for name in tables:
            self.db.unregister(name)
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words, as little-endian unsigned 32-bit."""
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        out = {w: self.token_id[x] for w, x in raw.items() if x in self.token_id}
        rest = [w for w in words if w not in out]
        for sql, of in ((_ENCODE, [w for w in rest if len(raw[w]) <= LONG_BYTES]), (_ENCODE_LONG, [w for w in rest if len(raw[w]) > LONG_BYTES])):
            for a, b in slices([len(raw[w]) for w in of], STEP_BYTES):
                part = [raw[w] for w in of[a:b]]
                size = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
                flat = np.frombuffer(b"".join(part), dtype=np.uint8)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                start = pd.DataFrame({"w": np.repeat(np.arange(len(part), dtype=np.int32), size), "p": place.astype(np.int32), "id": self.byte_id[flat]})
                got = self._query(sql, start=start)
                ids, at = np.asarray(got["id"], dtype="<u4").tobytes(), 4 * np.searchsorted(np.asarray(got["w"]), np.arange(len(part) + 1))
                out.update((w, ids[at[j]:at[j + 1]]) for j, w in enumerate(of[a:b]))
        return out

    def _learn_spaced(self, words: set[str]) -> dict[str, bytes]:
        return {w[1:]: ids for w, ids in self.learn([" " + w for w in words]).items()}

    def of_words(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of words."""
        every = set().union(*lists)
        after = {w[1:] for w in every if w[0] == " "}
        spaced = self.spaced.fill(after, self._learn_spaced)
        other = self.others.fill({w for w in every if w[0] != " "}, lambda ws: self.learn(list(ws)))
        return [b"".join([spaced(w[1:]) if w[0] == " " else other(w) for w in ws]) for ws in lists]

    def of_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces as they stand in a text: after a space, but for those that begin with a line feed."""
        letters = {p for p in pieces if p.isascii() and p.isalpha()}
        out = self._learn_spaced(letters)
        self.spaced.new.update(out)
        rest = list(pieces - letters)
        out.update(zip(rest, self.of_words([self.split(p if p[:1] == "\n" else " " + p) for p in rest])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit."""
        self.spaced.age()
        self.others.age()
        if not self.cuts:
            return self.of_words([self.split(t) for t in texts])
        cut = [_CUT.split(t) if _irregular(t) else t.replace("\n", " \n").split(" ") for t in texts]
        first = self.of_words([self.split(c[0]) for c in cut])
        rest = [c[1:] for c in cut]
        found = self.spaced.fill(set().union(*rest), self.of_pieces)
        return [f + b"".join(map(found, ps)) for f, ps in zip(first, rest)]

    def decode(self, ids: list[bytes]) -> list[bytes | None]:
        """Bytes of each id sequence; None where an id is not in the vocabulary."""
        out: list[bytes | None] = []
        for a, b in slices([len(x) // 4 for x in ids], STEP_BYTES):
            part = ids[a:b]
            size = np.array([len(x) // 4 for x in part], dtype=np.int64)
            flat = np.frombuffer(b"".join(part), dtype="<u4").astype(np.int64)
            frame = pd.DataFrame({"d": np.repeat(np.arange(len(part), dtype=np.int32), size), "p": np.arange(len(flat), dtype=np.int64), "id": flat})
            got = self._query(_DECODE, ids=frame)
            found = {int(d): t.encode("latin-1") for d, t, n in zip(got["d"], got["text"], got["n"]) if n == size[d]}
            out += [found.get(d, b"" if not size[d] else None) for d in range(len(part))]
        return out


_WORKER: dict[int, Bpe] = {}


def of_worker(rank_file: bytes, pattern: str) -> Bpe:
    key = hash((rank_file, pattern))
    if key not in _WORKER:
        _WORKER[key] = Bpe(rank_file, pattern)
    return _WORKER[key]


def _ids_array(ids: list[bytes]) -> pa.Array:
    size = np.array([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _ids_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else np.array(x, dtype="<i8").astype("<u4").tobytes() for x in column.to_pylist()]


def _run(df: DataFrame, ranks_path: str, pattern: str, schema: str, encode: bool, decode: bool) -> DataFrame:
    """Each ``(doc_id, text or ids)`` row with its ids and, if asked, its decoded bytes."""
    spark = ship(df)
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB

    def run(batches):
        bpe = of_worker(shared.value, pattern)
        for batch in batches:
            given = [t or "" for t in batch.column(1).to_pylist()] if encode else _ids_bytes(batch.column(1))
            for a, b in in_parts(given, PART_CHARS):
                ids = bpe.encode(given[a:b]) if encode else given[a:b]
                columns = [batch.column(0).slice(a, b - a), _ids_array(ids)]
                if decode:
                    columns.append(pa.array(bpe.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][:len(columns)])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: each row's id and the BPE ids of its whole text (an array).

    A null or empty text has no ids; repeated rows are encoded each for
    themselves; null ids stay null; an empty table gives an empty one; other
    columns, whatever their names, play no part. Special tokens are ordinary text.
    """
    return _run(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")), ranks_path, pattern, "doc_id long, ids array<int>", True, False)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes that the ids stand for. No ids (or a
    null) give no bytes, an id outside the vocabulary a null."""
    rows = encoded.select(F.col(doc).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return _run(rows, ranks_path, pattern, "doc_id long, ids array<int>, decoded binary", False, True)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encode` and then :func:`decode` of these
    ids in one pass, with one database a worker; edge cases as in both."""
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _run(rows, ranks_path, pattern, "doc_id long, ids array<int>, decoded binary", True, True)

import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from sparkrec.llm import bpe
from sparkrec.llm.q_bpe import op11_byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(x):
    return hashlib.sha256(x).hexdigest()


def check(rows, got):
    enc = library()
    want = []
    for doc, text in rows:
        ids = enc.encode_ordinary(text or "")
        want.append((doc, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    def order(r):
        return (r[0] is None, r[0] or 0, r[2])

    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_all_documents_as_the_library(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, op11_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_odd_texts(spark, tables):
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, " "), (4, "a" * 50_000), (5, " the the  the\n\n\t the "), (6, "naïve Ünï 漢字かな交じり文 🙂🙂  x"), (7, "<|endoftext|> x<|endoftext|>"),
            (8, "".join(rnd.choice("abcdefghij") for _ in range(1500))), (9, "ab" * 3000 + "the" * 3000 + " " * 4000 + "=" * 999), (10, "I'll we've don't 12345 1/2 x_y"),
            (11, "\x00\x01\x7f"), (12, "words " * 100_000), (2, ""), (None, "no id"), (13, "theoretical thethethe aaaaaaa bbb" * 7)]
    path = tables(documents=("doc_id long, text string, ids string, decoded int", [(*r, "x", 1) for r in rows]))
    check(rows, op11_byte_bpe(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())


def test_random_words_contract_like_the_library():
    rnd, enc = random.Random(8), library()
    own, uncut = bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN), bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN, cuts=False)
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 60))) for alphabet in ("ab", "the ", "aeinrst", "é漢 x", "01.- ") for _ in range(300)]
    texts += ["".join(rnd.choice(["a", "1", "'s", "?", " ", " ", "\n", "\t", "\x1c", "\u00a0", "\u2003", "\x85"]) for _ in range(12)) for _ in range(3000)]
    ids = own.encode(texts)
    assert ids == uncut.encode(texts)
    assert [list(memoryview(x).cast("I")) for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]


def test_words_of_both_generations(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 3)
    own, enc = bpe.Bpe(open(RANKS, "rb").read(), public_tokenizers.PATTERN), library()
    for text in ("one two three four five", "two three six seven eight nine", "one two three", "x" * 500 + " two"):
        assert list(memoryview(own.encode([text])[0]).cast("I")) == enc.encode_ordinary(text)


def test_apart_and_unknown_ids(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: b"hello world", 2: b""}
    odd = spark.createDataFrame([(1, [15339, 99_999_999]), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(odd, RANKS, public_tokenizers.PATTERN).collect()} == {1: None, 2: b""}
    empty = bpe.round_trip(docs.filter(F.lit(False)), RANKS, public_tokenizers.PATTERN)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0

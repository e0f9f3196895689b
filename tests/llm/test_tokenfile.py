import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkrec.llm import tokenfile
from sparkrec.llm.q_tokenfile import op6_token_files


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(spark, path):
    got = op6_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted(map(tuple, got), key=lambda r: r[1])


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, sf) == brute(rows)


def test_odd_rows_over_several_shards(spark, tables, monkeypatch):
    rows = [(5, None), (-3, ""), (2**62, "x y"), (-(2**62), "é ß"), (7, "again"), (7, "again"), (8, "word " * 3000), (None, "nobody"), (11, "one <|endoftext|> two <|startoftext|>"), (12, "<|ENDOFTEXT|>")]
    path = tables(documents=("doc_id long, text string, shard string, image int", [(*r, "x", 1) for r in rows]))
    assert run(spark, path) == brute(rows)


def test_empty_table(spark, tables):
    assert run(spark, tables(documents=("doc_id long, text string", []))) == []


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 0), (1, 0), (1, 2**40), (700, 3), (700, 10**6), (3000, 2**63 + 5)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        raw = tokenfile.EliasFano.encode(values, int(values[-1]) if n else 0).to_bytes()
        ef, end = tokenfile.EliasFano.from_bytes(memoryview(raw), 0)
        assert end == len(raw) and ef.all().tolist() == values.tolist()
        assert [ef.get(k) for k in range(n)] == values.tolist()
        if n >= 700:
            assert 8 * len(raw) < n * (3 + max(0, int(values[-1] // n).bit_length())) + 8 * 64


def test_shard_random_access():
    docs = [None, None, -4, -4, 9, 2**50]
    ids = [np.arange(i, dtype="<u4").tobytes() for i in (1, 0, 3, 2, 600, 5)]
    for width in (2, 4):
        s = tokenfile.Shard(tokenfile.shard_image(docs, ids, width))
        assert s.doc_ids() == docs and [s.doc_id(k) for k in range(6)] == docs
        assert [s.document(k).tolist() for k in range(6)] == [np.frombuffer(i, "<u4").tolist() for i in ids]
        assert (s.find(-4), s.find(2**50), s.find(10)) == (2, 5, -1)


def test_offsets_over_blocks_of_partitions(spark):
    rows = [((p << 32) + i, 1, (p * 7 + i) % 50 + 1) for p in range(0, 5000, 3) for i in range(p % 3 + 1)]
    got = {r["shard"]: r["base"] for r in tokenfile.shard_offsets(spark.createDataFrame(rows, "shard long, n_docs long, n_ids long")).collect()}
    at = 0
    for shard, _, n in rows:
        assert got[shard] == at
        at += n

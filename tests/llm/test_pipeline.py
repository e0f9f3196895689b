import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkrec.llm import langid, secrets

from test_decontam import brute as brute_contamination
from test_langid import brute_language
from test_packing import check as check_packing
from test_secrets import brute_base, brute_entropy
from test_simhash import brute_classes


def brute_mask(text):
    base = brute_base(text)
    spans = sorted(base + [e for e in brute_entropy(text) if not any(a <= e[0] and e[2] <= b for a, _, b in base)])
    out, at = [], 0
    merged = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:] if spans else text


def brute_run(docs, items, model):
    rows = []
    for r in docs:
        lang, letters, phrases = brute_language(r["text"], model)
        if lang != "und" and (letters < 20 or phrases <= 0.6 * letters):
            rows.append(r)
    kept = {d for d, _, c in brute_classes([(r["doc_id"], r["text"]) for r in rows]) if d == c}
    rows = [r for r in rows if r["doc_id"] in kept]
    bad = {b[0] for b in brute_contamination([(r["doc_id"], r["text"]) for r in rows], items) if b[5]}
    return [(r["doc_id"], brute_mask(r["text"])) for r in rows if r["doc_id"] not in bad]


def test_pipeline_equals_brute_force(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    want = brute_run(docs, items, model)
    assert 0 < len(want) < len(docs)
    pieces = corpus_pipeline.run(spark, sf).withColumn("ids_crc32", F.crc32("ids")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    padding, _ = check_packing(pieces, want, tokenizer)
    assert padding < 1024


def stages(spark, docs, path):
    out = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        out.append(docs)
    return out


WORDS = "the and of with this that from they have been were said each which their time will way about many then them"


def test_stages_keep_columns_and_odd_rows(spark, tables):
    clean = [(i, " ".join(WORDS.split()[i:]) + f" number {i}", "en", "s", 0) for i in range(1, 6)]
    rows = clean + [(10, clean[0][1], "en", "s", 0), (11, None, "en", "s", 0), (12, "", None, "s", 0), (13, "12 34 !!", "en", "s", 0), (1, clean[0][1], "en", "s", 0),
                    (None, "they have been here before and will be there again", "en", None, None), (20, "bench mark one two three four five six seven eight nine", "en", "s", 0),
                    (21, "and this is the token = abcdefgh12345 that they said", "en", "s", 0)]
    path = tables(documents=("doc_id long, text string, lang string, source string, n_chars long", rows),
                  benchmark=("item_id long, text string", [(1, "Bench mark one two three four five six seven eight nine ten"), (None, None), (2, "")]))
    got = stages(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in got)
    ids = [sorted((r["doc_id"] for r in d.collect()), key=str) for d in got]
    assert not {11, 12, 13} & set(ids[0]) and {1, 10, 20, 21, None} <= set(ids[0])
    assert ids[1].count(1) == 1 and 10 not in ids[1] and None in ids[1]
    assert 20 not in ids[2] and set(ids[2]) == set(ids[1]) - {20}
    last = {r["doc_id"]: r for r in got[3].collect()}
    assert last[21]["text"] == "and this is the [SECRET] that they said" and last[21]["n_chars"] == len(last[21]["text"])
    assert last[2]["text"] == clean[1][1]


def test_empty_tables(spark, tables):
    path = tables(documents=("doc_id long, text string, lang string, source string, n_chars long", []), benchmark=("item_id long, text string", []))
    assert corpus_pipeline.run(spark, path).collect() == []
    assert re.fullmatch(r"[\w-]+", secrets.KINDS[0])

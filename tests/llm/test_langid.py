import math

import numpy as np

from sparkrec.llm import langid
from sparkrec.llm.q_langid import op1_language_id


def normal(text, alphabet):
    out = []
    for ch in text or "":
        low = ch.lower()[0] if ch.isalpha() else " "
        if not ch.isalpha():
            if not out or out[-1] != " ":
                out.append(" ")
        else:
            out.append(low if low in alphabet else "?")
    return out


def brute_parse(chars, reference):
    """Phrases of a greedy parse into substrings of the reference, cut at segment ends."""
    count = 0
    for at in range(0, len(chars), langid.SEGMENT):
        part, i = chars[at:at + langid.SEGMENT], 0
        while i < len(part):
            n = 1
            while i + n <= len(part) and "?" not in part[i:i + n] and "".join(part[i:i + n]) in reference:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def automaton_phrases(chars, model, k):
    """Phrases by walking the model's table one character at a time."""
    width, index = len(model.alphabet) + 2, {c: i + 2 for i, c in enumerate(model.alphabet)} | {" ": 1, "?": 0}
    count = 0
    for at in range(0, len(chars), langid.SEGMENT):
        state = int(model.roots[k])
        for c in chars[at:at + langid.SEGMENT]:
            v = int(model.table[state * width + index[c]])
            state, count = v & langid._STATE, count + (v >> langid._STATE_BITS)
        count += state != model.roots[k]
    return count


def brute_language(text, model):
    chars = normal(text, set(model.alphabet))
    letters = sum(c != " " for c in chars)
    if not letters:
        return "und", 0, 0
    counts = [automaton_phrases(chars, model, k) for k in range(len(model.langs))]
    best = min(range(len(counts)), key=lambda k: (counts[k] * model.bits[k], k))
    return model.langs[best], letters, counts[best]


def test_held_out_accuracy_and_whole_texts(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and 0.2 < len(held) / len(rows) < 0.3
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_parse_equals_brute_force():
    references = {"aa": "banana bandana cabana " * 3, "bb": "mississippi river sip " * 3}
    model = langid.build_model(references)
    texts = ["bananas", "sip a river", "BANANA  mississippi!", "", "123", "ж banana ж", "xyz", "ban" * 1500, "cabana river " * 400]
    codes, starts = langid.encode(texts, model.alphabet)
    got = langid.cross_parse(codes, starts, model)
    for row, t in zip(got, texts):
        chars = normal(t, set(model.alphabet))
        for k, lang in enumerate(model.langs):
            ref = "".join(normal(references[lang], set(model.alphabet)))
            assert row[k] == brute_parse(chars, ref) == automaton_phrases(chars, model, k)
    assert math.isclose(model.bits[0], math.log2(len("".join(normal(references["aa"], set(model.alphabet))))))


def test_odd_rows(spark, tables):
    text = "the quick brown fox and the lazy dog went over the hill " * 3
    autre = "le renard brun et le chien paresseux sont dans la colline " * 3
    rows = [(i, text if i % 2 else autre, "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 !!", "en"), (103, "the dog", None), (104, "x" * 50_000 + " the", None), (None, "le chien", "fr"), (100, None, "en")]
    path = tables(documents=("doc_id long, text string, lang string, score string, lang_pred int", [(*r, "x", 1) for r in rows]))
    got = {}
    for r in op1_language_id(spark, path).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert got[100] == [("und", 0.0)] * 2 and got[101] == [("und", 0.0)] and got[102] == [("und", 0.0)]
    assert got[103][0][0] == "en" and got[None][0][0] == "fr" and got[1][0][0] == "en" and got[2][0][0] == "fr"
    assert got[104][0][0] in ("en", "fr")


def test_empty_and_unlabelled(spark, tables, tmp_path):
    assert op1_language_id(spark, tables(documents=("doc_id long, text string, lang string", []))).collect() == []
    spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/u/documents.parquet")
    assert [(r["lang_pred"], r["score"]) for r in op1_language_id(spark, f"{tmp_path}/u").collect()] == [("und", 0.0)]
    assert np.array_equal(langid.encode([], "ab")[1], [0])


def test_a_rare_label_does_not_shorten_the_other_references(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "les mots de la mer et du vent.", "xx")], "doc_id long, text string, lang string")
    alone, both = langid.fit(docs), langid.fit(docs.unionByName(rare))
    assert set(both.langs) == {*alone.langs, "xx"}
    own = dict(zip(both.langs, both.bits))
    assert all(abs(own[k] - b) < 1e-9 for k, b in zip(alone.langs, alone.bits)) and min(alone.bits) > math.log2(10_000) and own["xx"] < 5
    texts = [r["text"] for r in docs.filter("length(text) between 20 and 400").orderBy("doc_id").limit(300).collect()]
    a, b = langid.predict_batch(texts, alone), langid.predict_batch(texts, both)
    assert a["lang"].tolist() == b["lang"].tolist() and a["phrases"].tolist() == b["phrases"].tolist()
    junk = spark.createDataFrame([("qxzj wvkq zzxq jjkw pqxv " * 4,), (texts[0],)], "text string")
    assert [r["text"] for r in langid.keep_identified(junk, both).collect()] == [r["text"] for r in langid.keep_identified(junk, alone).collect()] == [texts[0]]


def test_every_reference_letter_counts_in_a_large_alphabet(monkeypatch):
    rng = np.random.default_rng(4)
    common = "".join(chr(0x4E00 + i) for i in rng.integers(0, 1500, 6000))
    rare = "".join(chr(0x4E00 + i) for i in range(2000, 4500))  # each once: beyond the 2,048 commonest
    references = {"aa": common, "bb": common[:3000] + rare, "cc": "plain words " * 20}
    model = langid.build_model(references)
    assert model.edges is not None and set(common + rare) <= set(model.alphabet)
    texts = [rare[100:400], common[50:90] + rare[7:50], "plain wordsж", "ж", "", rare[::-1][:3000], "words " + common[5000:5100]]
    codes, starts = langid.encode(texts, model.alphabet)
    got = langid.cross_parse(codes, starts, model)
    for row, t in zip(got, texts):
        chars = normal(t, set(model.alphabet))
        assert row.tolist() == [brute_parse(chars, "".join(normal(references[k], set(model.alphabet)))) for k in model.langs]
    assert got[0][1] == 1
    # the dense and the sparse table agree
    small = {"aa": "banana bandana cabana " * 3, "bb": "mississippi river sip " * 3}
    dense = langid.build_model(small)
    monkeypatch.setattr(langid, "DENSE_BYTES", 1000)
    sparse = langid.build_model(small)
    codes, starts = langid.encode(["bananas sip", "ж banana ж", "ban" * 1500, ""], dense.alphabet)
    assert dense.edges is None and np.array_equal(langid.cross_parse(codes, starts, dense), langid.cross_parse(codes, starts, sparse))


def test_table_size_decides_and_empty_labels_count(spark):
    """Four languages of 400 letters each would make a dense table of hundreds of MB."""
    rng = np.random.default_rng(7)
    references = {f"l{i}": "".join(chr(0x4E00 + 400 * i + j) for j in rng.integers(0, 400, 20_000)) for i in range(4)}
    model = langid.build_model(references)
    assert model.edges is not None and model.table.nbytes + model.edges.nbytes + model.restarts.nbytes < 10_000_000
    rows = [(i, "mots de la mer et du vent " * 4, "") for i in range(5)] + [(9, "words of the sea and the wind " * 4, "en")]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.langs == ("", "en")

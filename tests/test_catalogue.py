import json

import pytest

from sparkrec.operators import backfill as BF
from sparkrec.operators.catalogue import build_catalogue
from sparkrec.sources import io as IO

PLOT = " ".join(f"word{i}" for i in range(60))


def page(title, text, ns=0):
    return f"<page><title>{title}</title><ns>{ns}</ns><revision><id>1</id><text>{text}</text></revision></page>"


def write_inputs(base):
    dump = "<mediawiki>" + page("Film A", f"Intro {{{{x}}}}\n== Plot ==\n{PLOT} [[B|link]]\n== Cast ==\nz") + page("Film B", "== Plot ==\ntoo short") + page("Talk:A", "x", 1) + page("Other", f"== Plot ==\n{PLOT}") + "</mediawiki>"
    (base / "dump.xml").write_text(dump)
    (base / "links.csv").write_text("movieId,imdbId,tmdbId\n1,0000001,11\n2,0000002,12\n3,0000003,13\n4,0000004,14\n")
    (base / "movies.csv").write_text('movieId,title,genres\n1,"Film, A (1999)",Drama|Comedy\n2,Film B (2000),Drama\n3,Film C (2001),Animation\n4,Film D,(no genres listed)\n')
    (base / "mapping").mkdir()
    rows = [("Film A", "tt1"), ("Film B", "tt0000002"), ("Film C", "tt0000003"), ("Film D", "tt0000004")]
    rows = [(t, i if i != "tt1" else "tt0000001") for t, i in rows]
    (base / "mapping" / "a.json").write_text(json.dumps({"results": {"bindings": [{"articleTitle": {"value": t}, "imdbId": {"value": i}} for t, i in rows]}}))
    ok = json.dumps({"parse": {"wikitext": {"*": "== Synopsis ==\nshort plot of B"}}})
    write_responses(base, [("Film B", 200, ok), ("Film C", 503, None), ("Film D", 200, json.dumps({"error": {"code": "missingtitle"}}))])


def write_responses(base, rows):
    (base / "responses.json").write_text("".join(json.dumps({"wiki_title": t, "status": s, "body": b}) + "\n" for t, s, b in rows))


def run(spark, base):
    return build_catalogue(spark, str(base / "out"), dump=str(base / "dump.xml"), links=str(base / "links.csv"), movies=str(base / "movies.csv"),
                           mapping=str(base / "mapping"), responses=str(base / "responses.json"))


def report(spark, base, name):
    return [r.asDict() for r in spark.read.json(str(base / "out" / "reports" / name)).collect()]


def test_from_files_to_index_and_resume(spark, tmp_path):
    write_inputs(tmp_path)
    got = run(spark, tmp_path)
    assert {r["wiki_title"] for r in got["plots"].collect()} == {"Film A", "Other"}
    final = {r["movieId"]: r for r in got["movie_plots"].collect()}
    assert set(final) == {1, 2} and final[1]["plot_source"] == "wiki_dump" and final[2]["plot_source"] == "wikipedia_api"
    assert final[1]["plot_text"] == f"{PLOT} link" and final[1]["title"] == "Film, A" and final[1]["year"] == 1999
    assert report(spark, tmp_path, "extract") == [{"articles_scanned": 3, "plots_extracted": 2, "extraction_rate": 2 / 3 * 100}]
    assert {r["failure_reason"]: r["n"] for r in report(spark, tmp_path, "failures")} == {"http_503": 1, "missingtitle": 1}
    assert report(spark, tmp_path, "backfill")[0] == {"total_unmatched": 3, "wikidata_resolved": 3, "plots_fetched": 1, "fetch_failures": 2}
    assert report(spark, tmp_path, "encode")[0]["total_encoded"] == 2
    index = got["index"].orderBy("faiss_idx").collect()
    assert [(r["faiss_idx"], r["movieId"], len(r["embedding"])) for r in index] == [(0, 1, 64), (1, 2, 64)]
    assert {r["imdbId"] for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "no_plot_movies")).collect()} == {"tt0000003", "tt0000004"}
    # the second run classifies only what failed before; B stays in the checkpoint
    write_responses(tmp_path, [("Film B", 503, None), ("Film C", 200, json.dumps({"parse": {"wikitext": {"*": f"== Plot ==\n{PLOT}"}}})), ("Film D", 200, "no json")])
    again = run(spark, tmp_path)
    assert {r["wiki_title"] for r in again["backfill"].collect()} == {"Film B", "Film C"}
    assert {r["failure_reason"] for r in again["failures"].collect()} == {"unknown"}
    assert {r["movieId"] for r in again["movie_plots"].collect()} == {1, 2, 3}
    assert [r["movieId"] for r in again["index"].orderBy("faiss_idx").collect()] == [1, 2, 3]  # rebuilt behind the new backfill


def changed(spark, base):
    """Time of change of each stage's files."""
    return {name: IO.fingerprint(spark, [str(base / "out" / name)], {}) for name in ("articles", "mapping", "matched", "resolved", "index")}


def test_a_changed_input_rebuilds_all_behind_it(spark, tmp_path):
    write_inputs(tmp_path)
    run(spark, tmp_path)
    first = changed(spark, tmp_path)
    run(spark, tmp_path)
    assert changed(spark, tmp_path) == first  # nothing is made again
    (tmp_path / "movies.csv").write_text((tmp_path / "movies.csv").read_text().replace("Film, A (1999)", "Film, A (1998)"))
    again = run(spark, tmp_path)
    second = changed(spark, tmp_path)
    assert {n for n in first if first[n] != second[n]} == {"matched", "resolved", "index"}
    assert {r["movieId"]: r["year"] for r in again["movie_plots"].collect()}[1] == 1998
    (tmp_path / "dump.xml").write_text((tmp_path / "dump.xml").read_text().replace("word59", "word60"))
    again = run(spark, tmp_path)
    assert {r["movieId"]: r["plot_text"] for r in again["movie_plots"].collect()}[1].endswith("word60 link")


def test_backfill_goes_on_after_its_last_epoch(spark, tmp_path, monkeypatch):
    ok = json.dumps({"parse": {"wikitext": {"*": "== Plot ==\nsome plot"}}})
    resolved = spark.createDataFrame([(f"t{i:02d}", f"tt{i}") for i in range(20)], "wiki_title string, imdbId string")
    responses = spark.createDataFrame([(f"t{i:02d}", 200 if i % 3 else 503, ok if i % 3 else None) for i in range(20)], "wiki_title string, status int, body string")
    path, seen = str(tmp_path / "backfill"), []

    def stop(epoch):
        seen.append(epoch)
        if epoch == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        BF.run(resolved, responses, path, every=5, progress=stop)
    assert BF.complete_epochs(spark, path) == [0, 1]
    (tmp_path / "backfill" / "epoch=2").mkdir()  # begun and not completed
    results, failures = BF.run(resolved, responses, path, every=5, progress=seen.append)
    assert seen == [0, 1, 2, 3]  # the second run classifies the last two epochs only
    rows = BF.attempts(spark, path).collect()
    assert sorted(r["wiki_title"] for r in rows) == [f"t{i:02d}" for i in range(20)] and {r["epoch"] for r in rows} == {0, 1, 2, 3}
    assert results.count() == 13 and {r["failure_reason"] for r in failures.collect()} == {"http_503"} and failures.count() == 7
    BF.run(resolved, responses, path, every=5, progress=seen.append)
    assert seen == [0, 1, 2, 3]  # nothing left to try
    newer = spark.createDataFrame([("t00", 200, ok), ("t01", 503, None), ("t03", 404, None)], responses.schema)
    results, failures = BF.run(resolved, newer, path, every=5, progress=seen.append)
    assert seen[4:] == [4] and results.count() == 14
    assert {r["wiki_title"]: r["failure_reason"] for r in failures.collect()}["t03"] == "http_404"

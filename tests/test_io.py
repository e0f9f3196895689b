import json
import os
import tempfile

from pyspark.sql import functions as F

from sparkrec.sources import io as IO

DUMP = """<mediawiki>
<page><title>Film A</title><ns>0</ns><revision><id>1</id><text>== Plot ==
A hero goes.</text></revision><revision><id>2</id><text>older</text></revision></page>
<page><title>Talk:Film A</title><ns>1</ns><revision><id>3</id><text>x</text></revision></page>
<page><title>Empty</title><ns>0</ns><revision><id>4</id></revision></page>
</mediawiki>
"""


def test_xml_dump_first_revision(spark):
    d = tempfile.mkdtemp(prefix="sr-xml-")
    p = os.path.join(d, "dump.xml")
    with open(p, "w") as f:
        f.write(DUMP)
    pages = IO.first_revision_pages(IO.read_wiki_dump(spark, p))
    got = {r.wiki_title: r.wikitext for r in pages.collect()}
    assert set(got) == {"Film A", "Empty"}  # namespace 1 dropped
    assert got["Film A"].startswith("== Plot ==") and got["Empty"] is None


def test_sparql_bindings(spark):
    resp = {"results": {"bindings": [
        {"articleTitle": {"value": "Toy Story"}, "imdbId": {"value": "tt0114709"}},
        {"articleTitle": {"value": "Jumanji"}, "imdbId": {"value": "tt0113497"}}]}}
    df = spark.createDataFrame([(json.dumps(resp),)], "body string")
    got = {tuple(r) for r in IO.sparql_bindings(df, "body", ["articleTitle", "imdbId"]).collect()}
    assert got == {("Toy Story", "tt0114709"), ("Jumanji", "tt0113497")}


def test_csv_quoted_titles_and_materialize(spark):
    d = tempfile.mkdtemp(prefix="sr-csv-")
    p = os.path.join(d, "movies.csv")
    with open(p, "w") as f:
        f.write('movieId,title,genres\n1,"American President, The (1995)",Comedy|Drama|Romance\n')
    df = IO.read_csv(spark, p, "movieId long, title string, genres string")
    assert df.first().title == "American President, The (1995)"
    out = os.path.join(d, "stage")
    a = IO.materialize_to(df, out)
    b = IO.materialize_to(df.where(F.lit(False)), out)  # reused, not recomputed
    assert a.count() == b.count() == 1


def test_sorted_write_and_encode_report(spark):
    from sparkrec.operators.encode import encode_distinct, encode_report

    d = tempfile.mkdtemp(prefix="sr-sorted-")
    df = spark.range(0, 500).select((500 - F.col("id")).alias("movieId")).repartition(7)
    IO.write_parquet(df, d + "/t", sort_by=["movieId"])
    back = spark.read.parquet(d + "/t")
    files = sorted(back.inputFiles())
    mins = [spark.read.parquet(f).agg(F.min("movieId")).first()[0] for f in files]
    assert back.count() == 500 and mins == sorted(mins)  # range-partitioned, sorted part files
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id long, text string")
    enc = encode_distinct(texts, "text")
    rep = encode_report(enc, model="hashed-bow", index_path="p/index", metadata_path="p/meta").first()
    assert (rep.total_encoded, rep.embedding_dim, rep.model) == (3, 64, "hashed-bow")
    assert enc.select("text_key").distinct().count() == 2

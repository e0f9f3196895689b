"""Sources and sinks: explicit-schema readers, report sinks, materialisation.

All writes go to caller-given (shared) paths; nothing is written to a
machine-local folder except where the session itself names one (tests).
"""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir


_STAGES: set[str] = set()


def _application_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sparkrec-stages/{spark.sparkContext.applicationId}"


def stage_folder(spark: SparkSession) -> str:
    """The application's folder of stage tables in the shared ``spark.checkpoint.dir``,
    deleted when its driver ends."""
    folder = _application_folder(spark)
    if folder not in _STAGES:
        _STAGES.add(folder)
        atexit.register(drop_stages, spark)
    return folder


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables this application has written so far; DataFrames
    that still read them can no longer be evaluated."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    folder = _application_folder(spark)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)
    _STAGES.discard(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: the result is written as a parquet
    table into the cluster's shared ``spark.checkpoint.dir`` and read back.

    One job (a reliable ``checkpoint()`` needs a second job that serialises
    every row again), columnar files, and readers of the stage get column
    pruning and statistics. The table survives executor loss. An application's
    stage tables are dropped when its driver ends, or by :func:`drop_stages`."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialize_to(df: DataFrame, path: str, *, inputs: list[str] | None = None, params: dict | None = None) -> DataFrame:
    """Materialise-or-load: reuse ``path`` if a complete output exists there,
    otherwise write ``df`` (overwrite) and read it back.

    With ``inputs`` (files or folders; the path of an earlier stage too) or ``params``
    the output is reused only if it was made from the same: :func:`fingerprint` of them
    is kept in ``path/_inputs.json``, written after the data. An earlier stage that was
    rebuilt has new files, so all stages behind it are rebuilt as well."""
    spark = df.sparkSession
    mark = None if inputs is None and params is None else fingerprint(spark, inputs or [], params or {})
    note = f"{path.rstrip('/')}/_inputs.json"
    if _complete(spark, path) and (mark is None or _read_text(spark, note) == mark):
        return spark.read.parquet(path)
    df.write.mode("overwrite").parquet(path)
    if mark is not None:
        _write_text(spark, note, mark)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, inputs: list[str], params: dict) -> str:
    """JSON of the parameters and of every input file's name, size and time of change."""
    files = []
    for path in inputs:
        hpath, fs = _hadoop(spark, path)
        if not fs.exists(hpath):
            files.append([path, "absent"])
            continue
        found = fs.listFiles(hpath, True) if fs.getFileStatus(hpath).isDirectory() else None
        states = [fs.getFileStatus(hpath)] if found is None else []
        while found is not None and found.hasNext():
            states.append(found.next())
        files += [[s.getPath().toString(), s.getLen(), s.getModificationTime()] for s in states if not s.getPath().getName().startswith(("_", "."))]
    return json.dumps({"files": sorted(files), "params": params}, sort_keys=True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none where it does not exist."""
    hpath, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hpath)) if fs.exists(hpath) else []


def fresh_name() -> str:
    return uuid.uuid4().hex


def _hadoop(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    hpath, fs = _hadoop(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    hpath, fs = _hadoop(spark, path)
    out = fs.create(hpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def _complete(spark: SparkSession, path: str) -> bool:
    hpath, fs = _hadoop(spark, path + "/_SUCCESS")
    return bool(fs.exists(hpath))


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def write_parquet(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Overwrite ``path``; ``sort_by`` gives a globally sorted table (range
    partitioning + per-partition sort, no single-task sort)."""
    if sort_by:
        df = df.orderBy(*sort_by)
    df.write.mode("overwrite").parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV with quoted fields (titles contain commas); explicit schema,
    never inferred."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """One-row report DataFrame -> JSON (numbers stay numeric)."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """Wikipedia XML dump (``.xml`` or ``.xml.bz2``, splittable bz2) as one row
    per ``<page>``: ``title, ns, revision``. Uses Spark's built-in XML source."""
    schema = (
        "title string, ns int, "
        "revision array<struct<id: long, text: struct<_VALUE: string>>>"
    )
    return spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)


def first_revision_pages(pages: DataFrame) -> DataFrame:
    """Main-namespace pages with their first revision's text (null kept, so the
    caller can count it as scanned before dropping it)."""
    return pages.where(F.col("ns") == 0).select(
        F.col("title").alias("wiki_title"), F.col("revision")[0]["text"]["_VALUE"].alias("wikitext")
    )


def sparql_bindings(responses: DataFrame, json_col: str, variables: list[str]) -> DataFrame:
    """Decode saved SPARQL JSON results: ``results.bindings[].{var}.value`` -> rows."""
    fields = ", ".join(f"`{v}`: struct<value: string>" for v in variables)
    schema = f"results struct<bindings: array<struct<{fields}>>>"
    b = responses.select(F.explode(F.from_json(F.col(json_col), schema)["results"]["bindings"]).alias("b"))
    return b.select(*[F.col("b")[v]["value"].alias(v) for v in variables])

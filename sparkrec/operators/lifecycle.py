"""The graduation store: counts, pending and completed movies over many epochs.

Every change writes the tables it touches under a new version and then swaps one
manifest in, by a rename that fails if that version exists. The manifest names the
folder of each table and the last epoch applied, so a reader sees all of a change
or none of it; a crash before the swap leaves files that no manifest names, and the
same epoch, applied again, gives the same tables. An epoch that the manifest
already holds changes nothing.

Counts below the threshold are kept, the catalogue is given anew with each epoch,
and completed movies count as part of it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from . import graduation as G


@dataclass(frozen=True)
class State:
    version: int
    epoch: int
    counts: DataFrame  # movie, interaction_count
    pending: DataFrame  # movie, graduated_at, interaction_count
    completed: DataFrame  # movie, graduated_at, interaction_count, retrained_at, batch


class GraduationStore:
    def __init__(self, spark: SparkSession, path: str, *, movie: str = "movie_id", movie_type: str = "long", order: list[str] = ("ts",),
                 time_col: str = "ts", threshold: int = DEFAULT.graduation_threshold):
        self.spark, self.path, self.movie, self.movie_type = spark, path.rstrip("/"), movie, movie_type
        self.order, self.time_col, self.threshold = list(order), time_col, threshold
        self._schemas = {
            "counts": f"{movie} {movie_type}, interaction_count long",
            "pending": f"{movie} {movie_type}, graduated_at string, interaction_count long",
            "completed": f"{movie} {movie_type}, graduated_at string, interaction_count long, retrained_at string, batch string",
        }

    # ------------------------------------------------------------------ manifest

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest; version 0 without tables where there is none."""
        folder, fs = self._fs(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        newest = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if newest is None:
            return {"version": 0, "epoch": -1, "tables": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{newest}", wholetext=True).first()[0]
        return json.loads(text)

    def _swap(self, manifest: dict) -> None:
        """Write the manifest beside its place and rename it there; raises if another
        writer has put the same version there first."""
        target, fs = self._fs(f"{self.path}/manifest/{manifest['version']:012d}.json")
        draft, _ = self._fs(f"{self.path}/manifest/.{manifest['version']:012d}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by someone else")

    def _table(self, manifest: dict, name: str) -> DataFrame:
        folder = manifest["tables"].get(name)
        reader = self.spark.read.schema(self._schemas[name])
        return reader.parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], self._schemas[name])

    def _commit(self, manifest: dict, epoch: int, **tables: DataFrame) -> None:
        version, folders = manifest["version"] + 1, dict(manifest["tables"])
        for name, df in tables.items():
            folders[name] = f"{name}/v{version:012d}"
            df.select(*self._columns(name)).write.mode("overwrite").parquet(f"{self.path}/{folders[name]}")
        self._swap({"version": version, "epoch": epoch, "tables": folders})

    def _columns(self, name: str) -> list[str]:
        return [f.split()[0] for f in self._schemas[name].split(", ")]

    # ------------------------------------------------------------------ state

    def state(self) -> State:
        m = self.manifest()
        return State(m["version"], m["epoch"], *(self._table(m, n) for n in ("counts", "pending", "completed")))

    def all_movies(self) -> DataFrame:
        """Every movie seen outside the catalogue with its ``status``: counting, pending or completed."""
        s, movie = self.state(), self.movie
        counting = s.counts.join(s.pending.select(movie), movie, "left_anti").join(s.completed.select(movie), movie, "left_anti")
        out = counting.withColumn("status", F.lit("counting"))
        out = out.unionByName(s.pending.withColumn("status", F.lit("pending")), allowMissingColumns=True)
        return out.unionByName(s.completed.withColumn("status", F.lit("completed")), allowMissingColumns=True)

    def retrain_signal(self, n: int = DEFAULT.retrain_on_graduation_count) -> DataFrame:
        return G.retrain_signal(self.state().pending, n)

    # ------------------------------------------------------------------ changes

    def record(self, interactions: DataFrame, epoch: int, catalogue: DataFrame) -> bool:
        """Apply an epoch's interactions; False where the store has this epoch already.

        Movies of the catalogue and completed ones are skipped. A movie that reaches
        the threshold becomes pending, dated by the interaction that reached it;
        counting goes on afterwards."""
        m, movie = self.manifest(), self.movie
        if epoch <= m["epoch"]:
            return False
        counts, pending, completed = (self._table(m, n) for n in ("counts", "pending", "completed"))
        known = catalogue.select(F.col(movie).cast(self.movie_type).alias(movie)).unionByName(completed.select(movie))
        x = interactions.withColumn(movie, F.col(movie).cast(self.movie_type)).where(F.col(movie).isNotNull()).join(known, movie, "left_anti")
        sums = counts.unionByName(G.interaction_counts(x, movie=movie)).groupBy(movie).agg(F.sum("interaction_count").alias("interaction_count"))
        # the interaction of this epoch that reaches the threshold, of movies that reach it now
        before = counts.select(movie, F.col("interaction_count").alias("_before"))
        due = sums.where(F.col("interaction_count") >= self.threshold).join(pending.select(movie), movie, "left_anti")
        due = due.join(before, movie, "left").select(movie, (F.lit(self.threshold) - F.coalesce("_before", F.lit(0))).alias("_k"))
        w = Window.partitionBy(movie).orderBy(*self.order)
        slim = x.select(*dict.fromkeys([movie, self.time_col, *self.order])).join(due, movie)
        dates = slim.withColumn("_i", F.row_number().over(w)).where(F.col("_i") == F.greatest("_k", F.lit(1)))
        new = pending.select(movie, "graduated_at").unionByName(dates.select(movie, F.date_format(self.time_col, "yyyy-MM-dd").alias("graduated_at")))
        self._commit(m, epoch, counts=sums, pending=new.join(sums, movie))
        return True

    def mark_retrained(self, movies: DataFrame, *, batch_id: str, retrained_at: str) -> None:
        """Move movies from pending to completed; they belong to the catalogue from now on."""
        m = self.manifest()
        still, done = G.mark_retrained(self._table(m, "pending"), movies.select(self.movie).distinct(), self._table(m, "completed"),
                                       movie=self.movie, batch_id=batch_id, retrained_at=retrained_at)
        self._commit(m, m["epoch"], pending=still, completed=done)

    def sink(self, catalogue_path: str):
        """``foreachBatch`` sink that reads the catalogue table anew in every epoch."""
        return lambda batch, epoch: self.record(batch, epoch, self.spark.read.parquet(catalogue_path)) and None

    # ------------------------------------------------------------------ queue files

    def save_queue(self, path: str) -> None:
        """Pending and completed movies as JSON lines with their ``status``."""
        self.all_movies().where(F.col("status") != "counting").write.mode("overwrite").json(path)

    def load_queue(self, path: str) -> None:
        """Take over a queue: JSON lines of :meth:`save_queue`, or one document with
        the lists ``pending`` and ``completed``. A pending movie without a count has
        the threshold's; counts of other movies start at 0."""
        item = f"struct<{', '.join(f.replace(' ', ': ', 1) for f in self._schemas['completed'].split(', '))}>"
        doc = self.spark.read.schema(f"pending array<{item}>, completed array<{item}>").json(path, multiLine=True)
        lists = [doc.select(F.explode(n).alias("r")).select("r.*").withColumn("status", F.lit(n)) for n in ("pending", "completed")]
        lines = self.spark.read.schema(f"{self._schemas['completed']}, status string").json(path).where(F.col(self.movie).isNotNull() & F.col("status").isNotNull())
        rows = lists[0].unionByName(lists[1]).unionByName(lines.select(*lists[0].columns)).where(F.col(self.movie).isNotNull())
        pending = rows.where(F.col("status") == "pending").withColumn("interaction_count", F.coalesce("interaction_count", F.lit(self.threshold)))
        self._commit(self.manifest(), self.manifest()["epoch"], pending=pending, counts=pending, completed=rows.where(F.col("status") == "completed"))

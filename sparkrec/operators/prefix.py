"""Running values over ordered keys of any size: a two-pass prefix scan.

A window over a key sends all its rows to one task. Here the rows are cut into
*parts* instead: ranges of (key, order) of similar size, so a key that holds a
third of all rows spreads over a third of the parts. Pass one runs the window
inside each (part, key) and sums up what a part leaves behind, for the keys that
lie in several parts only: two rows a part at most, whatever the number of rows.
A window over this small table gives every part its carry-over, and pass two adds
it to the local values. The order columns must order a key's rows totally.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import materialize

PART = "_part"


@dataclass(frozen=True)
class Parts:
    """``rows`` with their part, and ``spans``: ``key, _part, _seq, _rows, _before``
    for keys in more than one part (number of the part within its key, rows of the
    key in it and in the parts before it)."""

    rows: DataFrame
    spans: DataFrame
    key: str
    order: tuple

    def local(self) -> Window:
        return Window.partitionBy(PART, self.key).orderBy(*self.order)

    def of_spans(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose key lies in several parts, with their span."""
        s = self.spans.withColumnRenamed(self.key, "_key").withColumnRenamed(PART, "_p")
        return df.join(F.broadcast(s), df[self.key].eqNullSafe(F.col("_key")) & (df[PART] == F.col("_p"))).drop("_key", "_p")

    def carry(self, df: DataFrame, table: DataFrame, column: str) -> DataFrame:
        """``df`` with ``column`` of ``table`` (a row a span) where it has a span."""
        t = table.select(F.col(self.key).alias("_key"), F.col(PART).alias("_p"), column)
        return df.join(F.broadcast(t), df[self.key].eqNullSafe(F.col("_key")) & (df[PART] == F.col("_p")), "left").drop("_key", "_p")


def is_hot(df: DataFrame, key: str, limit: int) -> bool:
    """Whether some key has more than ``limit`` rows (counted with partial sums)."""
    return bool(df.groupBy(key).count().where(F.col("count") > limit).take(1))


def in_parts(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> Parts:
    """Cut ``df`` into ranges of (key, order), written as a stage table.

    ``parts`` defaults to the session's shuffle partitions. ``spans`` has two rows
    a part at most and is broadcast on that proof."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df.repartitionByRange(n, key, *order).withColumn(PART, F.spark_partition_id()))
    ahead = Window.partitionBy(key).orderBy(PART)
    counts = rows.groupBy(key, PART).agg(F.count("*").alias("_rows"))
    spans = counts.select("*", F.row_number().over(ahead).alias("_seq"), F.count("*").over(Window.partitionBy(key)).alias("_of"),
                          F.coalesce(F.sum("_rows").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return Parts(rows, materialize(spans.where(F.col("_of") > 1).drop("_of")), key, tuple(order))


def numbered(p: Parts, name: str = "_n") -> Parts:
    """Rows with their number within the key, from 1, over all its parts."""
    rows = p.carry(p.rows.withColumn(name, F.row_number().over(p.local())), p.spans, "_before")
    return replace(p, rows=rows.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before"))


def last_value(p: Parts, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Rows with the last non-null ``value`` of their key up to the row (or before it).

    ``value`` is an expression of the row's own columns."""
    rows = p.rows.withColumn("_value", value)
    frame = p.local().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = p.of_spans(rows.where(F.col("_value").isNotNull())).groupBy(p.key, PART, "_seq").agg(F.max_by("_value", F.struct(*p.order)).alias("_end"))
    earlier = Window.partitionBy(p.key).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = p.carry(p.spans, ends, "_end").withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
    out = rows.withColumn(name, F.last("_value", ignorenulls=True).over(frame)).drop("_value")
    return p.carry(out, carried, "_carried").withColumn(name, F.coalesce(name, "_carried")).drop("_carried")


def with_halo(p: Parts, look: int) -> DataFrame:
    """Numbered rows (``_n``) of every part and, marked ``_halo``, copies of the
    ``look`` rows of the key before the part: what a bounded frame needs to see."""
    p = p if "_n" in p.rows.columns else numbered(p)
    s = p.spans.select(F.col(p.key).alias("_key"), PART, "_seq", "_rows", "_before")
    ahead = s.select("_key", F.col("_seq").alias("_to"), F.col(PART).alias("_to_part"), F.col("_before").alias("_to_before"))
    near = s.withColumn("_to", F.explode(F.sequence(F.col("_seq") + 1, F.col("_seq") + look)))
    cond = near["_key"].eqNullSafe(ahead["_key"]) & (near["_to"] == ahead["_to"])
    pairs = near.join(ahead, cond).where(F.col("_to_before") - look < F.col("_before") + F.col("_rows")).select(
        near["_key"], F.col(PART).alias("_from"), "_to_part", "_to_before")
    tails = p.of_spans(p.rows).where(F.col("_n") > F.col("_before") + F.col("_rows") - look).select(*p.rows.columns)
    copies = tails.join(pairs, tails[p.key].eqNullSafe(pairs["_key"]) & (tails[PART] == pairs["_from"]) & (F.col("_n") > F.col("_to_before") - look))
    copies = copies.withColumn(PART, F.col("_to_part")).select(*p.rows.columns, F.lit(True).alias("_halo"))
    return p.rows.withColumn("_halo", F.lit(False)).unionByName(copies)

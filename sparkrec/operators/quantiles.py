"""Exact values at given ranks of a column, by successive range refinement.

A pass over the column is one aggregate with one row of result, whatever the
number of distinct values: for every open rank it counts the rows below, at and
between two bounds and takes approximate percentiles of the rows between them. A
rank that falls on a bound is answered; otherwise the rows strictly between, some
thousandth of them, hold it. No sort, no window and no histogram of the values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 4_000  # of the approximate percentiles: a pass keeps about 6 / ACCURACY of the rows


@dataclass
class _Search:
    rank: int
    low: object = None  # rows strictly between the bounds hold the rank (None: no bound)
    high: object = None
    found: object = None
    done: bool = False


def values_at(df: DataFrame, column: str, ranks: list[int], most_passes: int = 40) -> list:
    """The values at the 0-based ``ranks`` of the ascending non-null values of any
    ordered numeric, date or timestamp column; None for a rank that does not exist."""
    v = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    searches = [_Search(r) for r in ranks]
    for _ in range(most_passes):
        open_ = [s for s in searches if not s.done]
        if not open_:
            return [s.found for s in searches]
        between = []
        for s in open_:
            inside = F.lit(True)
            if s.low is not None:
                inside = inside & (F.col("v") > F.lit(s.low))
            if s.high is not None:
                inside = inside & (F.col("v") < F.lit(s.high))
            between.append(inside)
        counts = v.agg(*[x for i, (s, inside) in enumerate(zip(open_, between)) for x in (
            F.count_if(inside).alias(f"m{i}"), F.count_if((F.col("v") <= F.lit(s.low)) if s.low is not None else F.lit(False)).alias(f"b{i}"))]).first()
        pairs = []
        for i, s in enumerate(open_):
            m, r = counts[f"m{i}"], s.rank - counts[f"b{i}"]
            if not 0 <= r < m:
                s.done = True  # no such rank
                continue
            at, slack = (r + 0.5) / m, 3.0 / ACCURACY
            pairs.append((s, between[i], counts[f"b{i}"], max(0.0, at - slack), min(1.0, at + slack)))
        if not pairs:
            continue
        bounds = v.agg(*[F.percentile_approx(F.when(inside, F.col("v")), [lo, hi], ACCURACY).alias(f"p{i}") for i, (_, inside, _, lo, hi) in enumerate(pairs)]).first()
        checks = []
        for i, (s, inside, _, _, _) in enumerate(pairs):
            lo, hi = bounds[f"p{i}"]
            checks += [F.count_if(inside & (F.col("v") < F.lit(lo))).alias(f"u{i}"), F.count_if(F.col("v") == F.lit(lo)).alias(f"l{i}"),
                       F.count_if(inside & (F.col("v") < F.lit(hi))).alias(f"w{i}"), F.count_if(F.col("v") == F.lit(hi)).alias(f"h{i}")]
        c = v.agg(*checks).first()
        for i, (s, _, below, _, _) in enumerate(pairs):
            lo, hi = bounds[f"p{i}"]
            r = s.rank - below  # place among the rows between the old bounds
            if c[f"u{i}"] <= r < c[f"u{i}"] + c[f"l{i}"]:
                s.found, s.done = lo, True
            elif c[f"w{i}"] <= r < c[f"w{i}"] + c[f"h{i}"]:
                s.found, s.done = hi, True
            elif r < c[f"u{i}"]:
                s.high = lo
            elif r >= c[f"w{i}"] + c[f"h{i}"]:
                s.low = hi
            else:
                s.low, s.high = lo, hi
    raise RuntimeError("rank selection did not end")


def quantile_values(df: DataFrame, column: str) -> tuple | None:
    """(min, p25, lower and upper middle, p75, max), quantiles by the nearest rank
    ``round((n - 1) q)``, half up; None for no values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    ranks = [0, math.floor((n - 1) * 0.25 + 0.5), (n - 1) // 2, n // 2, math.floor((n - 1) * 0.75 + 0.5), n - 1]
    return tuple(values_at(df, column, ranks))


def quantile_report(df: DataFrame, column: str) -> DataFrame:
    """One row ``min, p25, median, p75, max`` (double) of any numeric column; the
    median is the mean of the two middle values, an empty column gives nulls."""
    found = quantile_values(df, column)
    row = [None] * 5 if found is None else [float(found[0]), float(found[1]), (float(found[2]) + float(found[3])) / 2, float(found[4]), float(found[5])]
    return df.sparkSession.createDataFrame([tuple(row)], "min double, p25 double, median double, p75 double, max double")

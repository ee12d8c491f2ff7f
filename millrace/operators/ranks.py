"""Gapless numbers and seeded splits of large groups: no group is sorted in one task.

Null order columns come first; rows that agree in all order columns get neighbouring numbers in any order; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.storage import saved

from . import inspection


def gapless(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their number from 0 within the keys, in the order of the columns. A range sort deals all rows; the counts of the ranges before carry over, one row a
    range and key."""
    at, range_, first, shift = (f"__{x}_{name}" for x in ("at", "range", "first", "shift"))
    sort = [*keys, *order]
    dealt = saved(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(at, F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn(range_, F.shiftright(at, 33))
    counts = dealt.groupBy(*keys, range_).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.col(range_).alias(f"__s{range_}"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col(first)).alias(shift))
    same = F.col(range_) == F.col(f"__s{range_}")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__s_{k}"))
    return dealt.join(starts, same).select(*rows.columns, (F.col(at) + F.col(shift)).alias(name))


def shuffled(rows: DataFrame, keys: list[str], by: str, seed: int = 2026, name: str = "rank") -> DataFrame:
    """``rows`` numbered from 0 within the keys in the order of a seeded hash."""
    h = f"__h_{name}"
    return gapless(rows.withColumn(h, F.xxhash64(by, F.lit(seed))), keys, [h, by], name).drop(h)


def split(rows: DataFrame, keys: list[str], by: str, size: Column, seed: int = 2026, name: str = "held") -> DataFrame:
    """``rows`` with whether they are held out: of each key's rows the ``size`` (a column over n, its rows) of least seeded hash. Only the hash at the cut is
    looked for, through counted ranges; rows of equal ``by`` share their fate, rows where it is null are never held out."""
    h, cut = (f"__{x}_{name}" for x in ("h", "cut"))
    hashed = rows.withColumn(h, F.xxhash64(by, F.lit(seed)))
    found = inspection.kth_smallest(hashed.filter(F.col(by).isNotNull()), keys, h, F.greatest(F.least(size, F.col("n")), F.lit(1)))
    found = found.withColumn("__size", F.least(size, F.col("n"))).select(*keys, F.when(F.col("__size") > 0, F.col(h)).alias(cut))
    return hashed.join(found, keys, "left").withColumn(name, F.coalesce(F.col(by).isNotNull() & (F.col(h) <= F.col(cut)), F.lit(False))).drop(h, cut)

"""Exact quantiles of many keys at once, by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.plans.session import release, sized, written

c = F.col

#: Cells that a key's range is cut into each round, and distinct values of a range that are sorted at last.
BINS, FEW = 1024, 4096


def quantiles(rows: DataFrame, keys: list[str], value: Column, q: float, weight: Column | None = None) -> DataFrame:
    """keys, quantile: each key's quantile with linear interpolation, as numpy and SQL's quantile_cont have it.

    Counts of distinct values are combined before the shuffle. A key's two ranks then narrow their range round by round: the values
    in it are counted in ``BINS`` cells, and the cell that holds the rank becomes the range, cut to the values that are there. All
    keys go through the same rounds, which end when no range has more than ``FEW`` distinct values; those few are sorted. No
    task sees more than ``BINS`` counts or ``FEW`` values of a key and rank. Null values and weights under one don't count; keys without
    any others aren't in the result.
    """
    one = F.lit(1) if weight is None else weight
    cells = rows.select(*keys, value.cast("double").alias("value"), one.cast("long").alias("times")).where("value is not null and times > 0")
    cells = written(cells.groupBy(*keys, "value").agg(F.sum("times").alias("times")), "values")
    whole = cells.groupBy(*keys).agg(F.sum("times").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("kinds"))
    at = F.lit(float(q)) * (c("n") - 1)
    ranks = F.array(F.floor(at), F.ceil(at))
    ranges = written(whole.select(*keys, (at - F.floor(at)).alias("part"), F.posexplode(ranks).alias("which", "rank"), "low", "high", "kinds", F.lit(0).cast("long").alias("below")), "ranges")
    while (ranges.agg(F.max("kinds")).first()[0] or 0) > FEW:
        cell = F.least(F.lit(BINS - 1), F.floor((c("value") - c("low")) / (c("high") - c("low")) * BINS))
        fine = _inside(cells, ranges, keys).withColumn("cell", F.when(c("high") > c("low"), cell).otherwise(0))
        counted = fine.groupBy(*keys, "which", "part", "rank", "below", "cell").agg(F.sum("times").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("kinds"))
        held = _holding(counted, keys, "cell", "n")
        narrower = written(held.select(*keys, "part", "which", "rank", "low", "high", "kinds", "below"), "ranges")
        release(ranges)
        ranges = narrower
    found = _holding(_inside(cells, ranges, keys), keys, "value", "times")
    pick = lambda i: F.max(F.when(c("which") == i, c("value")))
    both = found.groupBy(*keys).agg(pick(0).alias("a"), pick(1).alias("b"), F.max("part").alias("part"))
    return both.select(*keys, (c("a") + (c("b") - c("a")) * c("part")).alias("quantile"))


def _inside(cells: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values in the ranges of their key (null keys are keys)."""
    named = sized(ranges.withColumnsRenamed({k: f"_{k}" for k in keys}))
    same = (c("value") >= c("low")) & (c("value") <= c("high"))
    for k in keys:
        same = same & c(k).eqNullSafe(c(f"_{k}"))
    return cells.join(named, same).drop(*[f"_{k}" for k in keys])


def _holding(counted: DataFrame, keys: list[str], order: str, n: str) -> DataFrame:
    """The row of each key and rank in whose count the rank falls; below becomes what is before it."""
    by = W.partitionBy(*keys, "which").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    upto = counted.withColumn("_upto", c("below") + F.sum(n).over(by))
    return upto.where((c("rank") < c("_upto")) & (c("rank") >= c("_upto") - c(n))).withColumn("below", c("_upto") - c(n)).drop("_upto")

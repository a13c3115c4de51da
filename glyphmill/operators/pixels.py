"""Pixels as rows: samples, thresholds, masks, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def border_band(width: Column, height: Column) -> Column:
    quarter = lambda v: F.when(F.floor(v / 4) == 0, 1).otherwise(F.floor(v / 4))
    return F.greatest(F.lit(1), F.least(F.lit(12), quarter(height), quarter(width)))


def border_sample(pixels: DataFrame) -> DataFrame:
    """Pixels of the four border bands; corners come twice. Needs x, y, width, height."""
    band = border_band(c("width"), c("height"))
    sides = [c("y") < band, c("y") >= c("height") - band, c("x") < band, c("x") >= c("width") - band]
    times = sum((F.when(s, 1).otherwise(0) for s in sides[1:]), F.when(sides[0], 1).otherwise(0))
    return pixels.withColumn("_times", times).where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), c("_times")))).drop("_times", "_i")


def background_colour(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Median of each channel, cut to a whole number."""
    return pixels.groupBy(*keys).agg(*[F.median(ch).cast("int").alias(f"bg_{ch}") for ch in ("r", "g", "b")])


def otsu_threshold(pixels: DataFrame, keys: list[str], gray: str = "gray", weight: Column | None = None) -> DataFrame:
    """The gray level that splits each key's histogram with the greatest variance between the halves; the least of equals.

    A row counts ``weight`` times (once by default). 256 counts a key reach the window, whatever the number of pixels.
    """
    bins = pixels.groupBy(*keys, c(gray).cast("int").alias("level")).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    by = W.partitionBy(*keys)
    upto = by.orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    sums = bins.withColumns({"below": F.sum("n").over(upto), "mass": F.sum(c("n") * c("level")).over(upto), "all": F.sum("n").over(by), "total": F.sum(c("n") * c("level")).over(by)})
    above = c("all") - c("below")
    gap = c("mass") / c("below") - (c("total") - c("mass")) / above
    scored = sums.where(c("below") < c("all")).withColumn("between", F.round(c("below").cast("double") * above * gap * gap, 3))
    best = F.row_number().over(by.orderBy(F.desc("between"), "level"))
    return scored.withColumn("n_th", best).where("n_th = 1").select(*keys, c("level").alias("threshold"))


def distance_threshold(border: DataFrame, vector: str) -> DataFrame:
    """One row: the border's mean vector and the thresholds that its own distances give."""
    mean = border.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    near = border.crossJoin(F.broadcast(mean)).select("mean", distance(c(vector), c("mean")).alias("d"), F.abs(F.get(c(vector), F.lit(0)) - F.get(c("mean"), F.lit(0))).alias("dl"))
    return near.groupBy("mean").agg(F.greatest(F.lit(12.0), F.percentile("d", 0.95) * 2.5 + 6).alias("limit"), F.greatest(F.lit(10.0), F.percentile("dl", 0.95) * 2.5 + 4).alias("light_limit"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def kernel_size(gap: Column) -> Column:
    """3 at least, odd, rounded up."""
    return F.greatest(F.lit(3), gap + F.when(gap % 2 == 0, 1).otherwise(0))


def monochrome(pixels: DataFrame, keys: list[str], limit: int = 6) -> DataFrame:
    """Whether no visible pixel's red differs from its green, or green from blue, by more than the limit."""
    gap = F.greatest(F.abs(c("r") - c("g")), F.abs(c("g") - c("b")))
    return pixels.groupBy(*keys).agg(F.coalesce(F.max(F.when(c("alpha") > 0, gap)) <= limit, F.lit(True)).alias("monochrome"))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def palette_counts(pixels: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """The ``most`` commonest colours of visible pixels, each channel in steps of 16: keys, rank, colour, n. Ties go to
    the greater r, g, b. Counts are combined before the shuffle and ranks are limited before the sort."""
    step = lambda ch: (F.floor(c(ch) / 16) * 16).cast("int").alias(ch)
    counts = pixels.where("alpha > 0").select(*keys, step("r"), step("g"), step("b")).groupBy(*keys, "r", "g", "b").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), F.desc("r"), F.desc("g"), F.desc("b")))
    return counts.withColumn("rank", rank).where(c("rank") <= most).select(*keys, "rank", hex_colour(c("r"), c("g"), c("b")).alias("colour"), "n")


def palette(pixels: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """keys, dominant_color, palette: null and empty where nothing is visible."""
    tops = palette_counts(pixels, keys, most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "colour"))), lambda s: s["colour"]).alias("palette"))
    every = pixels.select(*keys).distinct().join(tops, keys, "left")
    return every.select(*keys, F.get("palette", F.lit(0)).alias("dominant_color"), F.coalesce("palette", F.array().cast("array<string>")).alias("palette"))

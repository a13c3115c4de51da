"""What is read: PNG sheets, SVG sheets, element boxes, event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def png_sheets(spark: SparkSession, path: str) -> DataFrame:
    """PNG files as rows of the image source (BGR); a file that can't be decoded fails the query."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = c("image.height") <= 0
    return rows.where(F.when(bad, F.raise_error(F.concat(F.lit("no image: "), c("image.origin"))).cast("boolean")).otherwise(F.lit(True)))


def svg_sheets(spark: SparkSession, path: str) -> DataFrame:
    """sheet_id, svg, view: the view box must have four numbers, else the query fails."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(path).select(c("path").alias("sheet_id"), c("content").cast("string").alias("svg"))
    numbers = F.transform(F.split(F.trim(F.translate(F.xpath_string("svg", F.lit("/*/@viewBox")), ",", " ")), r"\s+"), lambda p: p.try_cast("double"))
    good = (F.size(numbers) == 4) & F.forall(numbers, lambda n: n.isNotNull())
    view = F.struct(*[F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate("xywh")])
    return rows.withColumn("view", F.when(good, view).otherwise(F.raise_error(F.concat(F.lit("no view box: "), c("sheet_id")))))


def element_boxes(lines: DataFrame, line: str) -> DataFrame:
    """elem_id, x, y, w, h from lines of five fields; the layer itself is skipped."""
    f = F.split(line, ",")
    n = lambda i: F.get(f, F.lit(i)).try_cast("double")
    whole = lines.where((F.size(f) == 5) & (F.get(f, F.lit(0)) != "Layer_1"))
    size = lambda v: F.greatest(F.lit(1), F.ceil(v)).cast("int")
    out = whole.select("*", F.get(f, F.lit(0)).alias("elem_id"), F.floor(n(1)).cast("int").alias("x"), F.floor(n(2)).cast("int").alias("y"), size(n(3)).alias("w"), size(n(4)).alias("h"))
    return out.where("x is not null and y is not null")


def directory_listing(files: DataFrame, path: str) -> DataFrame:
    """Names of the visible entries in lower-case order: a file's without its ending, a directory's (its path ends with a slash) whole."""
    entry = files.select(F.regexp_extract(path, r"([^/]+)/?$", 1).alias("file"), c(path).endswith("/").alias("folder")).where(~c("file").startswith("."))
    name = F.when(c("folder"), c("file")).otherwise(F.regexp_replace("file", r"(?<=.)\.[^.]*$", ""))
    return entry.select(name.alias("name")).orderBy(F.lower("name"), "name")


def pull_events(lines: DataFrame, line: str) -> DataFrame:
    """status, completed, total of a feed of JSON lines, batch or streaming: blank and broken lines are skipped, an
    error line fails the query, missing numbers are 0."""
    node = F.from_json(line, "status string, completed long, total long, error string")
    rows = lines.where(F.trim(line) != "").select("*", node.alias("_e")).where(F.try_parse_json(line).isNotNull())
    sound = F.when(c("_e.error").isNotNull(), F.raise_error(c("_e.error")).cast("boolean")).otherwise(F.lit(True))
    zero = lambda n: F.coalesce(c(f"_e.{n}"), F.lit(0)).alias(n)
    return rows.where(sound).select(F.coalesce("_e.status", F.lit("")).alias("status"), zero("completed"), zero("total"))

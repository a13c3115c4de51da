"""Boxes on sheets: padding, unions, orders, scales, placements, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def half_even(value: Column) -> Column:
    """Rounded to a whole number, halves to the even one."""
    return F.bround(value, 0).cast("long")


def pad_clamp(df: DataFrame, padding: int, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Grows x, y, w, h by ``padding`` on all sides; clamps to 0 and to the limits that are given."""
    left, top, right, bottom = c("x") - padding, c("y") - padding, c("x") + c("w") + padding, c("y") + c("h") + padding
    if width is not None:
        left, right = F.greatest(F.lit(0), left), F.least(width, right)
    if height is not None:
        top, bottom = F.greatest(F.lit(0), top), F.least(height, bottom)
    return df.withColumns({"x": left, "y": top, "w": right - left, "h": bottom - top})


def box_union(df: DataFrame, keys: list[str]) -> DataFrame:
    """The least box around all boxes of a key."""
    ends = df.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(c("x") + c("w")).alias("x2"), F.max(c("y") + c("h")).alias("y2"))
    return ends.select(*keys, "x", "y", (c("x2") - c("x")).alias("w"), (c("y2") - c("y")).alias("h"))


def area_filter(df: DataFrame, min_area: int) -> DataFrame:
    return df.where(c("area") >= min_area)


#: Pixels of a row of boxes that one task numbers at least.
STRETCH = 256


def row_tolerance(df: DataFrame, key: str) -> DataFrame:
    """key, tolerance: three quarters of the upper median height of a sheet's boxes, 20 at least; by counts of heights."""
    by = W.partitionBy(key)
    counts = df.where("h is not null").groupBy(key, "h").agg(F.count("*").alias("n"))
    reached = counts.select(key, "h", F.sum("n").over(by.orderBy("h")).alias("upto"), F.sum("n").over(by).alias("whole"))
    median = reached.where(c("upto") > F.floor(c("whole") / 2)).groupBy(key).agg(F.min("h").alias("h"))
    return median.select(key, F.greatest(F.lit(20), F.floor(c("h") * 0.75)).cast("double").alias("tolerance"))


def reading_order(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Adds row_no and icon_index (from 1): rows of boxes by height, boxes of a row by x.

    Boxes come by centre; each joins the first row whose mean centre is within the sheet's tolerance (``row_tolerance``), or opens
    a row. Boxes of one centre join the same row, so the fold goes over a sheet's centres with their counts, of which
    there are two for each pixel of its height at most; it is cut where two neighbours are further apart than the tolerance, as no
    row reaches over that. What a task holds of a sheet is so bounded by the picture's size. The boxes are
    dealt by centre and stretch, and numbered within stretches of a row. Means are exact for boxes of whole pixels.
    Boxes without a place, and sheets without a key, have rows and a sheet of their own.
    """
    boxes = df.withColumns({"_cy": c("y") + c("h") / 2.0, "_at": F.floor(c("x") / STRETCH)})
    counts = boxes.groupBy(key, "_cy", "_at").agg(F.count("*").alias("n"))
    by = W.partitionBy(key)
    limits = row_tolerance(df, key).withColumnRenamed(key, "_key")
    parts = counts.join(limits, c(key).eqNullSafe(c("_key")), "left").drop("_key")
    parts = parts.withColumn("cut", F.coalesce((c("_cy") - F.lag("_cy").over(by.orderBy("_cy")) > c("tolerance")).cast("int"), F.lit(0)))
    parts = parts.withColumn("island", F.sum("cut").over(by.orderBy("_cy")))
    islands = parts.groupBy(key, "island").agg(F.first("tolerance").alias("tolerance"), F.sort_array(F.collect_list(F.struct("_cy", "_at", "n"))).alias("parts"))
    opened = lambda b: F.struct((b["_cy"] * b["n"]).alias("total"), b["n"].alias("n"), F.array(b).alias("parts"))
    first_row = F.array(opened(F.get("parts", F.lit(0))))
    empty = F.array().cast(islands.select(first_row).schema[0].dataType)

    def place(rows: Column, b: Column) -> Column:
        # a centre's further parts find the row that its first one is in, also where it is null
        mean = lambda r: r["total"] / r["n"]
        near = F.transform(rows, lambda r: F.coalesce(F.abs(b["_cy"] - mean(r)) <= c("tolerance"), F.lit(False)) | b["_cy"].eqNullSafe(mean(r)))
        first = F.array_position(near, True)
        widened = lambda r: F.struct((r["total"] + b["_cy"] * b["n"]).alias("total"), (r["n"] + b["n"]).alias("n"), F.concat(r["parts"], F.array(b)).alias("parts"))
        return F.when(first > 0, F.transform(rows, lambda r, i: F.when(i + 1 == first, widened(r)).otherwise(r))).otherwise(F.concat(rows, F.array(opened(b))))

    # most islands of a usual sheet are one part, which is a row as it is
    folded = F.when(F.size("parts") == 1, first_row).otherwise(F.aggregate("parts", empty, place))
    rows = islands.select(key, "island", F.posexplode(folded).alias("opened", "row"))
    rows = rows.withColumn("row_no", F.row_number().over(by.orderBy((c("row.total") / c("row.n")).asc_nulls_last(), "island", "opened")))
    stretches = rows.select(key, "row_no", F.inline("row.parts"))
    # boxes of earlier rows and of earlier stretches of the row; rows stay dealt by sheet until they meet the boxes
    upto, own = F.sum("n").over(by.orderBy("row_no", "_at")), F.sum("n").over(W.partitionBy(key, "row_no", "_at"))
    dealt = stretches.select(c(key).alias("_key"), "row_no", c("_at").alias("_stretch"), c("_cy").alias("_line"), (upto - own).alias("before"))
    same = boxes[key].eqNullSafe(dealt["_key"]) & boxes["_cy"].eqNullSafe(dealt["_line"]) & boxes["_at"].eqNullSafe(dealt["_stretch"])
    placed = boxes.join(dealt, same).drop("_key", "_line", "_stretch")
    within = W.partitionBy(key, "row_no", "_at").orderBy("x", "_cy", "y", *ties, F.struct(*[c(n) for n in df.columns]))
    return placed.withColumn("icon_index", (c("before") + F.row_number().over(within)).cast("int")).select(*df.columns, "row_no", "icon_index")


def vector_order(df: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """Adds icon_index: by centre height, then x; no rows."""
    return df.withColumn("icon_index", F.row_number().over(W.partitionBy(key).orderBy(c("y") + c("h") / 2.0, "x", *ties)))


def stem(index: Column) -> Column:
    return F.format_string("icon_%03d", index)


def auto_ids(df: DataFrame, key: str, order: str, id_col: str = "elem_id") -> DataFrame:
    """Gives elements without an id shape_0001 and so on, in document order."""
    missing = F.coalesce(c(id_col), F.lit("")) == ""
    number = F.row_number().over(W.partitionBy(key, missing).orderBy(order))
    return df.withColumn(id_col, F.when(missing, F.format_string("shape_%04d", number)).otherwise(c(id_col)))


def uniform_scale(df: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Adds scale: what fits the sheet's widest and its highest icon, maybe two icons, on the canvas."""
    by = W.partitionBy(key)
    one = F.lit(1)
    return df.withColumn("scale", F.least(F.lit(float(width)) / F.greatest(one, F.max("w").over(by)), F.lit(float(height)) / F.greatest(one, F.max("h").over(by))))


def scale_for(mode: Column, width: int, height: int, uniform: Column) -> Column:
    fit = F.least(F.lit(float(width)) / F.greatest(F.lit(1), c("w")), F.lit(float(height)) / F.greatest(F.lit(1), c("h")))
    return F.when(mode == "original", F.lit(1.0)).when(mode == "uniform_to_largest", uniform).otherwise(fit)


def place_on_canvas(df: DataFrame, width: int, height: int) -> DataFrame:
    """From w, h and scale: new_w, new_h, off_x, off_y and clipped. A scale of one leaves the size alone."""
    sized = F.abs(c("scale") - 1) > 1e-6
    out = df.withColumns({n: F.when(sized, F.greatest(F.lit(1), half_even(c(o) * c("scale")))).otherwise(c(o)).cast("long") for n, o in (("new_w", "w"), ("new_h", "h"))})
    out = out.withColumns({"off_x": F.floor((F.lit(width) - c("new_w")) / 2.0), "off_y": F.floor((F.lit(height) - c("new_h")) / 2.0)})
    return out.withColumn("clipped", (c("off_x") < 0) | (c("off_y") < 0))


def svg_transform(width: int, height: int) -> Column:
    """The transform that centres an icon on the canvas, halves rounded to even before they are printed."""
    number = lambda v, n: F.format_string(f"%.{n}f", F.bround(v, n))
    return F.concat(F.lit("translate("), number((width - c("w") * c("scale")) / 2.0, 4), F.lit(" "), number((height - c("h") * c("scale")) / 2.0, 4), F.lit(") scale("), number(c("scale"), 6), F.lit(")"))


def svg_box(view: Column, raster_w: Column, raster_h: Column) -> dict[str, Column]:
    """A raster box in the drawing's units: places rounded down, sizes up and 1 at least."""
    sx, sy = view["w"] / raster_w, view["h"] / raster_h
    size = lambda v: F.greatest(F.lit(1), F.ceil(v)).cast("int")
    return {"x": F.floor(view["x"] + c("x") * sx).cast("int"), "y": F.floor(view["y"] + c("y") * sy).cast("int"), "w": size(c("w") * sx), "h": size(c("h") * sy)}


def canvas_size(view_box: Column, width: Column, height: Column) -> dict[str, Column]:
    """Size of a drawing: the view box if it has four numbers, else width and height without px, else 0; 1 at least."""
    parts = F.split(F.trim(F.translate(view_box, ",", " ")), r"\s+")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    good = (F.size(numbers) == 4) & F.forall(numbers, lambda n: n.isNotNull())
    own = lambda v: F.coalesce(F.regexp_replace(v, "px", "").try_cast("double"), F.lit(0.0))
    pick = lambda i, v: F.greatest(F.lit(1.0), F.when(F.coalesce(good, F.lit(False)), F.get(numbers, F.lit(i))).otherwise(own(v)))
    return {"canvas_w": pick(2, width), "canvas_h": pick(3, height)}


def guard_size(value: Column) -> Column:
    return F.greatest(F.lit(1), value.cast("int"))


def assign_groups(points: DataFrame, groups: DataFrame, padding: int, *, point: str, group: str, keys: tuple[str, ...] = (), cell: int = 256) -> DataFrame:
    """point, cx, cy -> adds the first group (least ``group``) whose box, padded, holds the point; null if none does.

    With ``keys`` (the sheet) only boxes of the point's own sheet count, and points and groups are told
    apart within a sheet; a point of a null sheet has no group. Boxes and points meet in cells of a grid:
    a box is listed in every cell that it touches, a point in its own, so the containment join is an
    equi-join with a residual, whatever the sizes of the two. Boxes of sheets without points are left out before they are listed, and a grid's cells
    are the least, from ``cell`` on by doubling, that are twice as large as the box: a box is in four cells at most, and points are listed
    in each of the grids that there are boxes for.
    """
    boxes = groups.select(*keys, group, (c("x") - padding).alias("x1"), (c("y") - padding).alias("y1"), (c("x") + c("w") + padding).alias("x2"), (c("y") + c("h") + padding).alias("y2"))
    boxes = boxes.where("x1 <= x2 and y1 <= y2")
    if keys:
        boxes = boxes.join(points.select(*keys), [*keys], "left_semi")
    side = F.greatest(c("x2") - c("x1"), c("y2") - c("y1"), F.lit(1))
    level = F.greatest(F.lit(0), F.ceil(F.log2(side * 2 / F.lit(float(cell))))).cast("int")
    at = lambda v: F.floor(v / (F.pow(F.lit(2.0), c("level")) * cell)).cast("long")
    span = lambda lo, hi: F.explode(F.sequence(at(lo), at(hi)))
    boxes = boxes.withColumn("level", level)
    levels = groups.agg(F.collect_set(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(c("w") + 2 * padding, c("h") + 2 * padding, F.lit(1)) * 2 / F.lit(float(cell))))).cast("int")).alias("levels"))
    boxes = boxes.withColumn("gx", span(c("x1"), c("x2"))).withColumn("gy", span(c("y1"), c("y2")))
    placed = points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels").withColumns({"gx": at(c("cx")), "gy": at(c("cy"))})
    hit = placed.join(boxes, [*keys, "level", "gx", "gy"]).where((c("cx") >= c("x1")) & (c("cx") <= c("x2")) & (c("cy") >= c("y1")) & (c("cy") <= c("y2")))
    first = hit.groupBy(*keys, point).agg(F.min(group).alias(group))
    return points.join(first, [*keys, point], "left")


def with_singletons(assigned: DataFrame, *, point: str, group: str) -> DataFrame:
    """Leftovers become groups of their own: group_key is g:<group> or s:<point>."""
    taken = assigned.where(c(group).isNotNull()).withColumn("group_key", F.concat(F.lit("g:"), c(group).cast("string")))
    alone = assigned.where(c(group).isNull()).withColumn("group_key", F.concat(F.lit("s:"), c(point).cast("string")))
    return taken.unionByName(alone)


def vector_mode(has_svg: Column, from_png: Column, preview_monochrome: Column) -> Column:
    """How the vector came about: null without one; from a bitmap by its preview (none counts as traced); else native."""
    traced = F.coalesce(preview_monochrome, F.lit(True))
    return F.when(~has_svg, F.lit(None).cast("string")).when(~from_png, "vector-native-grouped").when(traced, "traced-monochrome").otherwise("embedded-raster-color")


def bitmap_source(mode: Column) -> Column:
    """Which crop a bitmap is made from and what is behind it."""
    keep = mode == "keep_background"
    return F.struct(F.when(keep, "opaque").otherwise("transparent").alias("crop"), F.when(keep, "background").otherwise("clear").alias("canvas"))

"""From sheets to icons: detected, put in reading order, cropped, placed on a canvas, coloured and written."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.pictures import compose, filled, palette
from glyphmill.operators import detection, geometry, runs
from glyphmill.plans.session import ship_package, sized, written
from glyphmill.sources import sinks

c = F.col


KEY = ["sheet_id"]


def icon_boxes(sheets: DataFrame, *, min_area: int = 200, merge_gap: int = 13, padding: int = 8) -> DataFrame:
    """sheet_id, icon_index, stem, source_bounds, source_size and tight (the box without padding) of every icon of the image source's sheets.
    A sheet without icons gives no rows."""
    return _detected(sheets, min_area, merge_gap, padding)[-1]


def _detected(sheets: DataFrame, min_area: int, merge_gap: int, padding: int) -> tuple[DataFrame, ...]:
    """Colour runs, limits, mask and boxes of all sheets, each found once and written."""
    coloured = written(detection.colour_runs(sheets), "coloured")
    told = written(detection.limits(coloured, KEY), "limits")
    mask = written(detection.foreground(coloured, told, KEY), "mask")
    found = detection.icon_boxes(mask, told, KEY, min_area=min_area, merge_gap=merge_gap)
    return coloured, told, mask, written(detection.ordered(found, told, "sheet_id", padding), "boxes")


#: Icons that a task draws, about.
ICONS_A_TASK = 2000


def icons(
    sheets: DataFrame,
    *,
    min_area: int = 200,
    merge_gap: int = 13,
    padding: int = 8,
    canvas: tuple[int, int] = (512, 512),
    mode: str = "uniform_to_largest",
    bitmaps: str = "transparent_preserve_interior",
) -> DataFrame:
    """Every icon with its pictures: adds scale, canvas_size, png, dominant_color and palette to ``icon_boxes``.

    A sheet's pixels are decoded once, to colour runs. Boxes, orders, scales and what lies outside an icon are DataFrame steps
    over the runs of all sheets; the runs of each icon's crop then meet, and a task draws one icon at a time. With ``keep_background``
    the crop is opaque and the canvas has the sheet's border colour; else what is outside the icon is clear.
    """
    width, height = canvas
    coloured, told, mask, boxes = _detected(sheets, min_area, merge_gap, padding)
    # the common scale is that of the icons with their whole padding, whether the sheet's edge cuts it or not
    whole = boxes.withColumns({n: c(f"tight.{n}") + 2 * padding for n in "wh"})
    common = geometry.uniform_scale(whole, "sheet_id", width, height).withColumnRenamed("scale", "common")
    sized = common.withColumns({n: c(f"source_size.{n}") for n in "wh"})
    scaled = sized.withColumn("scale", geometry.scale_for(F.lit(mode), width, height, c("common")))
    placed = geometry.place_on_canvas(scaled, width, height).select("sheet_id", "icon_index", "stem", "source_bounds", "source_size", "scale", "new_w", "new_h", "off_x", "off_y")
    crops = boxes.select("sheet_id", "icon_index", *[c(f"source_bounds.{n}").alias(n) for n in "xywh"])
    opaque = bitmaps == "keep_background"
    drawn = _drawn(_gathered(coloured, told, mask, crops, placed, opaque), boxes.count(), width, height)
    size = F.struct(F.lit(width).alias("w"), F.lit(height).alias("h")).alias("canvas_size")
    return drawn.select("sheet_id", "icon_index", "stem", "source_bounds", "source_size", "scale", size, F.lit(mode).alias("canvas_mode"), "png", F.get("palette", F.lit(0)).alias("dominant_color"), "palette")


def _gathered(coloured: DataFrame, told: DataFrame, mask: DataFrame, crops: DataFrame, placed: DataFrame, opaque: bool) -> DataFrame:
    """A row for each icon: its place, the runs of its crop (from the crop's corner) and of what is outside, as arrays, and the ground."""
    own = ["sheet_id", "icon_index"]
    lists = lambda names: F.collect_list(F.struct(*names)).alias("runs")
    apart = lambda df, names, tag: df.select(*own, *[c(f"runs.{n}").alias(f"{tag}{n}") for n in names])
    part = runs.within(coloured.select("sheet_id", "y", "x0", "x1", "r", "g", "b"), crops, KEY)
    local = part.withColumns({"y": c("y") - c("by"), "x0": c("x0") - c("bx"), "x1": c("x1") - c("bx")})
    names = ["y", "x0", "x1", "r", "g", "b"]
    rows = placed.join(apart(local.groupBy(*own).agg(lists(names)), names, ""), own)
    if opaque:
        return rows.join(sized(told.select("sheet_id", F.array("bg_r", "bg_g", "bg_b").alias("ground"))), "sheet_id")
    outside = runs.crop_background(mask, crops, KEY, "icon_index").where("outside").groupBy(*own).agg(lists(names[:3]))
    return rows.join(apart(outside, names[:3], "out_"), own, "left").withColumn("ground", F.lit(None).cast("array<int>"))


def _drawn(rows: DataFrame, n: int, width: int, height: int) -> DataFrame:
    ship_package(rows.sparkSession)
    box = "struct<x:int,y:int,w:int,h:int>"
    schema = f"sheet_id string, icon_index int, stem string, source_bounds {box}, source_size struct<w:int,h:int>, scale double, png binary, palette array<string>"

    def run(stream):
        for batch in stream:
            out = []
            for icon in batch.to_dict("records"):
                opaque = icon["ground"] is not None
                size = icon["source_bounds"]["h"], icon["source_bounds"]["w"]
                crop = filled(*size, icon["y"], icon["x0"], icon["x1"], np.stack([icon["r"], icon["g"], icon["b"]], axis=1))
                clear = None if opaque else icon.get("out_y")
                if clear is not None:
                    crop[filled(*size, clear, icon["out_x0"], icon["out_x1"], np.ones((len(clear), 1)))[..., 0] > 0, 3] = 0
                ground = (*icon["ground"], 255) if opaque else (0, 0, 0, 0)
                picture = compose(crop, width, height, icon["new_w"], icon["new_h"], icon["off_x"], icon["off_y"], ground)
                out.append((*[icon[k] for k in ("sheet_id", "icon_index", "stem", "source_bounds", "source_size", "scale")], sinks.png_bytes(picture), palette(picture)))
            yield pd.DataFrame(out, columns=["sheet_id", "icon_index", "stem", "source_bounds", "source_size", "scale", "png", "palette"])

    return rows.repartition(max(1, n // ICONS_A_TASK), "sheet_id", "icon_index").mapInPandas(run, schema)


def with_outputs(icons: DataFrame, path: str, kinds: list[str]) -> DataFrame:
    """Adds outputs, the file of each kind that ``sinks.write_pictures`` writes for an icon."""
    name = lambda kind: F.concat(F.lit(f"{path}/"), sinks.folder(c("sheet_id")), F.lit(f"/{kind}/"), c("stem"), F.lit(f".{kind}"))
    return icons.withColumn("outputs", F.create_map(*[v for kind in kinds for v in (F.lit(kind), name(kind))]))


def palette_source(preview: Column, drawing: Column) -> Column:
    """What colours are taken from: the icon's bitmap if there is one, else its rendered drawing, else nothing."""
    return F.coalesce(preview, drawing)


def thumbnail_size(most: int = 420) -> dict[str, Column]:
    """w and h shrunk to fit a square; smaller pictures keep their size."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / c("w"), F.lit(float(most)) / c("h"))
    return {n: F.greatest(F.lit(1), F.round(c(n) * scale)).cast("int") for n in "wh"}


def results_listing(icons: DataFrame) -> DataFrame:
    """stem, formats, source and canvas of every icon, as a table of results shows them."""
    size = lambda n: F.format_string("%d x %d", c(f"{n}.w"), c(f"{n}.h"))
    return icons.select("sheet_id", "icon_index", "stem", F.array_join(F.array_sort(F.map_keys("outputs")), ", ").alias("formats"), size("source_size").alias("source"), size("canvas_size").alias("canvas"))

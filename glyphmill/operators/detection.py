"""From sheets' colour runs to icon boxes: limits that each sheet's border gives, a mask of runs, components, boxes.

Colour runs are rows of keys, y, x0, x1, r, g, b, width, height; together they cover a sheet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import strips
from glyphmill.functions.strips import Strips
from glyphmill.operators import geometry, pixels, runs
from glyphmill.operators.quantiles import quantiles
from glyphmill.plans.session import ship_package, sized, written

c = F.col


def colour_runs(sheets: DataFrame, lines: int = runs.LINES) -> DataFrame:
    """sheet_id, y, x0, x1, r, g, b, width, height of the image source's sheets; gray becomes three channels, opacity is left out.

    Spark cuts a picture's bytes into stretches of ``lines`` lines and deals them out; a task turns each into runs.
    """
    ship_package(sheets.sparkSession)
    image = sheets.select(c("image.origin").alias("sheet_id"), "image.width", "image.height", c("image.nChannels").alias("channels"), "image.data")
    stride = c("width") * c("channels")
    first = F.sequence(F.lit(0), c("height") - 1, F.lit(lines))
    cut = image.where("height > 0").withColumn("top", F.explode(first)).withColumn("data", F.substring("data", c("top") * stride + 1, stride * lines)).repartition(c("sheet_id"), c("top"))

    def run(stream):
        import pandas as pd

        for batch in stream:
            for sheet, width, height, channels, data, top in batch.itertuples(index=False):
                line = np.frombuffer(data, np.uint8).reshape(-1, width, channels)
                bgr = np.repeat(line, 3, axis=2) if channels == 1 else line[..., :3]
                new = np.ones(bgr.shape[:2], bool)
                new[:, 1:] = (bgr[:, 1:] != bgr[:, :-1]).any(axis=2)
                y, x0 = np.nonzero(new)
                x1 = np.append(x0[1:], 0)
                x1[x1 == 0] = width
                b, g, r = bgr[y, x0].T.astype(np.int32)
                yield pd.DataFrame({"sheet_id": sheet, "y": y + top, "x0": x0, "x1": x1, "r": r, "g": g, "b": b, "width": width, "height": height})

    return cut.mapInPandas(run, "sheet_id string, y int, x0 int, x1 int, r int, g int, b int, width int, height int")


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """CIELAB (D65) of 8-bit colours in 8-bit steps: L times 2.55, a and b plus 128."""
    linear = lambda v: F.when(v / 255.0 <= 0.04045, v / 255.0 / 12.92).otherwise(F.pow((v / 255.0 + 0.055) / 1.055, 2.4))
    r, g, b = linear(r), linear(g), linear(b)
    f = lambda v: F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + 16 / 116)
    x, y, z = (r * 0.412453 + g * 0.357580 + b * 0.180423) / 0.950456, r * 0.212671 + g * 0.715160 + b * 0.072169, (r * 0.019334 + g * 0.119193 + b * 0.950227) / 1.088754
    step = lambda v: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")
    light = F.when(y > 0.008856, F.cbrt(y) * 116 - 16).otherwise(y * 903.3)
    return {"l8": step(light * 255 / 100), "a8": step((f(x) - f(y)) * 500 + 128), "b8": step((f(y) - f(z)) * 200 + 128)}


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in whole steps, by 15-bit weights."""
    return F.shiftright(r * 9798 + g * 19235 + b * 3735 + 16384, 15)


def border_weight() -> Column:
    """How many pixels of a run the four border bands hold; corners count twice."""
    band = pixels.border_band(c("width"), c("height"))
    length = c("x1") - c("x0")
    within = lambda lo, hi: F.greatest(F.lit(0), F.least(c("x1"), hi) - F.greatest(c("x0"), lo))
    whole = lambda test: F.when(test, length).otherwise(0)
    return whole(c("y") < band) + whole(c("y") >= c("height") - band) + within(F.lit(0), band) + within(c("width") - band, c("width"))


def limits(coloured: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width, height, mean_l, mean_a, mean_b, limit, light_limit, threshold, bg_r, bg_g, bg_b: a row for each sheet.

    The mean is that of the border in LAB; limits are 2.5 times the 95th percentile of the border's own distances, and something; the
    threshold is Otsu's over the whole sheet; the ground is the border's median colour, cut to whole numbers. All sheets
    go through the same steps, and colours are counted, not pixels.
    """
    spread = coloured.select(*keys, "r", "g", "b", "width", "height", border_weight().alias("edge"), (c("x1") - c("x0")).alias("n"))
    counts = written(spread.groupBy(*keys, "r", "g", "b", "width", "height").agg(F.sum("edge").alias("edge"), F.sum("n").alias("n")), "colours")
    edge = counts.where("edge > 0").withColumns(lab(c("r"), c("g"), c("b")))
    mean = lambda v: (F.sum(c(v) * c("edge")) / F.sum("edge")).alias(f"mean_{v[0]}")
    means = written(edge.groupBy(*keys).agg(F.max("width").alias("width"), F.max("height").alias("height"), *[mean(v) for v in ("l8", "a8", "b8")]), "means")
    near = written(edge.select(*keys, "l8", "a8", "b8", "edge").join(sized(means), keys).select(*keys, "edge", distance().alias("d"), F.abs(c("l8") - c("mean_l")).alias("dl")), "near")
    stacked = lambda df, names: df.select(*keys, "edge", F.inline(F.array(*[F.struct(F.lit(n).alias("what"), c(n).cast("double").alias("v")) for n in names])))
    one = lambda name: F.max(F.when(c("what") == name, c("quantile")))
    far = quantiles(stacked(near, ["d", "dl"]), [*keys, "what"], c("v"), 0.95, c("edge")).groupBy(*keys)
    far = far.agg(F.greatest(F.lit(12.0), one("d") * 2.5 + 6).alias("limit"), F.greatest(F.lit(10.0), one("dl") * 2.5 + 4).alias("light_limit"))
    ground = quantiles(stacked(counts, ["r", "g", "b"]), [*keys, "what"], c("v"), 0.5, c("edge")).groupBy(*keys).agg(*[one(ch).cast("int").alias(f"bg_{ch}") for ch in ("r", "g", "b")])
    dark = pixels.otsu_threshold(counts.withColumn("gray", gray(c("r"), c("g"), c("b"))), keys, weight=c("n"))
    out = sized(means).join(far, keys).join(ground.hint("merge"), keys).join(dark.hint("merge"), keys, "left")
    # a sheet of one gray level isn't split: all of it is at the threshold or none is, as the level 0 says
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(0)))


def distance() -> Column:
    return F.sqrt(sum((c(f"{v}8") - c(f"mean_{v}")) * (c(f"{v}8") - c(f"mean_{v}")) for v in "lab"))


def foreground(coloured: DataFrame, told: DataFrame, keys: list[str], lines: int = runs.LINES) -> DataFrame:
    """keys, y, x0, x1 of what differs from the border in colour or lightness, or is dark (closed by itself); opened once, closed twice.

    Eight lines up and down is as far as these steps reach, so they run on pieces after one shuffle.
    """
    lit = coloured.withColumns(lab(c("r"), c("g"), c("b"))).join(sized(told.select(*keys, "mean_l", "mean_a", "mean_b", "limit", "light_limit", "threshold")), keys)
    far = (distance() > c("limit")) | (F.abs(c("l8") - c("mean_l")) > c("light_limit"))
    dark = gray(c("r"), c("g"), c("b")) <= c("threshold")
    layers = F.filter(F.array(F.when(far, 0), F.when(dark, 1)), lambda n: n.isNotNull())
    marked = lit.select(*keys, "y", "x0", "x1", F.explode(layers).alias("layer"))
    square, plus = runs.square(3), runs.ellipse(3)

    def mask(s: Strips) -> Strips:
        dark_closed = strips.closed(strips.united(s.where(s.layer == 1)), square)
        return strips.closed(strips.opened(strips.together(s.where(s.layer == 0), dark_closed), plus), plus, 2)

    return runs.worked(marked, told.select(*keys, "width", "height"), keys, mask, reach=8, lines=lines)


def dark_mask(coloured: DataFrame, told: DataFrame, keys: list[str], lines: int = runs.LINES) -> DataFrame:
    """keys, y, x0, x1 of what is at the sheet's gray threshold or below, closed."""
    level = coloured.join(sized(told.select(*keys, "threshold")), keys).where(gray(c("r"), c("g"), c("b")) <= c("threshold"))
    return runs.morphed(level, told.select(*keys, "width", "height"), keys, runs.closed, runs.square(3), lines)


def icon_boxes(mask: DataFrame, sizes: DataFrame, keys: list[str], *, min_area: int = 200, merge_gap: int = 13) -> DataFrame:
    """keys, label, x, y, w, h (tightened), spread (x, y, w, h), area: the mask is spread so that strokes near each other join; the area is
    the spread one's."""
    kernel = runs.ellipse(max(3, merge_gap + (merge_gap % 2 == 0)))
    spread = runs.morphed(mask, sizes, keys, runs.dilated, kernel)
    found = runs.component_boxes(runs.labelled(spread, keys), keys, min_area)
    wide = written(found.withColumn("spread", F.struct("x", "y", "w", "h")), "found")
    return runs.tightened(wide, mask, keys, "label")


def ordered(found: DataFrame, told: DataFrame, key: str, padding: int) -> DataFrame:
    """key, icon_index, stem, source_bounds, source_size, tight: reading order is that of the spread boxes; what is cut is the tightened box, padded and
    clamped to the sheet."""
    tight = F.struct("x", "y", "w", "h")
    placed = found.join(sized(told.select(key, c("width").alias("sheet_w"), c("height").alias("sheet_h"))), key)
    wide = placed.select(key, tight.alias("tight"), "sheet_w", "sheet_h", *[c(f"spread.{n}").alias(n) for n in "xywh"])
    rows = geometry.reading_order(wide, key, ["tight"]).select(key, "icon_index", "sheet_w", "sheet_h", "tight", "tight.*")
    padded = geometry.pad_clamp(rows, padding, c("sheet_w"), c("sheet_h"))
    return padded.select(key, "icon_index", geometry.stem(c("icon_index")).alias("stem"), F.struct("x", "y", "w", "h").alias("source_bounds"), F.struct("w", "h").alias("source_size"), "tight")

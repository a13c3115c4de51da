"""From drawings to icons: elements of SVG text, grouped by what a rendering shows together, each group on a canvas of its own."""

from __future__ import annotations

import gc
import re
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from glyphmill.operators import detection, geometry
from glyphmill.plans.session import ship_package, written
from glyphmill.sources import sinks

c = F.col
SVG = "http://www.w3.org/2000/svg"

_CHILD = pa.struct([("ord", pa.int32()), ("tag", pa.string()), ("elem_id", pa.string())])
_READ = StructType([StructField("children", ArrayType(StructType([StructField("ord", IntegerType()), StructField("tag", StringType()), StructField("elem_id", StringType())]))), StructField("texts", ArrayType(StringType()))])
_SIGN = re.compile('[&<>"\r\n\t]')
_IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_IN_QUOTES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def _plain(element: ElementTree.Element, out: list[str], space: str) -> bool:
    """Puts an element's text to ``out`` as ElementTree writes it; False if it has names outside SVG, comments or the like."""
    tag = element.tag
    if not isinstance(tag, str) or not tag.startswith("{" + SVG + "}"):
        return False
    name, text = tag[len(SVG) + 2 :], element.text
    out.append(f"<{name}{space}")
    for k, v in element.items():
        if k[0] == "{":
            return False
        out.append(f' {k}="{v.translate(_IN_QUOTES) if _SIGN.search(v) else v}"')
    if not text and not len(element):
        out.append(" />")
        return True
    out.append(">")
    if text:
        out.append(text.translate(_IN_TEXT))
    for child in element:
        if not _plain(child, out, ""):
            return False
        if child.tail:
            out.append(child.tail.translate(_IN_TEXT))
    out.append(f"</{name}>")
    return True


def _text(element: ElementTree.Element) -> str:
    """As ``ElementTree.tostring`` gives it, which takes several times as long for the usual element."""
    out: list[str] = []
    return "".join(out) if _plain(element, out, f' xmlns="{SVG}"') else ElementTree.tostring(element, encoding="unicode")


def _children_of(svg: str | None) -> tuple[list[tuple], list[str | None]] | None:
    """(place, tag, id) of the root's elements that are drawn, and the text of what is at each place; None for text that is no drawing."""
    try:
        root = ElementTree.XML(svg or "", ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)))
    except ElementTree.ParseError:
        return None
    children, texts, unnamed = [], [], 0
    for at, child in enumerate(root):
        tag = child.tag.rsplit("}", 1)[-1] if isinstance(child.tag, str) else "defs"
        if tag.endswith("defs"):
            texts.append(None)
            continue
        name = child.get("id")
        if not name:
            unnamed += 1
            name = f"shape_{unnamed:04d}"
        child.tail = None
        children.append((at, tag, name))
        texts.append(_text(child))
    return children, texts


@F.arrow_udf(_READ)
def _read(svg: pa.Array) -> pa.Array:
    ElementTree.register_namespace("", SVG)
    gc.disable()  # a batch's many small tuples hold no cycles: collecting would only walk them
    try:
        told = [_children_of(x) for x in svg.to_pylist()]
    finally:
        gc.enable()
    ends = lambda i: pa.array(np.cumsum([0, *[len(t[i]) if t else 0 for t in told]]), pa.int32())
    columns = zip(*[x for t in told if t for x in t[0]], strict=True) if any(t and t[0] for t in told) else [[]] * 3
    children = pa.StructArray.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _CHILD, strict=True)], fields=list(_CHILD))
    texts = pa.array([x for t in told if t for x in t[1]], pa.string())
    lists = [pa.ListArray.from_arrays(ends(0), children), pa.ListArray.from_arrays(ends(1), texts)]
    return pa.StructArray.from_arrays(lists, ["children", "texts"], mask=pa.array([t is None for t in told], pa.bool_()))


def parsed(drawings: DataFrame) -> DataFrame:
    """children (ord, tag, elem_id of the elements right below the root, in document order), texts (the text at each place) and style of
    each drawing, in place of svg; further columns stay. A drawing is a row before and after, and its text is read once.

    Comments and definitions are left out, and elements without an id get shape_0001 and so on. Text that is no drawing fails the query.
    """
    ship_package(drawings.sparkSession)
    style = F.regexp_extract("svg", r"""<(?:[\w.-]+:)?svg\b[^>]*?\sstyle=["']([^"']*)["']""", 1)
    told = drawings.withColumns({"_read": _read("svg"), "style": F.when(style != "", style)})
    sound = F.coalesce("_read", F.raise_error(F.concat(F.lit("no drawing: "), c("sheet_id").cast("string"))).cast(_READ))
    return told.withColumn("_read", sound).select(*[n for n in drawings.columns if n != "svg"], "style", "_read.children", "_read.texts")


def elements(drawings: DataFrame) -> DataFrame:
    """sheet_id, ord, tag, elem_id, xml of the elements of drawings (sheet_id, svg), or of ``parsed`` ones."""
    told = drawings if "children" in drawings.columns else parsed(drawings)
    each = F.transform("children", lambda e: F.struct(e["ord"].alias("ord"), e["tag"].alias("tag"), e["elem_id"].alias("elem_id"), F.get("texts", e["ord"]).alias("xml")))
    return told.select("sheet_id", F.inline(each))


def rendered_groups(pictures: DataFrame, *, min_area: int = 200, merge_gap: int = 13) -> DataFrame:
    """sheet_id, group_no, x, y, w, h, raster_w, raster_h: boxes of what is dark in each rendering (rows of the image source), in reading order."""
    key = ["sheet_id"]
    coloured = written(detection.colour_runs(pictures), "coloured")
    told = written(detection.limits(coloured, key), "limits")
    mask = written(detection.dark_mask(coloured, told, key), "mask")
    found = detection.icon_boxes(mask, told, key, min_area=min_area, merge_gap=max(7, merge_gap - 2))
    rows = detection.ordered(found, told, "sheet_id", 0).select("sheet_id", c("icon_index").alias("group_no"), "source_bounds.*")
    return rows.join(told.select("sheet_id", c("width").alias("raster_w"), c("height").alias("raster_h")), "sheet_id")


def first_boxes(sheet: np.ndarray, x: np.ndarray, y: np.ndarray, box_sheet: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, number: np.ndarray, cell: int = 256, at_once: int = 1 << 20) -> np.ndarray:
    """The least number of a box of the point's sheet that holds the point, -1 for none. Points and boxes meet in cells as those of
    ``geometry.assign_groups`` do, ``at_once`` pairs at a time; numbers aren't negative, and an empty box holds nothing."""
    none = np.iinfo(np.int64).max
    best = np.full(len(x), none)
    sound = np.flatnonzero((x1 <= x2) & (y1 <= y2))
    side = np.maximum(np.maximum(x2 - x1, y2 - y1), 1)
    level = np.maximum(0, np.ceil(np.log2(side * 2 / cell))).astype(np.int64)
    for n in np.unique(level[sound]):
        size = cell * 2.0**n
        own = sound[level[sound] == n]
        # twice as large as the box at least, so that it is in four cells at most
        listed = [(own, np.floor(x1[own] / size) + dx, np.floor(y1[own] / size) + dy) for dx in (0, 1) for dy in (0, 1)]
        box, gx, gy = (np.concatenate(part) for part in zip(*listed, strict=True))
        touched = (gx * size <= x2[box]) & (gy * size <= y2[box])
        box, gx, gy = box[touched], gx[touched].astype(np.int64), gy[touched].astype(np.int64)
        px, py = np.floor(x / size).astype(np.int64), np.floor(y / size).astype(np.int64)
        low_x, low_y, wide, high = gx.min(), gy.min(), gx.max() - gx.min() + 1, gy.max() - gy.min() + 1
        point = np.flatnonzero((px >= low_x) & (px < low_x + wide) & (py >= low_y) & (py < low_y + high))
        key = (box_sheet[box] * wide + gx - low_x) * high + gy - low_y
        order = np.argsort(key, kind="stable")
        asked = (sheet[point] * wide + px[point] - low_x) * high + py[point] - low_y
        first = np.searchsorted(key[order], asked, "left")
        met = np.searchsorted(key[order], asked, "right") - first
        upto = np.cumsum(met)
        edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(at_once, upto[-1] if len(upto) else 0, at_once)), len(point)])
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            many = met[lo:hi]
            p = np.repeat(point[lo:hi], many)
            b = box[order[np.repeat(first[lo:hi] - (np.cumsum(many) - many), many) + np.arange(many.sum())]]
            held = (x[p] >= x1[b]) & (x[p] <= x2[b]) & (y[p] >= y1[b]) & (y[p] <= y2[b])
            np.minimum.at(best, p[held], number[b[held]])
    return np.where(best == none, -1, best)


@F.arrow_udf(ArrayType(IntegerType()))
def _numbers(drawn: pa.Array, groups: pa.Array, pad: pa.Array) -> pa.Array:
    """The first group of each element of each drawing."""

    def told(lists):
        rows = lists.flatten()
        return pc.list_parent_indices(lists).to_numpy().astype(np.int64), [pc.struct_field(rows, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in "xywh"], rows

    sheet, (x, y, w, h), _ = told(drawn)
    own, (gx, gy, gw, gh), boxes = told(groups)
    number = pc.struct_field(boxes, "group_no").to_numpy(zero_copy_only=False).astype(np.int64)
    d = pad[0].as_py() if len(pad) else 0
    found = first_boxes(sheet, x + w / 2.0, y + h / 2.0, own, gx - d, gy - d, gx + gw + d, gy + gh + d, number)
    ends = pa.array(np.r_[0, np.cumsum(pc.list_value_length(drawn).to_numpy(zero_copy_only=False))], pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(found, pa.int32(), mask=found < 0))


def grouped(drawn: DataFrame, groups: DataFrame, pad: int = 3) -> DataFrame:
    """sheet_id, group_no, first_ord, x, y, w, h, members (ord, elem_id): a row for each group of elements.

    ``drawn`` has sheet_id, ord, elem_id and its box; ``groups`` sheet_id, group_no (0 or more) and boxes in the same units. An element goes to the
    first group whose box, padded, holds its centre, and is a group of its own if there is none. A group's box is the least
    around its members; groups without members aren't there. A drawing is one text, so its elements and its groups meet as one row
    of each, without their texts; rows stay dealt by sheet from there on.
    """
    ship_package(drawn.sparkSession)
    held = drawn.groupBy("sheet_id").agg(F.collect_list(F.struct("ord", "elem_id", "x", "y", "w", "h")).alias("drawn"))
    own = groups.groupBy("sheet_id").agg(F.collect_list(F.struct("group_no", "x", "y", "w", "h")).alias("groups"))
    told = held.join(own, "sheet_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast(own.schema["groups"].dataType)))
    told = told.withColumn("numbers", _numbers("drawn", "groups", F.lit(pad)))
    e = F.transform("drawn", lambda d, i: F.struct(*[d[n].alias(n) for n in ("ord", "elem_id", "x", "y", "w", "h")], F.get("numbers", i).alias("group_no")))
    each = told.select("sheet_id", F.inline(e)).withColumn("_own", F.when(c("group_no").isNull(), c("ord")))
    gathered = each.groupBy("sheet_id", "group_no", "_own").agg(
        F.min("ord").alias("first_ord"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(c("x") + c("w")).alias("_x2"), F.max(c("y") + c("h")).alias("_y2"), F.sort_array(F.collect_list(F.struct("ord", "elem_id"))).alias("members"),
    )
    return gathered.withColumns({"w": c("_x2") - c("x"), "h": c("_y2") - c("y")}).drop("_x2", "_y2", "_own")


def icons(drawings: DataFrame, boxes: DataFrame, groups: DataFrame, *, padding: int = 8, canvas: tuple[int, int] = (512, 512), mode: str = "uniform_to_largest") -> DataFrame:
    """sheet_id, icon_index, stem, source_bounds, source_size, scale, elem_ids, fragment, svg, vector_mode of every icon of the drawings.

    ``drawings`` are those of ``readers.svg_sheets`` (sheet_id, svg, view), or ``parsed`` ones; ``boxes`` has sheet_id, elem_id, x, y, w, h in the drawing's
    units, and elements without one aren't drawn; ``groups`` are those of ``rendered_groups``. Elements
    meet their boxes and groups by keys, without their texts; icons are numbered by their centre's height, then x; at last a drawing's icons meet
    its texts, and svg is the icon at its scale in the middle of the canvas.
    """
    width, height = canvas
    told = drawings if "children" in drawings.columns else written(parsed(drawings.select("sheet_id", "view", "svg")), "drawings")
    drawn = told.select("sheet_id", F.inline("children")).drop("tag").join(boxes, ["sheet_id", "elem_id"])
    scaled = groups.join(told.select("sheet_id", "view"), "sheet_id").withColumns(geometry.svg_box(c("view"), c("raster_w"), c("raster_h")))
    rows = grouped(drawn, scaled.select("sheet_id", "group_no", "x", "y", "w", "h"))
    rows = geometry.vector_order(rows.withColumn("_alone", c("group_no").isNull()), "sheet_id", ["_alone", "group_no", "first_ord"])
    padded = geometry.pad_clamp(rows, padding)
    common = geometry.uniform_scale(padded, "sheet_id", width, height).withColumnRenamed("scale", "_common")
    sized = common.withColumn("scale", geometry.scale_for(F.lit(mode), width, height, c("_common")))
    own = sized.groupBy("sheet_id").agg(F.collect_list(F.struct("icon_index", "x", "y", "w", "h", "scale", "members")).alias("icons"))
    moved = lambda i: F.transform(i["members"]["ord"], lambda n: sinks.shifted(F.get("texts", n), -i["x"], -i["y"]))
    each = F.transform("icons", lambda i: F.struct(*[i[n].alias(n) for n in ("icon_index", "x", "y", "w", "h", "scale")], i["members"]["elem_id"].alias("elem_ids"), moved(i).alias("_moved")))
    placed = own.join(told.select("sheet_id", "style", "texts"), "sheet_id").select("sheet_id", "style", F.inline(each))
    return placed.select(
        "sheet_id",
        "icon_index",
        geometry.stem(c("icon_index")).alias("stem"),
        F.struct("x", "y", "w", "h").alias("source_bounds"),
        F.struct("w", "h").alias("source_size"),
        "scale",
        "elem_ids",
        sinks.svg_fragment(c("_moved"), c("w"), c("h"), c("style")).alias("fragment"),
        sinks.svg_canvas(c("_moved"), F.array().cast("array<string>"), geometry.svg_transform(width, height), width, height).alias("svg"),
        geometry.vector_mode(F.lit(True), F.lit(False), F.lit(None).cast("boolean")).alias("vector_mode"),
    )

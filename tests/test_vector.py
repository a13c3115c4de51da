"""Drawings to icons: one job from the text of a drawing and its rendering to placed groups, held against plain Python."""

import random
from xml.etree import ElementTree

import numpy as np
import pytest
from glyphmill.operators import geometry, sheets, vector
from glyphmill.plans import registry
from glyphmill.sources import readers, sinks
from pyspark.sql import functions as F

HEAD = '<?xml version="1.0"?><!-- made --><svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" viewBox="0 0 200,100" style="fill:red">'


def test_elements_keep_order_text_and_ids(spark):
    body = '<!-- c --><defs><a/></defs><rect/> tail <g id="k&amp;1"><!-- in --><text>a &lt; b</text></g><use xlink:href="#x"/><rect id="shape_0009"/><path d="M0 0"/>'
    rows = spark.createDataFrame([("a", HEAD + body + "</svg>"), ("b", HEAD + "</svg>")], "sheet_id string, svg string")
    got = vector.elements(rows).orderBy("ord").collect()
    assert [(r.ord, r.tag, r.elem_id) for r in got] == [(2, "rect", "shape_0001"), (3, "g", "k&1"), (4, "use", "shape_0002"), (5, "rect", "shape_0009"), (6, "path", "shape_0003")]
    assert ElementTree.fromstring(got[1].xml)[0].text == "a < b" and "tail" not in got[0].xml
    assert "xlink" in got[2].xml and ElementTree.fromstring(got[2].xml).get("{http://www.w3.org/1999/xlink}href") == "#x"
    with pytest.raises(Exception, match="no drawing: z"):
        vector.elements(spark.createDataFrame([("z", "<svg")], "sheet_id string, svg string")).collect()


def test_drawings_are_read_with_their_view(spark, tmp_path):
    (tmp_path / "a.svg").write_text(HEAD + "<rect/></svg>")
    (tmp_path / "b.txt").write_text("no drawing")
    row = readers.svg_sheets(spark, str(tmp_path)).collect()
    assert len(row) == 1 and tuple(row[0].view) == (0.0, 0.0, 200.0, 100.0) and row[0].sheet_id.endswith("a.svg")
    (tmp_path / "c.svg").write_text('<svg viewBox="0 0 5"/>')
    with pytest.raises(Exception, match="no view box"):
        readers.svg_sheets(spark, str(tmp_path)).collect()


def test_box_lines(spark):
    lines = ["a,1.9,-0.5,3.2,0", "Layer_1,0,0,9,9", "b,1,2,3", "c,x,2,3,4", "d,4,5,6,7.0001"]
    got = readers.element_boxes(spark.createDataFrame([(x,) for x in lines], "line string"), "line").collect()
    assert [(r.elem_id, r.x, r.y, r.w, r.h) for r in got] == [("a", 1, -1, 4, 1), ("d", 4, 5, 6, 8)]


def plain_icons(items, groups, padding):
    """items: (ord, id, x, y, w, h); groups in order: (x, y, w, h), in the drawing's units."""
    left, out = list(items), []
    for x, y, w, h in groups:
        mine = [i for i in left if x - 3 <= i[2] + i[4] / 2 <= x + w + 3 and y - 3 <= i[3] + i[5] / 2 <= y + h + 3]
        left = [i for i in left if i not in mine]
        out += [mine] if mine else []
    out += [[i] for i in left]
    boxes = [(min(i[2] for i in g), min(i[3] for i in g), max(i[2] + i[4] for i in g), max(i[3] + i[5] for i in g), [i[1] for i in g]) for g in out]
    boxes.sort(key=lambda b: ((b[1] + b[3]) / 2, b[0]))
    return [((x - padding, y - padding, x2 - x + 2 * padding, y2 - y + 2 * padding), ids) for x, y, x2, y2, ids in boxes]


@pytest.mark.parametrize("mode", ["uniform_to_largest", "individual_fit", "original"])
def test_groups_equal_plain_python(spark, mode):
    rng = random.Random(mode)
    drawings, boxes, groups, want = [], [], [], {}
    for s in ("s1", "s2", "s3"):
        items = [(k, f"e{k}", rng.randrange(0, 180), rng.randrange(0, 90), rng.randrange(1, 30), rng.randrange(1, 30)) for k in range(25)]
        own = [(rng.randrange(0, 360), rng.randrange(0, 180), rng.randrange(2, 120), rng.randrange(2, 60)) for _ in range(0 if s == "s3" else 6)]
        drawings.append((s, HEAD + "".join(f'<rect id="e{k}"/>' for k in range(26)) + "</svg>", (0.0, 0.0, 200.0, 100.0)))
        boxes += [(s, *i[1:]) for i in items]
        groups += [(s, n, *b, 400, 200) for n, b in enumerate(own, 1)]
        want[s] = plain_icons(items, [(b[0] // 2, b[1] // 2, max(1, -(-b[2] // 2)), max(1, -(-b[3] // 2))) for b in own], 4)
    view = "struct<x:double,y:double,w:double,h:double>"
    got = vector.icons(
        spark.createDataFrame(drawings, f"sheet_id string, svg string, view {view}"),
        spark.createDataFrame(boxes, "sheet_id string, elem_id string, x int, y int, w int, h int"),
        spark.createDataFrame(groups, "sheet_id string, group_no int, x int, y int, w int, h int, raster_w int, raster_h int"),
        padding=4,
        canvas=(64, 48),
        mode=mode,
    ).collect()
    for s in want:
        mine = sorted((r for r in got if r.sheet_id == s), key=lambda r: r.icon_index)
        assert [(tuple(r.source_bounds), r.elem_ids) for r in mine] == want[s]
        widest, highest = max(b[2] for b, _ in want[s]), max(b[3] for b, _ in want[s])
        for r in mine:
            w, h = r.source_size
            scale = {"original": 1.0, "individual_fit": min(64 / w, 48 / h), "uniform_to_largest": min(64 / widest, 48 / highest)}[mode]
            assert r.scale == pytest.approx(scale)
            root, part = ElementTree.fromstring(r.svg), ElementTree.fromstring(r.fragment)
            assert root.get("viewBox") == "0 0 64 48" and part.get("viewBox") == f"0 0 {w} {h}" and part.get("style") == "fill:red"
            assert [e.get("id") for e in root[0]] == [e.get("id") for e in part] == r.elem_ids
            assert {e.get("transform") for e in root[0]} == {f"translate({-r.source_bounds.x} {-r.source_bounds.y})"}
            assert r.vector_mode == "vector-native-grouped"


def test_from_files_to_canvases(spark, tmp_path):
    """A drawing of two shapes that a rendering shows as one, one alone, one without a box, and one that isn't rendered."""
    body = '<defs><a/></defs><rect id="a"/><circle/><path id="far"/><g id="none"/><rect id="faint"/>'
    (tmp_path / "d.svg").write_text(HEAD + body + "</svg>")
    page = np.full((200, 400, 3), 255, np.uint8)
    page[40:80, 60:100] = 0
    page[40:80, 104:140] = 20
    page[120:170, 300:360] = 10
    (tmp_path / "d.png").write_bytes(sinks.png_bytes(page))
    drawings = readers.svg_sheets(spark, str(tmp_path)).withColumn("sheet_id", F.lit("d"))
    pictures = readers.png_sheets(spark, str(tmp_path / "*.png"))
    groups = vector.rendered_groups(pictures, min_area=50, merge_gap=9).withColumn("sheet_id", F.lit("d"))
    assert [(r.x, r.y, r.w, r.h) for r in groups.orderBy("group_no").collect()] == [(60, 40, 80, 40), (300, 120, 60, 50)]
    lines = ["a,30,20,20,20", "shape_0001,52,20,18,20", "far,150,60,30,25", "faint,100,5,10,10"]
    boxes = readers.element_boxes(spark.createDataFrame([(x,) for x in lines], "line string"), "line").withColumn("sheet_id", F.lit("d"))
    got = vector.icons(drawings, boxes, groups, padding=2).orderBy("icon_index").collect()
    assert [(r.stem, r.elem_ids, tuple(r.source_bounds)) for r in got] == [("icon_001", ["faint"], (98, 3, 14, 14)), ("icon_002", ["a", "shape_0001"], (28, 18, 44, 24)), ("icon_003", ["far"], (148, 58, 34, 29))]
    # what is written beside an icon
    icons = vector.icons(drawings, boxes, groups).withColumns({"canvas_size": F.struct(F.lit(512).alias("w"), F.lit(512).alias("h")), "outputs": F.create_map(F.lit("svg"), F.lit("x.svg"))})
    sinks.write_metadata(sinks.metadata(icons, provider="geometry", naming=False).withColumnRenamed("sheet_id", "sheet"), str(tmp_path / "meta"))
    back = spark.read.json(str(tmp_path / "meta"))
    assert back.count() == 3 and {r.vector_mode for r in back.collect()} == {"vector-native-grouped"} and {r.sheet for r in back.collect()} == {"d"}


def test_no_drawings(spark):
    view = "struct<x:double,y:double,w:double,h:double>"
    none = spark.createDataFrame([], f"sheet_id string, svg string, view {view}")
    boxes = spark.createDataFrame([], "sheet_id string, elem_id string, x int, y int, w int, h int")
    groups = spark.createDataFrame([], "sheet_id string, group_no int, x int, y int, w int, h int, raster_w int, raster_h int")
    assert vector.icons(none, boxes, groups).count() == 0


def test_small_choices(spark):
    row = spark.range(1).select(geometry.guard_size(F.lit(0.7)), geometry.guard_size(F.lit("9")), sheets.palette_source(F.lit(None).cast("string"), F.lit("d")), sheets.palette_source(F.lit("p"), F.lit("d"))).first()
    assert tuple(row) == (1, 9, "d", "p")


def test_svg_icons_reads_every_order(spark, sf_dir):
    got = registry.QUERIES["svg_icons"](spark, sf_dir).select("sheet").distinct().count()
    drawn = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey % 7 > 0 and l_partkey % 5 < 4").select("l_orderkey").distinct().count()
    assert got == drawn


def test_texts_are_those_of_element_tree():
    """Shortcuts or not, an element's text is what ElementTree writes."""
    ElementTree.register_namespace("", vector.SVG)
    parts = ['<rect/>', '<text a="&lt;&quot;&#10;&#9;>\'é">x &amp; &lt;y> <tspan> z</tspan> tail &amp; </text>', "<g><!-- c --><a/></g>", '<use xlink:href="#x"/>', '<g xml:space="preserve"> </g>', '<b xmlns="urn:o"><c/></b>', "<g><?pi x?></g>", '<g><rect r="1"/>\n<g><circle/></g></g>']
    for part in parts:
        (child,) = ElementTree.XML(HEAD + part + "</svg>", ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)))
        assert vector._text(child) == ElementTree.tostring(child, encoding="unicode")


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_first_boxes_equal_brute_force(at_once):
    rng = np.random.default_rng(at_once)
    sheet, own = rng.integers(0, 4, 300), rng.integers(0, 5, 120)
    x, y = rng.integers(-2000, 2000, (2, 300)) / 2.0
    x1, y1 = rng.integers(-1000, 1000, (2, 120))
    x2, y2 = x1 + rng.integers(-2, 1500, 120), y1 + rng.integers(-2, 300, 120)
    number = rng.permutation(120)
    got = vector.first_boxes(sheet, x, y, own, x1, y1, x2, y2, number, at_once=at_once)
    held = (sheet[:, None] == own) & (x[:, None] >= x1) & (x[:, None] <= x2) & (y[:, None] >= y1) & (y[:, None] <= y2)
    assert got.tolist() == [min(number[row].tolist(), default=-1) for row in held]
    assert vector.first_boxes(sheet[:0], x[:0], y[:0], own, x1, y1, x2, y2, number).tolist() == []
    assert set(vector.first_boxes(sheet, x, y, own[:0], x1[:0], y1[:0], x2[:0], y2[:0], number[:0]).tolist()) == {-1}


def test_svg_icons_reads_texts_once(spark, sf_dir):
    """Texts are taken apart once, in the table that is written, and only meet the icons at last; elements, boxes and groups meet in three joins without them."""
    plan = registry.QUERIES["svg_icons"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4 and "_read(" not in plan and "_children(" not in plan

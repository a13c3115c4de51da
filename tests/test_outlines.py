"""Filling and tracing, against plain Python and against each other."""

import math
import random

import numpy as np
import pytest
from glyphmill.operators import outlines, runs, vector
from pyspark.sql import functions as F
from test_runs import frame, runs_of, some_masks, spiral


def inside_plain(rings, x, y, even_odd):
    """Winding number of a point, or the parity of crossings."""
    turns = crossings = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay <= y) != (by <= y):
                at = ax + (y - ay) * (bx - ax) / (by - ay)
                if at <= x:
                    turns += 1 if by > ay else -1
                    crossings += 1
    return crossings % 2 == 1 if even_odd else turns != 0


def masks_of(df, h, w):
    out = {}
    for r in df.collect():
        m = out.setdefault(r.k, np.zeros((h, w), bool))
        m[r.y, r.x0 : r.x1] = True
    return out


@pytest.mark.parametrize("even_odd", [False, True])
def test_polygons_equal_plain_python(spark, even_odd):
    rng = random.Random(3)
    star = [(20 + 18 * math.sin(4 * math.pi * i / 5), 20 - 18 * math.cos(4 * math.pi * i / 5)) for i in range(5)]
    shapes = {"star": [star], "ring": [[(3.0, 3.0), (37.0, 3.0), (37.0, 30.0), (3.0, 30.0)], [(10.0, 8.0), (10.0, 20.0), (30.0, 20.0), (30.0, 8.0)]], "out": [[(-9.0, -5.0), (60.0, 10.0), (20.0, 70.0)]], "line": [[(1.0, 1.0), (9.0, 1.0)]], "dot": [[(4.0, 4.0)]], "none": None}
    for i in range(12):
        shapes[f"r{i}"] = [[(rng.uniform(-5, 45), rng.uniform(-5, 45)) for _ in range(rng.randrange(3, 9))] for _ in range(rng.randrange(1, 4))]
    rows = spark.createDataFrame(list(shapes.items()), f"k string, rings {outlines.POINTS.simpleString()}")
    got = masks_of(outlines.filled(rows, ["k"], F.lit(40), F.lit(36), even_odd=even_odd), 36, 40)
    for k, rings in shapes.items():
        want = np.array([[inside_plain(rings or [], x + 0.5, y + 0.5, even_odd) for x in range(40)] for y in range(36)])
        assert (got.get(k, np.zeros((36, 40), bool)) == want).all(), k
    assert got["star"][20, 20] != even_odd


def test_shapes_are_within_a_pixel(spark):
    body = {
        "rect": '<rect x="3" y="4.4" width="10" height="7.3"/>',
        "circle": '<circle cx="30" cy="25" r="17.3"/>',
        "ellipse": '<ellipse cx="30" cy="25" rx="27" ry="9.5"/>',
        "polygon": '<polygon points="1,1 40,2.5 20 45"/>',
        "curve": '<path d="M5 40 C 5 0 55 0 55 40 Q30 20 5 40z"/>',
        "relative": '<path d="m10 10h20v20h-20zM15 15v5h5v-5Z"/>',
        "text": "<text>no shape</text>",
    }
    rows = spark.createDataFrame([(k, f'<svg viewBox="0 0 60 50">{x}</svg>') for k, x in body.items()], "sheet_id string, svg string")
    shapes = outlines.rings_of(vector.elements(rows)).select(F.col("sheet_id").alias("k"), "rings")
    got = masks_of(outlines.filled(shapes, ["k"], F.lit(60), F.lit(50)), 50, 60)
    ys, xs = np.mgrid[0:50, 0:60] + 0.5

    def near(k, inside):
        """Different at most where the border passes through the pixel or a neighbour of it."""
        pad = np.pad(inside, 1, mode="edge")
        around = np.stack([pad[dy : dy + 50, dx : dx + 60] for dy in range(3) for dx in range(3)])
        border = around.any(axis=0) & ~around.all(axis=0)
        assert not ((got[k] != inside) & ~border).any() and (got[k] != inside).mean() < 0.01

    near("rect", (xs > 3) & (xs < 13) & (ys > 4.4) & (ys < 11.7))
    near("circle", (xs - 30) ** 2 + (ys - 25) ** 2 < 17.3**2)
    near("ellipse", ((xs - 30) / 27) ** 2 + ((ys - 25) / 9.5) ** 2 < 1)
    t = np.linspace(0, 1, 2001)
    upper = (1 - t) ** 3 * 40 + 3 * (1 - t) ** 2 * t * 0 + 3 * (1 - t) * t**2 * 0 + t**3 * 40
    along = (1 - t) ** 3 * 5 + 3 * (1 - t) ** 2 * t * 5 + 3 * (1 - t) * t**2 * 55 + t**3 * 55
    lower = (1 - t) ** 2 * 40 + 2 * (1 - t) * t * 20 + t**2 * 40
    near("curve", (xs > 5) & (xs < 55) & (ys > np.interp(xs, along, upper)) & (ys < np.interp(xs, 5 + 50 * t, lower)))
    want = np.zeros((50, 60), bool)
    want[10:30, 10:30] = True
    want[15:20, 15:20] = False
    assert (got["relative"] == want).all() and "text" not in got
    assert outlines.path_rings("M0 0 L5 5 A 1 1 0 0 0 9 9 L 8 8")[0][-1] == {"x": 5.0, "y": 5.0} and outlines.path_rings(None) == []


def test_filling_a_traced_mask_gives_it_back(spark):
    ring = np.zeros((30, 30), bool)
    ring[2:28, 2:28] = True
    ring[6:24, 6:24] = False
    ring[10:20, 10:20] = True
    ring[12, 12] = ring[15:18, 15] = False
    touch = np.add.outer(np.arange(9), np.arange(11)) % 2 == 0
    masks = some_masks(6) | {"ring": ring, "touch": touch, "spiral": spiral(41)}
    given, _ = frame(spark, masks)
    paths = outlines.traced(given, ["k"])
    told = {r.k: r for r in paths.collect()}
    assert set(told) == {k for k, m in masks.items() if m.any()}
    assert told["ring"].n_rings == 5 and told["spiral"].n_rings == 1 and told["one"].d == "M0 0L1 0L1 1L0 1Z" and told["touch"].n_rings == int(touch.sum())
    shapes = outlines.with_rings(paths)
    back = {}
    for r in outlines.filled(shapes, ["k"], F.lit(80), F.lit(80)).collect():
        back.setdefault(r.k, np.zeros((80, 80), bool))[r.y, r.x0 : r.x1] = True
    for k, m in masks.items():
        if m.any():
            h, w = m.shape
            assert (back[k][:h, :w] == m).all() and back[k].sum() == m.sum()


def test_corners_turn_and_areas_add_up(spark):
    masks = some_masks(11)
    given, _ = frame(spark, masks)
    rows = {}
    for r in outlines.rings(given, ["k"]).collect():
        rows.setdefault(r.k, {}).setdefault(tuple(r.ring), []).append((r.place, r.x, r.y))
    for k, m in masks.items():
        area = 0
        for corners in rows.get(k, {}).values():
            corners.sort()
            assert [p for p, _, _ in corners] == list(range(len(corners)))
            points = [(x, y) for _, x, y in corners]
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
                assert (ax == bx) != (ay == by)
                area += ax * by - bx * ay
        assert area == 2 * m.sum()


def test_drawings_become_masks(spark):
    rows = spark.createDataFrame([("a", '<svg><rect x="1" y="1" width="4" height="3"/><circle cx="8" cy="6" r="2"/><rect x="3" y="2" width="5" height="1"/></svg>'), ("b", "<svg><text/></svg>")], "sheet_id string, svg string")
    shapes = outlines.rings_of(vector.elements(rows))
    sizes = spark.createDataFrame([("a", 12, 10), ("b", 12, 10)], "sheet_id string, width int, height int")
    mask = outlines.mask_of(shapes, ["sheet_id"], "ord", F.lit(12), F.lit(10), sizes)
    boxes = runs.component_boxes(runs.labelled(mask, ["sheet_id"]), ["sheet_id"], 1).collect()
    assert {(r.sheet_id, r.x, r.y, r.w, r.h, r.area) for r in boxes} == {("a", 1, 1, 7, 3, 15), ("a", 6, 4, 4, 4, 12)}
    assert runs_of(np.ones((1, 2), bool)) == [(0, 0, 2)]


def test_filling_shuffles_no_crossings(spark):
    """A tall shape of few sides goes through no sort or shuffle line by line; rows of one key, null too, are one shape, however they are dealt."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rows = spark.createDataFrame([("a", [box(0.0, 0.0, 9.0, 300.0)]), ("a", [box(2.0, 100.0, 3.0, 9.0)[::-1]]), (None, [box(1.0, 60.0, 2.0, 9.0)]), (None, None), ("b", [])], f"k string, rings {outlines.POINTS.simpleString()}")
    for deal in (True, False):
        df = outlines.filled(rows, ["k"], F.lit(20), F.lit(250), deal=deal)
        got = df.groupBy("k").agg(F.sum(F.col("x1") - F.col("x0")), F.count("*"), F.min("y"), F.max("y")).collect()
        assert sorted(map(tuple, got), key=str) == [("a", 9 * 250 - 27, 259, 0, 249), (None, 18, 9, 60, 68)]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 + deal


def test_components_within_a_piece_go_through_no_rounds(spark, monkeypatch):
    """Masks lower than a piece are traced where they are; what reaches over a piece's end gives the same corners by rounds."""
    rng = np.random.default_rng(4)
    masks = {f"m{i}": rng.random((63, 50)) < p for i, p in enumerate([0.02, 0.4, 0.6, 0.9])} | {"spiral": spiral(41), "cross": np.eye(9, dtype=bool)}
    given, _ = frame(spark, masks)
    own = ["k", "ring", "place", "x", "y"]
    far = {tuple(r) for r in outlines._far_rings(given, ["k"]).select(*own).collect()}
    tall, _ = frame(spark, {"t": np.pad(masks["m1"], ((31, 200), (0, 0)))})
    tall_far = {tuple(r) for r in outlines._far_rings(tall, ["k"]).select(*own).collect()}
    assert {tuple(r) for r in outlines.rings(tall, ["k"]).select(*own).collect()} == tall_far
    monkeypatch.setattr(outlines, "_far_rings", None)
    assert {tuple(r) for r in outlines.rings(given, ["k"]).select(*own).collect()} == far

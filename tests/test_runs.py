"""Runs against plain numpy: morphology, components, background, quantiles, detection of whole sheets."""

import re
from collections import Counter

import numpy as np
import plain_raster as plain
import pytest
from glyphmill.operators import detection, pixels, runs
from glyphmill.operators.links import least_reachable
from glyphmill.operators.quantiles import quantiles
from pyspark.sql import functions as F


def runs_of(mask: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ys, x0 = np.nonzero(edge == 1)
    return [tuple(map(int, r)) for r in zip(ys, x0, np.nonzero(edge == -1)[1], strict=True)]


def frame(spark, masks: dict):
    rows = [(k, *r) for k, m in masks.items() for r in runs_of(m)]
    sizes = [(k, m.shape[1], m.shape[0]) for k, m in masks.items()]
    return spark.createDataFrame(rows, "k string, y int, x0 int, x1 int"), spark.createDataFrame(sizes, "k string, width int, height int")


def by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, set()).add(tuple(r[c] for c in cols))
    return out


def some_masks(seed=5):
    rng = np.random.default_rng(seed)
    masks = {f"m{i}": rng.random((int(rng.integers(1, 50)), int(rng.integers(1, 60)))) < p for i, p in enumerate([0.05, 0.3, 0.5, 0.8, 0.97])}
    return masks | {"empty": np.zeros((20, 9), bool), "full": np.ones((17, 5), bool), "one": np.ones((1, 1), bool)}


@pytest.mark.parametrize("size", [3, 5, 9, 13, 19])
def test_morphology_equals_plain_pixels(spark, size):
    masks = some_masks(size)
    given, sizes = frame(spark, masks)
    for kernel in (runs.ellipse(size), runs.square(size)):
        cells = plain.ellipse(size) if kernel == runs.ellipse(size) else np.ones((size, size), bool)
        for step, twin in ((runs.dilated, plain.dilate), (runs.eroded, plain.erode)):
            got = by_key(runs.morphed(given, sizes, ["k"], step, kernel, lines=16), "y", "x0", "x1")
            assert got == {k: set(runs_of(twin(m, cells))) for k, m in masks.items() if twin(m, cells).any()}


def test_opening_closing_and_odd_kernels(spark):
    masks = some_masks(1)
    given, sizes = frame(spark, masks)
    cells = np.array([[1, 0, 1], [0, 0, 0], [1, 1, 0], [0, 0, 1], [1, 0, 0]], bool)
    kernel = runs.kernel_rows(cells.tolist())
    assert runs.kernel_rows(plain.ellipse(7).tolist()) == runs.ellipse(7)
    for step, twin in ((runs.dilated, plain.dilate), (runs.eroded, plain.erode)):
        got = by_key(runs.morphed(given, sizes, ["k"], step, kernel, lines=7), "y", "x0", "x1")
        assert got == {k: set(runs_of(twin(m, cells))) for k, m in masks.items() if twin(m, cells).any()}
    for step, twin in ((runs.opened, plain.opened), (runs.closed, plain.closed)):
        got = by_key(runs.morphed(given, sizes, ["k"], step, runs.ellipse(3), lines=8), "y", "x0", "x1")
        assert got == {k: set(runs_of(twin(m, plain.ellipse(3)))) for k, m in masks.items() if twin(m, plain.ellipse(3)).any()}


def test_many_steps_take_one_shuffle(spark):
    given, sizes = frame(spark, some_masks(2))
    dealt = runs.pieces(given, sizes, ["k"], reach=8)
    plan = runs.closed(runs.opened(runs.united(dealt, ["k"]), ["k"], runs.ellipse(3)), ["k"], runs.ellipse(3), 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def spiral(n: int) -> np.ndarray:
    mask = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    mask[0, 0] = True
    while True:
        steps = 0
        while 0 <= y + dy < n and 0 <= x + dx < n and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and mask[y + 2 * dy, x + 2 * dx]):
            y, x, steps = y + dy, x + dx, steps + 1
            mask[y, x] = True
        if not steps:
            return mask
        dy, dx = dx, -dy


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("lines", [1, 5, 64])
def test_components_equal_plain_pixels(spark, diagonal, lines):
    masks = some_masks(9) | {"spiral": spiral(45), "comb": np.add.outer(np.arange(40) % 40 == 39, np.arange(41) % 2 == 0)}
    given, _ = frame(spark, masks)
    got = {}
    for r in runs.labelled(given, ["k"], diagonal=diagonal, lines=lines).collect():
        got.setdefault(r.k, {}).setdefault((r.label.y, r.label.x), set()).add((r.y, r.x0, r.x1))
    for k, mask in masks.items():
        labels = plain.label(mask, diagonal)
        want = [frozenset(runs_of(labels == n)) for n in range(1, labels.max() + 1)]
        assert set(map(frozenset, got.get(k, {}).values())) == set(want)
        assert all(label == min(part)[:2] for label, part in got.get(k, {}).items())


def test_links_reach_the_least(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = dict(map(tuple, least_reachable(spark.createDataFrame(chain, "a int, b int")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100}
    assert least_reachable(spark.createDataFrame([], "a int, b int")).count() == 0


def test_background_of_rings_and_nested_rings(spark):
    mask = np.zeros((90, 80), bool)
    for a, z in ((5, 70), (15, 60), (25, 50)):
        mask[a:z, a:z] = True
        mask[a + 4 : z - 4, a + 4 : z - 4] = False
    mask[36, 30:45] = True
    mask[5:9, 30:33] = False  # the outer ring is open: what is between it and the next is outside
    mask[15, 15] = mask[14, 14] = True
    for box in ((0, 0, 80, 90), (3, 2, 70, 71), (20, 20, 35, 35), (5, 5, 65, 65)):
        x, y, w, h = box
        given, _ = frame(spark, {"a": mask, "b": ~mask})
        boxes = spark.createDataFrame([(k, 7, *box) for k in "ab"], "k string, n int, x int, y int, w int, h int")
        got = {"a": np.zeros((h, w), bool), "b": np.zeros((h, w), bool)}
        holes = {"a": np.zeros((h, w), bool), "b": np.zeros((h, w), bool)}
        for r in runs.crop_background(given, boxes, ["k"], "n", lines=16).collect():
            (got if r.outside else holes)[r.k][r.y, r.x0 : r.x1] = True
        for k, m in (("a", mask), ("b", ~mask)):
            part = m[y : y + h, x : x + w]
            assert (got[k] == plain.exterior(part)).all() and (holes[k] == (~part & ~plain.exterior(part))).all()


def test_boxes_are_tightened_in_cells(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((200, 700)) < 0.002
    boxes = [(i, int(rng.integers(0, 600)), int(rng.integers(0, 150)), int(rng.integers(1, 400)), int(rng.integers(1, 120))) for i in range(60)]
    given, _ = frame(spark, {"s": mask})
    df = spark.createDataFrame([("s", *b) for b in boxes], "k string, i int, x int, y int, w int, h int")
    got = {r.i: (r.x, r.y, r.w, r.h) for r in runs.tightened(df, given, ["k"], "i").collect()}
    for i, x, y, w, h in boxes:
        ys, xs = np.nonzero(mask[y : y + h, x : x + w])
        assert got[i] == (plain.box_of(ys + y, xs + x) if len(ys) else (x, y, w, h))


@pytest.mark.parametrize("few", [4096, 1, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    from glyphmill.operators import quantiles as module

    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "BINS", 4 if few < 4096 else 1024)
    rng = np.random.default_rng(few)
    groups = {"a": rng.random(500), "b": np.repeat(rng.integers(0, 5, 40), 30).astype(float), "c": np.array([3.5]), "d": np.exp(rng.normal(0, 20, 300)), "e": np.array([-1.0, 2.0]), None: np.arange(9.0)}
    rows = [(k, float(v), int(t)) for k, vs in groups.items() for v in vs for t in [rng.integers(1, 4)]] + [("a", None, 3), ("a", 77.0, 0), ("z", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, t int")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.quantile for r in quantiles(df, ["k"], F.col("v"), q, F.col("t")).collect()}
        want = {k: np.quantile(np.repeat([r[1] for r in rows if r[0] == k and r[1] is not None], [r[2] for r in rows if r[0] == k and r[1] is not None]), q) for k in groups}
        assert set(got) == set(want)
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-12)


def pages():
    """Sheets with rings, dots, near strokes, gray noise; one wider than a cell, one with more lines than a piece."""
    rng = np.random.default_rng(8)
    out = {}
    page = np.full((200, 300, 3), 250, np.uint8)
    page[20:60, 30:80] = (30, 30, 200)
    page[100:160, 150:210] = (120, 20, 20)
    page[115:145, 165:195] = 250
    page[62:64, 30:80] = 90
    out["plain"] = page
    noisy = np.clip(235 + rng.normal(0, 4, (150, 330, 3)), 0, 255).astype(np.uint8)
    for _ in range(25):
        y, x, h, w = rng.integers(0, 130), rng.integers(0, 300), rng.integers(4, 30), rng.integers(4, 40)
        noisy[y : y + h, x : x + w] = rng.integers(0, 255, 3)
    out["noisy"] = noisy
    out["flat"] = np.full((40, 30, 3), 77, np.uint8)
    out["black"] = np.zeros((12, 9, 3), np.uint8)
    out["tiny"] = rng.integers(0, 255, (3, 2, 3)).astype(np.uint8)
    return out


def image_rows(spark, shown: dict):
    rows = [((k, int(p.shape[0]), int(p.shape[1]), 3, bytearray(p.tobytes())),) for k, p in shown.items()]
    return spark.createDataFrame(rows, "image struct<origin:string,height:int,width:int,nChannels:int,data:binary>")


def test_sheets_are_detected_as_plain_numpy_does(spark):
    shown = pages()
    coloured = detection.colour_runs(image_rows(spark, shown)).cache()
    told = detection.limits(coloured, ["sheet_id"]).cache()
    got = {r.sheet_id: r for r in told.collect()}
    mask = detection.foreground(coloured, told, ["sheet_id"]).withColumnRenamed("sheet_id", "k").cache()
    found = by_key(mask, "y", "x0", "x1")
    boxes = by_key(detection.icon_boxes(mask, told.withColumnRenamed("sheet_id", "k"), ["k"], min_area=30, merge_gap=6), "x", "y", "w", "h", "spread", "area")
    for k, page in shown.items():
        edge = plain.border(plain.lab(page))
        mean = edge.mean(axis=0)
        far, light = np.linalg.norm(edge - mean, axis=1), np.abs(edge[:, 0] - mean[0])
        r = got[k]
        assert (r.mean_l, r.mean_a, r.mean_b) == pytest.approx(tuple(mean))
        assert r.limit == pytest.approx(max(12.0, np.percentile(far, 95) * 2.5 + 6)) and r.light_limit == pytest.approx(max(10.0, np.percentile(light, 95) * 2.5 + 4))
        assert (r.bg_r, r.bg_g, r.bg_b) == plain.background(page) and r.threshold == plain.otsu(plain.gray(page))
        want = plain.foreground(page)
        assert found.get(k, set()) == set(runs_of(want))
        assert {(*b[:4], tuple(b[4]), b[5]) for b in boxes.get(k, set())} == {(*tight, wide, area) for tight, wide, area in plain.detect(page, 30, 6)}
    assert len(boxes["noisy"]) > 3 and found["plain"]


def test_border_weights_are_the_border_sample(spark):
    page = pages()["plain"][:37, :41]
    rows = [(int(y), int(x), int(x) + 1, int(page[y, x, 0]), 41, 37) for y in range(37) for x in range(41)]
    single = spark.createDataFrame(rows, "y int, x0 int, x1 int, b int, width int, height int")
    counted = {tuple(r) for r in single.groupBy("b").agg(F.sum(detection.border_weight())).where("b is not null").collect() if r[1]}
    sampled = {tuple(r) for r in pixels.border_sample(single.withColumn("x", F.col("x0"))).groupBy("b").count().collect()}
    values, n = np.unique(plain.border(page)[..., 0], return_counts=True)
    assert counted == sampled == {(int(v), int(m)) for v, m in zip(values, n, strict=True)}


def test_steps_are_one_pass(spark, sf_dir):
    """Many steps take one shuffle, no line is sorted by itself, and what is dealt has no rows for lines without runs."""
    from glyphmill.plans import registry

    given, sizes = frame(spark, some_masks(2))
    plans = {"closed": runs.morphed(given, sizes, ["k"], runs.closed, runs.square(3)), "dilate_sheets": registry.dilate_sheets(spark, sf_dir), "erode_sheets": registry.erode_sheets(spark, sf_dir)}
    for name, df in plans.items():
        text = df._jdf.queryExecution().executedPlan().toString()
        assert (text.count("Window"), text.count("Exchange hashpartitioning"), text.count("MapInArrow")) == (0, 1, 1), name
    tall = spark.createDataFrame([("a", 0, 3, 5), ("a", 900, 0, 2), (None, 7, 1, 2), ("b", 1, 1, 2)], "k string, y int, x0 int, x1 int")
    wide = spark.createDataFrame([("a", 9, 1000), (None, 4, 8), ("none", 3, 2)], "k string, width int, height int")
    assert by_key(runs.morphed(tall, wide, ["k"], runs.dilated, runs.square(3)), "y", "x0", "x1") == {"a": {(0, 2, 6), (1, 2, 6), (899, 0, 3), (900, 0, 3), (901, 0, 3)}, None: {(6, 0, 3), (7, 0, 3)}}
    ground = runs.worked(tall, wide, ["k"], lambda s: runs.strips.complement(runs.strips.united(s)))
    assert ground.groupBy("k").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).where("k is null").first()["n"] == 31
    assert {r.k: r.n for r in ground.groupBy("k").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).collect()} == {"a": 8996, None: 31, "none": 6}


def test_a_mask_is_one_pass(spark):
    """Dark closing, opening and closing of two layers are one step of the plan, so that a driver's plans stay small."""
    colours = spark.createDataFrame([("a", y, 0, 20, 10 * y, 10, 10, 20, 12) for y in range(12)], "k string, y int, x0 int, x1 int, r int, g int, b int, width int, height int")
    told = detection.limits(colours, ["k"])
    text = detection.foreground(colours, told.localCheckpoint(), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window") == 0 and text.count("MapInArrow") == 1


def test_tables_are_broadcast_by_their_rows(spark, sf_dir, monkeypatch):
    """And not by their files' size: where nothing is few, what is broadcast comes out of a shuffle, whose size Spark knows. Rows are the same."""
    from glyphmill.operators import links
    from glyphmill.operators import quantiles as module
    from glyphmill.plans import registry, session

    wanted = Counter(registry.sheet_icons(spark, sf_dir).collect())
    plans = []
    text = lambda df: df._jdf.queryExecution().executedPlan().toString().split("\n")
    for place in (registry, detection, runs, links, module):
        monkeypatch.setattr(place, "written", lambda df, what, cut=session.written: (plans.append(text(df)), cut(df, what))[1])
    monkeypatch.setattr(session, "FEW_ROWS", 0, raising=False)
    out = registry.sheet_icons(spark, sf_dir)
    plans.append(text(out))
    depth = lambda line: re.search(r"[A-Za-z*]|$", line).start()
    for lines in plans:
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
                assert any("Exchange hashpartitioning" in x for x in lines[i + 1 : end]), lines[i : i + 4]
    assert sum("SortMergeJoin" in line for lines in plans for line in lines) > 8
    assert Counter(out.collect()) == wanted and wanted


def test_few_rows_are_broadcast(spark, monkeypatch):
    from glyphmill.plans import session

    many = spark.range(9)
    for few, how in ((9, "BroadcastHashJoin"), (8, "SortMergeJoin")):
        monkeypatch.setattr(session, "FEW_ROWS", few)
        joined = spark.range(3).join(session.sized(many), "id")
        assert how in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 3

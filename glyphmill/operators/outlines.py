"""Outlines and runs: shapes are filled line by line, and the border of a mask becomes paths."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from glyphmill.operators import runs
from glyphmill.plans.session import release, ship_package, written

c = F.col

POINTS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))


# ---- shapes to rings of points -----------------------------------------------------------------


def _turned(cx: Column, cy: Column, rx: Column, ry: Column, least: int = 16) -> Column:
    """An ellipse as a ring whose sides stay within a twentieth of a pixel of it."""
    n = F.greatest(F.lit(least), F.ceil(F.lit(math.pi) / F.acos(1 - F.lit(0.05) / F.greatest(F.lit(0.1), F.greatest(rx, ry)))).cast("int"))
    angle = lambda i: i * F.lit(2 * math.pi) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((cx + rx * F.cos(angle(i))).alias("x"), (cy + ry * F.sin(angle(i))).alias("y")))


#: A path's commands with how many numbers each takes.
COMMANDS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "Q": 4, "Z": 0}
_STEPS = 24


def path_rings(d: str | None) -> list[list[dict]]:
    """Rings of a path's text; a curve is so many straight steps. Commands that aren't listed end the path."""
    rings: list[list[tuple[float, float]]] = []
    x = y = 0.0
    words = re.findall(r"[A-Za-z]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", d or "")
    at = 0
    command = ""
    while at < len(words):
        if words[at].isalpha():
            command, at = words[at], at + 1
        kind = command.upper()
        size = COMMANDS.get(kind)
        if size is None or len(words) - at < size or (not size and kind != "Z"):
            break
        if kind == "Z":
            if rings and rings[-1]:
                x, y = rings[-1][0]
            if at < len(words) and not words[at].isalpha():
                break
            continue
        v = [float(w) for w in words[at : at + size]]
        at += size
        ox, oy = (x, y) if command.islower() else (0.0, 0.0)
        if kind == "H":
            ends = [(ox + v[0], y)]
        elif kind == "V":
            ends = [(x, oy + v[0])]
        else:
            ends = [(ox + a, oy + b) for a, b in zip(v[::2], v[1::2], strict=True)]
        if kind == "M":
            rings.append([ends[0]])
            command = "l" if command == "m" else "L"
        else:
            if not rings:
                break
            if kind in "CQ":
                rings[-1] += _curve([(x, y), *ends])
            else:
                rings[-1].append(ends[0])
        x, y = ends[-1]
    return [[{"x": a, "y": b} for a, b in ring] for ring in rings]


def _curve(control: list[tuple[float, float]]) -> list[tuple[float, float]]:
    out = []
    for i in range(1, _STEPS + 1):
        points, t = control, i / _STEPS
        while len(points) > 1:
            points = [((1 - t) * a + t * p, (1 - t) * b + t * q) for (a, b), (p, q) in zip(points[:-1], points[1:], strict=True)]
        out.append(points[0])
    return out


@F.pandas_udf(POINTS)
def _path_rings(d: pd.Series) -> pd.Series:
    return pd.Series([path_rings(x) for x in d], dtype=object)


def with_rings(paths: DataFrame, d: str = "d") -> DataFrame:
    """Adds rings, the outline that a path's text gives."""
    ship_package(paths.sparkSession)
    return paths.withColumn("rings", _path_rings(d))


def rings_of(elements: DataFrame, tag: str = "tag", xml: str = "xml") -> DataFrame:
    """Adds rings, the outline of an SVG element: rect, circle, ellipse, polygon, path; null for others. Transforms aren't applied."""
    ship_package(elements.sparkSession)
    number = lambda n: F.coalesce(F.xpath_string(xml, F.lit(f"/*/@{n}")).try_cast("double"), F.lit(0.0))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = (number(n) for n in ("x", "y", "width", "height"))
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    numbers = F.transform(F.regexp_extract_all(F.xpath_string(xml, F.lit("/*/@points")), F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"), F.lit(0)), lambda n: n.try_cast("double"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size(numbers) / 2).cast("int"))), lambda i: point(F.get(numbers, 2 * i - 2), F.get(numbers, 2 * i - 1)))
    told = F.when(c(tag) == "rect", F.array(box)).when(c(tag) == "circle", F.array(_turned(number("cx"), number("cy"), number("r"), number("r")))).when(c(tag) == "ellipse", F.array(_turned(number("cx"), number("cy"), number("rx"), number("ry"))))
    told = told.when(c(tag) == "polygon", F.array(pairs)).when(c(tag) == "path", _path_rings(F.xpath_string(xml, F.lit("/*/@d"))))
    return elements.withColumn("rings", told)


# ---- filling -----------------------------------------------------------------------------------


def filled(shapes: DataFrame, keys: list[str], width: Column, height: Column, *, even_odd: bool = False, deal: bool = True) -> DataFrame:
    """keys, y, x0, x1: the pixels whose centres lie within each shape (keys and rings), cut to the canvas; keys name a shape.

    A shape's rows come together, and its sides are cut to stretches of lines. A side gives a crossing for each line whose middle it passes, and a line's
    crossings in order bound its runs: where the sum of directions isn't zero, or every second stretch with ``even_odd``. Crossings are
    made and used up stretch by stretch, so that they are neither shuffled nor sorted by Spark. Stretches are dealt out; without ``deal`` they
    stay where their shape is, which is cheaper where all shapes are small. Rings close by themselves. Shapes without rings give nothing.
    """
    ship_package(shapes.sparkSession)
    lines = runs.LINES
    own = W.partitionBy(*keys).orderBy(F.lit(0))
    every = F.flatten(F.collect_list("rings").over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    whole = shapes.select(*keys, width.cast("int").alias("_w"), height.cast("long").alias("_h"), "rings").withColumns({"_all": every, "_i": F.row_number().over(own)}).where("_i = 1")

    def side(a: Column, b: Column) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil(F.least(a["y"], b["y"]) - 0.5)), F.least(c("_h"), F.ceil(F.greatest(a["y"], b["y"]) - 0.5)) - 1
        return F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), first.alias("first"), last.alias("last"))

    closed = F.transform(F.filter("_all", lambda r: F.size(r) > 1), lambda r: F.zip_with(r, F.concat(F.slice(r, 2, 1 << 30), F.slice(r, 1, 1)), side))
    sides = whole.select(*keys, "_w", F.filter(F.flatten(closed), lambda s: s["first"] <= s["last"]).alias("_sides"))
    least, most = F.array_min(c("_sides.first")), F.array_max(c("_sides.last"))
    bands = sides.withColumn("_band", F.explode(F.sequence(F.floor(least / lines), F.floor(most / lines))))
    meets = lambda s: (s["first"] < (c("_band") + 1) * lines) & (s["last"] >= c("_band") * lines)
    bands = bands.select(*keys, "_w", "_band", F.filter("_sides", meets).alias("_sides"))
    if deal:
        bands = bands.repartition(*keys, "_band")
    schema = bands.select(*keys, *[F.lit(0).alias(n) for n in ("y", "x0", "x1")]).schema

    def run(stream):
        for batch in stream:
            for part in _few_crossings(batch, lines):
                yield _runs_of_sides(part, lines, even_odd)

    return bands.mapInArrow(run, schema)


def _few_crossings(batch: pa.RecordBatch, lines: int, most: int = 2_000_000):
    """The rows of a batch in slices that have about ``most`` crossings at most; one row stays whole."""
    upto = np.cumsum(np.diff(batch.column(batch.num_columns - 1).offsets.to_numpy())) * lines // most
    cuts = [0, *(np.flatnonzero(upto[1:] != upto[:-1]) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _runs_of_sides(batch: pa.RecordBatch, lines: int, even_odd: bool) -> pa.RecordBatch:
    """Runs of the stretches of shapes: keys, width, band and sides in, keys, y, x0, x1 out."""
    *keys, width, band, held = batch.columns
    row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
    ax, ay, bx, by, first, last = (v.to_numpy(zero_copy_only=False) for v in held.flatten().flatten())
    top = band.to_numpy()[row] * lines
    low, high = np.maximum(first, top), np.minimum(last, top + lines - 1)
    many = high - low + 1
    of = np.repeat(np.arange(len(many)), many)
    y = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    x = ax[of] + (y + 0.5 - ay[of]) * (bx[of] - ax[of]) / (by[of] - ay[of])
    turn = np.where(by > ay, 1, -1)[of]
    line = row[of] * lines + y - top[of]
    order = np.lexsort((turn, x, line))
    row, y, x, turn, line = row[of][order], y[order], x[order], turn[order], line[order]
    new = np.r_[True, line[1:] != line[:-1]][: len(line)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(line)), 0))
    turns = np.cumsum(turn)
    inside = (np.arange(len(line)) - start) % 2 == 0 if even_odd else turns - (turns - turn)[start] != 0
    at = np.ceil(np.clip(x, 0, width.to_numpy()[row]) - 0.5).astype(np.int32)
    pair = np.flatnonzero(inside[:-1] & ~new[1:] & (at[:-1] < at[1:]))
    keep = pa.array(row[pair])
    return pa.RecordBatch.from_arrays([*[k.take(keep) for k in keys], pa.array(y[pair].astype(np.int32)), pa.array(at[pair]), pa.array(at[pair + 1])], names=[*batch.schema.names[: len(keys)], "y", "x0", "x1"])


# ---- tracing -----------------------------------------------------------------------------------

#: Directions: right, down, left, up. What is inside lies to the right of a side.
RIGHT, DOWN, LEFT, UP = range(4)


def sides(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, dir, x2, y2: the straight sides of a mask's border, each from corner to corner, the mask to its right.

    ``mask`` has united runs. Level sides are what a run doesn't share with the runs above or below; upright ones are run ends,
    those on end made one.
    """
    level = []
    for shift, direction in ((1, RIGHT), (-1, LEFT)):
        # a run's line without its neighbour's: begin and end are marks, and a stretch counts where only the own run is open
        own = F.array(F.struct(c("x0").alias("at"), F.lit(1).alias("own"), F.lit(0).alias("other")), F.struct(c("x1").alias("at"), F.lit(-1).alias("own"), F.lit(0).alias("other")))
        other = F.array(F.struct(c("x0").alias("at"), F.lit(0).alias("own"), F.lit(1).alias("other")), F.struct(c("x1").alias("at"), F.lit(0).alias("own"), F.lit(-1).alias("other")))
        marks = mask.select(*keys, "y", F.inline(own)).unionByName(mask.select(*keys, (c("y") + shift).alias("y"), F.inline(other)))
        marks = marks.groupBy(*keys, "y", "at").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
        by = W.partitionBy(*keys, "y").orderBy("at")
        upto = by.rowsBetween(W.unboundedPreceding, 0)
        open_ = marks.withColumns({"_own": F.sum("own").over(upto), "_other": F.sum("other").over(upto), "_to": F.lead("at").over(by)})
        bare = open_.where("_own > 0 and _other = 0")
        if direction == RIGHT:
            level.append(bare.select(*keys, c("at").alias("x"), "y", F.lit(RIGHT).alias("dir"), c("_to").alias("x2"), c("y").alias("y2")))
        else:
            level.append(bare.select(*keys, c("_to").alias("x"), (c("y") + 1).alias("y"), F.lit(LEFT).alias("dir"), c("at").alias("x2"), (c("y") + 1).alias("y2")))
    ends = mask.select(*keys, "y", F.inline(F.array(F.struct(c("x0").alias("x"), F.lit(UP).alias("dir")), F.struct(c("x1").alias("x"), F.lit(DOWN).alias("dir")))))
    stretch = c("y") - F.row_number().over(W.partitionBy(*keys, "x", "dir").orderBy("y"))
    upright = ends.withColumn("_i", stretch).groupBy(*keys, "x", "dir", "_i").agg(F.min("y").alias("a"), (F.max("y") + 1).alias("b"))
    down = c("dir") == DOWN
    upright = upright.select(*keys, "x", F.when(down, c("a")).otherwise(c("b")).alias("y"), "dir", c("x").alias("x2"), F.when(down, c("b")).otherwise(c("a")).alias("y2"))
    return level[0].unionByName(level[1]).unionByName(upright)


def rings(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring, place, x, y: the corners of a mask's border, ring by ring; a ring is named by its least corner, place 0.

    Sides link to the one that starts where they end, the right turn first where two pixels touch at a corner only. Pixels that touch nowhere have no
    side or corner in common, so components that lie within a piece of the mask are traced where they are; only those that reach
    its first or last line go through rounds (``_far_rings``).
    """
    ship_package(mask.sparkSession)
    n_keys, lines = len(keys), runs.LINES
    rows = mask.select(*keys, F.floor(c("y") / lines).cast("int").alias("band"), *[c(n).cast("int").alias(n) for n in ("y", "x0", "x1")])
    dealt = rows.repartition(*keys, "band").sortWithinPartitions(*keys, "band", "y", "x0")
    names = ("far", "place", "y", "x", "z", "ring_y", "ring_x", "ring_dir")
    schema = dealt.select(*keys, F.lit(True).alias("far"), *[F.lit(0).alias(n) for n in names[1:]]).schema

    def run(stream):
        for table in runs.whole_pieces(stream, [*range(n_keys + 1)]):
            yield _traced_pieces(table, n_keys, lines, names)

    told = written(dealt.mapInArrow(run, schema), "traced")
    near = told.where("not far").select(*keys, F.struct(c("ring_y").alias("y"), c("ring_x").alias("x"), c("ring_dir").alias("dir")).alias("ring"), c("place").cast("long").alias("place"), "x", "y")
    far = told.where("far").select(*keys, "y", c("x").alias("x0"), c("z").alias("x1"))
    return near if far.isEmpty() else near.unionByName(_far_rings(far, keys))


def _traced_pieces(table, n_keys: int, lines: int, names: tuple[str, ...]) -> pa.RecordBatch:
    """Corners of the components within their piece, and runs of the others (far), of whole pieces in order (keys, band, y, x0, x1)."""
    number = lambda n: table.column(n).to_numpy().astype(np.int64)
    band, y, x0, x1 = (number(n) for n in ("band", "y", "x0", "x1"))
    first = runs.openings(table, [*range(n_keys + 1)])
    piece = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))
    component = runs.local_roots(table, n_keys, 1)
    reaches = ((y == band * lines) & (y > 0)) | (y == band * lines + lines - 1)
    open_ = np.zeros(table.num_rows, bool)
    np.logical_or.at(open_, component, reaches)
    far = open_[component]
    high, wide = lines + 2, int(x1.max(initial=0)) + 2
    own = piece * high + y - band * lines + 1
    line, a, z = own[~far], x0[~far], x1[~far]
    (ry, rx, rz), (ly, lx, lz) = _bare(line, a, z, wide, 1), _bare(line, a, z, wide, -1)
    up = np.r_[np.zeros(len(a), np.int64), np.ones(len(z), np.int64)]
    key = ((np.r_[line, line] // high * 2 + up) * wide + np.r_[a, z]) * high + np.r_[line, line] % high
    key = np.sort(key)
    opens = np.flatnonzero(np.r_[True, np.diff(key) != 1][: len(key)])
    shuts = np.r_[opens[1:] - 1, len(key) - 1] if len(key) else opens
    at, top, bottom = key[opens] // high, key[opens] % high, key[shuts] % high + 1
    down, base = at // wide % 2 == 1, at // wide // 2 * high
    x = np.r_[rx, lz, at % wide]
    v = np.r_[ry, ly + 1, base + np.where(down, top, bottom)]
    x2 = np.r_[rz, lx, at % wide]
    v2 = np.r_[ry, ly + 1, base + np.where(down, bottom, top)]
    turn = np.r_[np.full(len(rx), RIGHT), np.full(len(lx), LEFT), np.where(down, DOWN, UP)]
    start = (v * wide + x) * 4 + turn
    order = np.argsort(start)
    start, x, v, end, turn = start[order], x[order], v[order], (v2 * wide + x2)[order] * 4, turn[order]
    n = len(start)
    right = np.searchsorted(start, end + (turn + 1) % 4)
    there = start[np.minimum(right, n - 1)] == end + (turn + 1) % 4 if n else np.zeros(0, bool)
    ahead = np.where(there, right, np.searchsorted(start, end + (turn + 3) % 4))
    # as in the rounds of _far_rings
    here = np.arange(n)
    least, away, step = np.minimum(here, ahead), np.where(here <= ahead, 0, 1), 1
    while True:
        lower = least[ahead] < least
        if not lower.any():
            break
        least, away, ahead, step = np.where(lower, least[ahead], least), np.where(lower, away[ahead] + step, away), ahead[ahead], step * 2
    place = np.where(away == 0, 0, np.bincount(least, minlength=n)[least] - away) if n else least
    to_y = lambda v: v % high - 1 + band[first[v // high]] * lines
    rows = pa.array(np.r_[first[v // high], np.flatnonzero(far)])
    none = np.zeros(far.sum(), np.int64)
    made = {"place": (place, none), "y": (to_y(v), y[far]), "x": (x, x0[far]), "z": (np.zeros(n, np.int64), x1[far]), "ring_y": (to_y(v[least]), none), "ring_x": (x[least], none), "ring_dir": (turn[least], none)}
    arrays = [pa.array(np.r_[np.zeros(n, bool), np.ones(far.sum(), bool)]), *[pa.array(np.concatenate(made[m]).astype(np.int32)) for m in names[1:]]]
    return pa.RecordBatch.from_arrays([*[table.column(i).combine_chunks().take(rows) for i in range(n_keys)], *arrays], names=[*table.column_names[:n_keys], *names])


def _bare(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, wide: int, shift: int) -> tuple[np.ndarray, ...]:
    """line, x0, x1 of what runs don't share with those of the line before (1) or after (-1)."""
    marks, at = np.unique(np.r_[line * wide + x0, line * wide + x1, (line + shift) * wide + x0, (line + shift) * wide + x1], return_inverse=True)
    n = len(line)
    own, other = np.zeros(len(marks), np.int64), np.zeros(len(marks), np.int64)
    np.add.at(own, at[: 2 * n], np.repeat([1, -1], n))
    np.add.at(other, at[2 * n :], np.repeat([1, -1], n))
    bare = np.flatnonzero((np.cumsum(own) > 0) & (np.cumsum(other) == 0))
    return marks[bare] // wide, marks[bare] % wide, marks[bare + 1] % wide


def _far_rings(mask: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """``rings`` of components of any size. In each round
    a side learns of the least side within twice as many steps, and how far it is, so rounds grow with the logarithm of the longest ring.
    """
    edge = written(sides(mask, keys).withColumn("id", F.struct("y", "x", "dir")), "sides")
    start = edge.select(*keys, c("x").alias("x2"), c("y").alias("y2"), c("dir").alias("_turn"), c("id").alias("next"))
    fits = (c("dir") + c("_turn")) % 2 == 1
    right = F.when(c("_turn") == (c("dir") + 1) % 4, 0).otherwise(1)
    linked = edge.join(start, [*keys, "x2", "y2"]).where(fits).groupBy(*keys, "id").agg(F.min_by("next", right).alias("next"))
    now = written(linked.select(*keys, "id", "next", F.least("id", "next").alias("least"), F.when(c("id") <= c("next"), 0).otherwise(1).cast("long").alias("far"), F.lit(1).cast("long").alias("step")), "rings")
    for _ in range(most_rounds):
        ahead = now.select(*keys, c("id").alias("next"), c("next").alias("_next"), c("least").alias("_least"), c("far").alias("_far"))
        lower = c("_least") < c("least")
        both = now.join(ahead, [*keys, "next"])
        new = written(both.select(*keys, "id", c("_next").alias("next"), F.least("least", "_least").alias("least"), F.when(lower, c("_far") + c("step")).otherwise(c("far")).alias("far"), (c("step") * 2).alias("step"), lower.alias("moved")), "rings")
        release(now)
        now = new
        if now.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"rings: no end after {most_rounds} rounds")
    size = now.groupBy(*keys, "least").agg(F.count("*").alias("n"))
    told = now.join(size, [*keys, "least"])
    place = F.when(c("far") == 0, F.lit(0)).otherwise(c("n") - c("far"))
    return told.select(*keys, c("least").alias("ring"), place.alias("place"), c("id.x").alias("x"), c("id.y").alias("y"))


def paths(corners: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d, n_rings: path text of all rings of each key, in the order of their least corners. Filling it gives the mask back."""
    point = F.struct("place", "x", "y")
    ring = corners.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(point)).alias("points"))
    text = F.concat(F.lit("M"), F.array_join(F.transform("points", lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string"))), "L"), F.lit("Z"))
    each = ring.select(*keys, F.struct("ring", text.alias("text")).alias("r"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("r"))
    return whole.select(*keys, F.array_join(c("r.text"), "").alias("d"), F.size("r").alias("n_rings"))


def traced(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, d, n_rings: the border of each mask as path text."""
    return paths(rings(mask, keys), keys)


def mask_of(shapes: DataFrame, keys: list[str], shape: str, width: Column, height: Column, sizes: DataFrame) -> DataFrame:
    """keys, y, x0, x1 of all of a drawing's shapes together."""
    each = filled(shapes, [*keys, shape], width, height).drop(shape)
    return runs.core(runs.united(runs.pieces(each, sizes, keys), keys))

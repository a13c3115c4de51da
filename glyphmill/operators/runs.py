"""Pictures as runs: rows of keys, y, x0, x1 (x1 not included), never of pixels.

Operators on neighbouring lines work on pieces: stretches of lines of a picture, with so many lines of the next ones as what is done to
them can reach. A piece lies in one task, so any number of steps on it needs one shuffle; a large picture is many pieces. Each line of a
piece ends with an empty run beyond its width, so that lines without runs are there too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.functions import strips
from glyphmill.functions.strips import Strips
from glyphmill.operators.links import least_reachable
from glyphmill.plans.session import ship_package, sized, written

c = F.col

#: Lines of a piece, and pixels of a cell in which boxes and runs meet.
LINES, CELL = 64, 256

#: A row of a kernel: its distance from the centre, and the first and last of its cells, from the centre too.
Kernel = Sequence[tuple[int, int, int]]


# ---- kernels -----------------------------------------------------------------------------------


def kernel_rows(cells: Sequence[Sequence[bool]]) -> Kernel:
    """The stretches of any kernel with odd sides."""
    ry, out = len(cells) // 2, []
    for y, row in enumerate(cells):
        rx, x = len(row) // 2, 0
        while x < len(row):
            end = x
            while end < len(row) and row[end]:
                end += 1
            if end > x:
                out.append((y - ry, x - rx, end - 1 - rx))
            x = max(end, x + 1)
    return out


def ellipse(size: int) -> Kernel:
    """Each row's half width follows the ellipse of the box, rounded."""
    r = size // 2
    half = lambda dy: round(r * math.sqrt(max(1 - (dy / max(r, 1)) ** 2, 0)))
    return [(dy, -half(dy), half(dy)) for dy in range(-r, r + 1)]


def square(size: int) -> Kernel:
    r = size // 2
    return [(dy, -r, r) for dy in range(-r, r + 1)]


#: Moves nothing.
STILL: Kernel = [(0, 0, 0)]


# ---- pieces ------------------------------------------------------------------------------------


def pieces(runs: DataFrame, sizes: DataFrame | tuple[int, int], keys: list[str], *, reach: int = 0, lines: int = LINES, layers: Sequence[int] = (), ends: bool = True) -> DataFrame:
    """Deals runs (keys, y, x0, x1; layer, if ``layers`` are named) over pieces: adds band, width, top and bottom (lines that the piece has).

    ``sizes`` has keys, width and height, a row for each picture; or it is one width and height of all. ``reach`` is the number of lines that
    later steps look up or down altogether; ``core`` drops them again. Rows of a piece are hash-partitioned by keys and band. Without ``ends``
    there are no empty runs, so that lines without runs cost nothing; that is enough for what only dilates.
    """
    if isinstance(sizes, tuple):
        if ends:
            sizes = runs.select(*keys).distinct().select(*keys, *[F.lit(n).alias(name) for n, name in zip(sizes, ("width", "height"), strict=True)])
        else:
            runs = runs.withColumns({"width": F.lit(sizes[0]), "height": F.lit(sizes[1])})
    upper, lower = F.greatest(F.lit(0), c("band") * lines - reach).cast("int"), F.least(c("height"), (c("band") + 1) * lines + reach).cast("int")
    at = runs.withColumn("band", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), c("y") - reach) / lines), F.floor((c("y") + reach) / lines))))
    own = at.select(*keys, "band", *[c(n).cast("int").alias(n) for n in ("y", "x0", "x1")], *(["layer"] if layers else []))
    if not ends:
        sized = at.select(*keys, "band", "width", "height", "y", "x0", "x1") if isinstance(sizes, tuple) else own.join(sized(sizes.select(*keys, "width", "height")), keys)
        sized = sized.where((c("band") * lines < c("height")) & (c("y") < c("height")))
        return sized.withColumns({"top": upper, "bottom": lower}).drop("height").repartition(*keys, "band")
    bands = sizes.where("width > 0 and height > 0").select(*keys, c("width").cast("int").alias("width"), "height", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("height") - 1) / lines))).alias("band"))
    every = bands.withColumns({"top": upper, "bottom": lower})
    last = every.select(*keys, "band", F.explode(F.sequence("top", c("bottom") - 1)).alias("y"), (c("width") + 1).alias("x0"), (c("width") + 1).alias("x1"), "width", "top", "bottom")
    if layers:
        last = last.withColumn("layer", F.explode(F.array(*[F.lit(n) for n in layers])))
    dealt = last.unionByName(own, allowMissingColumns=True).repartition(*keys, "band")
    # the ends say how wide and how high a piece is; runs below the last line have none
    piece = W.partitionBy(*keys, "band")
    return dealt.withColumns({n: F.max(n).over(piece) for n in ("width", "top", "bottom")}).where("y < bottom")


def core(runs: DataFrame, lines: int = LINES) -> DataFrame:
    """The lines that are a piece's own, without the empty runs at their ends."""
    return runs.where((F.floor(c("y") / lines) == c("band")) & (c("x0") <= c("width"))).drop("band", "width", "top", "bottom")


def _line(keys: list[str]):
    return W.partitionBy(*keys, "band", "y").orderBy("x0")


def united(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a line that overlap or touch become one: a run opens an island if it begins beyond all that ended before."""
    by = _line(keys)
    reached = F.max("x1").over(by.rowsBetween(W.unboundedPreceding, -1))
    furthest = F.max("x1").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    islands = runs.withColumns({"_m": reached, "_end": furthest}).where("_m is null or x0 > _m")
    return islands.withColumn("x1", F.coalesce(F.lead("_m").over(by), c("_end"))).drop("_m", "_end")


def complement(runs: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between united runs."""
    pair = lambda a, b: F.struct(a.alias("x0"), b.alias("x1"))
    gap = pair(F.coalesce(F.lag("x1").over(_line(keys)), F.lit(0)), F.least("x0", "width"))
    told = runs.withColumn("_gap", gap)
    told = told.withColumn("_gap", F.explode(F.when(c("x0") > c("width"), F.array("_gap", pair(c("x0"), c("x1")))).otherwise(F.array("_gap"))))
    return told.withColumns({"x0": c("_gap.x0"), "x1": c("_gap.x1")}).drop("_gap").where((c("x0") < c("x1")) | (c("x0") > c("width")))


def _moves(kernel: Kernel) -> Column:
    return F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dy, lo, hi in kernel])


def dilated(runs: DataFrame, keys: list[str], kernel: Kernel, where: Column | None = None) -> DataFrame:
    """A pixel is set if any pixel under the kernel is. A run gives a wider run for each row of the kernel, not a row for each cell.

    Runs for which ``where`` doesn't hold stay as they are.
    """
    moves = _moves(kernel) if where is None else F.when(where, _moves(kernel)).otherwise(_moves(STILL))
    end = c("x0") > c("width")
    spread = runs.withColumn("_k", F.explode(F.when(end, _moves(STILL)).otherwise(moves)))
    x0, x1 = F.greatest(F.lit(0), c("x0") - c("_k.hi")), F.least(c("width"), c("x1") - c("_k.lo"))
    moved = spread.select(*[n for n in runs.columns if n not in ("y", "x0", "x1")], (c("y") - c("_k.dy")).alias("y"), F.when(end, c("x0")).otherwise(x0).alias("x0"), F.when(end, c("x1")).otherwise(x1).alias("x1"))
    inside = (c("y") >= c("top")) & (c("y") < c("bottom")) & ((c("x0") < c("x1")) | (c("x0") > c("width")))
    return united(moved.where(inside), keys)


def eroded(runs: DataFrame, keys: list[str], kernel: Kernel, where: Column | None = None) -> DataFrame:
    """A pixel stays if all pixels of the picture under the kernel are set: what lies between the runs is dilated."""
    return complement(dilated(complement(runs, keys), keys, kernel, where), keys)


def opened(runs: DataFrame, keys: list[str], kernel: Kernel) -> DataFrame:
    return dilated(eroded(runs, keys, kernel), keys, kernel)


def closed(runs: DataFrame, keys: list[str], kernel: Kernel, times: int = 1, where: Column | None = None) -> DataFrame:
    for _ in range(times):
        runs = dilated(runs, keys, kernel, where)
    for _ in range(times):
        runs = eroded(runs, keys, kernel, where)
    return runs


def worked(runs: DataFrame, sizes: DataFrame | tuple[int, int], keys: list[str], work, *, reach: int = 0, lines: int = LINES, empty: bool = False) -> DataFrame:
    """keys, y, x0, x1: what ``work`` (``Strips`` to ``Strips``) makes of the runs (keys, y, x0, x1; layer, if there is one) of every picture.

    Runs are dealt over pieces as in ``pieces``, and any number of steps takes one shuffle and one pass. A piece's size comes with one row of its own, not
    with a row for each line; where one size holds for all, it comes with none, and pieces without runs give nothing unless ``empty`` is set.
    """
    ship_package(runs.sparkSession)
    fixed = sizes if isinstance(sizes, tuple) and not empty else None
    if isinstance(sizes, tuple):
        sizes = runs.select(*keys).distinct().select(*keys, *[F.lit(n).alias(name) for n, name in zip(sizes, ("width", "height"), strict=True)])
    at = runs.where("y >= 0 and x0 < x1").withColumn("band", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), c("y") - reach) / lines), F.floor((c("y") + reach) / lines))))
    layer = [c("layer").cast("int").alias("layer")] if "layer" in runs.columns else []
    dealt = at.select(*keys, c("band").cast("int").alias("band"), *[c(n).cast("int").alias(n) for n in ("y", "x0", "x1")], *layer)
    if fixed:
        dealt = dealt.where((c("band") * lines < fixed[1]) & (c("y") < fixed[1]))
    else:
        own = sizes.where("width > 0 and height > 0").select(*keys, c("width").cast("int").alias("width"), c("height").cast("int").alias("height"))
        dealt = dealt.unionByName(own.withColumn("band", F.explode(F.sequence(F.lit(0), F.floor((c("height") - 1) / lines).cast("int")))), allowMissingColumns=True)
    dealt = dealt.repartition(*keys, "band").sortWithinPartitions(*keys, "band")
    n_keys = len(keys)

    def run(stream):
        for table in whole_pieces(stream, [*range(n_keys + 1)]):
            yield _worked_pieces(table, n_keys, fixed, work, reach, lines)

    return dealt.mapInArrow(run, dealt.select(*keys, *[F.lit(0).alias(n) for n in ("y", "x0", "x1")]).schema)


def _worked_pieces(table, n_keys: int, fixed: tuple[int, int] | None, work, reach: int, lines: int) -> pa.RecordBatch:
    """The own lines of the pieces of a table (keys, band and the rest, a piece's rows together) after ``work``."""
    first = openings(table, [*range(n_keys + 1)])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, table.num_rows]))
    number = lambda n: table.column(n).combine_chunks().fill_null(-1).to_numpy().astype(np.int64)
    band, y, x0, x1 = (number(n) for n in ("band", "y", "x0", "x1"))
    band = band[first]
    width, height = (np.full(len(first), n) for n in fixed) if fixed else (np.maximum(np.maximum.reduceat(number(n), first), 0) for n in ("width", "height"))
    top = np.maximum(0, band * lines - reach)
    many = np.maximum(np.minimum(height, (band + 1) * lines + reach) - top, 0)
    base = np.cumsum(many) - many
    ok = (y >= top[of]) & (y < (top + many)[of])
    layer = number("layer")[ok] if "layer" in table.column_names else None
    piece = np.repeat(np.arange(len(first)), many)
    out = work(Strips((base[of] + y - top[of])[ok], x0[ok], x1[ok], piece, width[piece], layer))
    of = piece[out.line]
    y = out.line - base[of] + top[of]
    own = y // lines == band[of]
    rows = pa.array(first[of[own]])
    made = [pa.array(v[own].astype(np.int32)) for v in (y, out.x0, out.x1)]
    return pa.RecordBatch.from_arrays([*[table.column(i).combine_chunks().take(rows) for i in range(n_keys)], *made], names=[*table.column_names[:n_keys], "y", "x0", "x1"])


def morphed(runs: DataFrame, sizes: DataFrame | tuple[int, int], keys: list[str], step, kernel: Kernel, lines: int = LINES) -> DataFrame:
    """``step`` (dilated, eroded, opened, closed) over whole pictures: keys, y, x0, x1."""
    high = max(abs(dy) for dy, _, _ in kernel) * (1 if step in (dilated, eroded) else 2)
    twin = getattr(strips, step.__name__)
    return worked(runs.select(*keys, "y", "x0", "x1"), sizes, keys, lambda s: twin(strips.united(s), kernel), reach=high, lines=lines)


# ---- components --------------------------------------------------------------------------------


def labelled(runs: DataFrame, keys: list[str], *, diagonal: bool = True, lines: int = LINES) -> DataFrame:
    """Adds label, the least (y, x) of all runs that touching runs lead to, over eight neighbours or four. Runs of a line don't touch.

    Two levels: within a piece of ``lines`` lines runs are united where they lie. A piece also holds the first line
    of the next one, whose runs therefore have a label in either; such pairs of labels are linked, and only they go through rounds.
    """
    if "label" in keys:
        raise ValueError("label is what is added")
    ship_package(runs.sparkSession)
    rows = runs.select(*keys, "y", "x0", "x1").withColumn("band", F.floor(c("y") / lines))
    shared = (c("y") % lines == 0) & (c("y") > 0)
    dealt = rows.withColumn("band", F.explode(F.when(shared, F.array("band", c("band") - 1)).otherwise(F.array("band"))))
    sorted_ = dealt.repartition(*keys, "band").sortWithinPartitions(*keys, "band", "y", "x0")
    schema = dealt.select("*", F.lit(0).alias("ly"), F.lit(0).alias("lx")).schema
    n_keys, reach = len(keys), int(diagonal)

    def run(stream):
        for table in whole_pieces(stream, [*range(n_keys), schema.names.index("band")]):
            ly, lx = _local_labels(table, n_keys, reach)
            yield table.append_column("ly", pa.array(ly, pa.int32())).append_column("lx", pa.array(lx, pa.int32())).to_batches()[0]

    label = F.struct(c("ly").alias("y"), c("lx").alias("x"))
    local = written(sorted_.mapInArrow(run, schema), "labels")
    node = F.struct(*keys, label.alias("label"))
    own = local.where(F.floor(c("y") / lines) == c("band"))
    seams = own.where(shared).select(*keys, "y", "x0", node.alias("a"))
    ghosts = local.where(F.floor(c("y") / lines) != c("band")).select(*keys, "y", "x0", node.alias("b"))
    same = [seams[n].eqNullSafe(ghosts[n]) for n in [*keys, "y", "x0"]]
    roots = least_reachable(seams.join(ghosts.hint("merge"), same).select("a", "b"))
    told = own.select(*keys, "y", "x0", "x1", node.alias("node")).join(roots, "node", "left")
    return told.select(*keys, "y", "x0", "x1", F.coalesce("root", "node")["label"].alias("label"))


def whole_pieces(stream, tile_columns: list[int]):
    """Tables that end where a piece ends; a piece is held whole, and it is bounded by its lines."""
    held: list = []
    for batch in stream:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        cut = openings(table, tile_columns)[-1] if table.num_rows else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut).combine_chunks()
        held = rest.to_batches() if rest.num_rows else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def openings(table, columns: list[int]) -> np.ndarray:
    """Where rows differ from the row before in any of the columns; 0 first."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    todo = [table.column(at).combine_chunks() for at in columns]
    while todo:
        array = todo.pop()
        if pa.types.is_struct(array.type):
            todo += array.flatten()
            continue
        codes = pc.dictionary_encode(array, null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _local_labels(table, n_keys: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run, y and x0 of the first run of its component within its piece; rows are sorted by piece, y, x0."""
    root = local_roots(table, n_keys, reach)
    return table.column("y").to_numpy()[root], table.column("x0").to_numpy()[root]


def local_roots(table, n_keys: int, reach: int) -> np.ndarray:
    """For each run, the row of the first run of its component within its piece."""
    y, x0, x1 = (table.column(n).to_numpy().astype(np.int64) for n in ("y", "x0", "x1"))
    n = len(y)
    piece = np.zeros(n, np.int64)
    piece[openings(table, [*range(n_keys), table.column_names.index("band")])] = 1
    piece = np.cumsum(piece)
    fresh = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (y[1:] != y[:-1])])
    line = np.zeros(n, np.int64)
    line[fresh] = 1
    line = np.cumsum(line) - 1
    # the next line of rows follows if it is of the same piece and one further down
    follows = np.r_[(piece[fresh[1:]] == piece[fresh[:-1]]) & (y[fresh[1:]] == y[fresh[:-1]] + 1), False]
    upper = np.flatnonzero(follows[line])
    wide = int(x1.max(initial=0)) + 2
    ends, begins = line * wide + x1, line * wide + x0
    below = (line[upper] + 1) * wide
    first = np.searchsorted(ends, below + np.maximum(x0[upper] - reach, 0), side="right")
    last = np.searchsorted(begins, below + np.minimum(x1[upper] + reach, wide - 1), side="left")
    first = np.maximum(first, np.r_[fresh, n][line[upper] + 1])
    many = np.maximum(last - first, 0)
    a = np.repeat(upper, many)
    b = np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(upper) else np.zeros(0, np.int64)
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        ra, rb = ra[apart], rb[apart]
        low = np.minimum(ra, rb)
        np.minimum.at(root, np.maximum(ra, rb), low)
        while (root != root[root]).any():
            root = root[root]
    return root


def component_boxes(labels: DataFrame, keys: list[str], min_area: int) -> DataFrame:
    """keys, label, x, y, w, h, area of components with that many pixels at least; sums are combined before they are shuffled."""
    out = labels.groupBy(*keys, "label").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0")).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(c("x1") - c("x0")).alias("area"))
    return out.where(c("area") >= min_area)


# ---- runs and boxes ----------------------------------------------------------------------------


def within(runs: DataFrame, boxes: DataFrame, keys: list[str], *, lines: int = LINES, cell: int = CELL) -> DataFrame:
    """The parts of runs in boxes (keys, x, y, w, h and more): a row for each run and box that meet, with all columns of either; x0 and x1 are cut.

    Boxes and runs meet in cells of ``lines`` lines by ``cell`` pixels, the first that both touch, so neither a large sheet nor a
    large box is one task's.
    """
    at = lambda v, size: F.floor(v / size)
    span = lambda lo, hi, size: F.explode(F.sequence(at(lo, size), at(hi, size)))
    spread = boxes.where("w > 0 and h > 0").withColumn("_cy", span(c("y"), c("y") + c("h") - 1, lines)).withColumn("_cx", span(c("x"), c("x") + c("w") - 1, cell))
    spread = spread.withColumnsRenamed({"x": "_bx", "y": "_by", "w": "_bw", "h": "_bh"})
    laid = runs.withColumn("_cy", at(c("y"), lines)).withColumn("_cx", span(c("x0"), c("x1") - 1, cell))
    met = laid.join(sized(spread), [*keys, "_cy", "_cx"])
    x0, x1 = F.greatest("x0", "_bx"), F.least(c("x1"), c("_bx") + c("_bw"))
    met = met.where((c("y") >= c("_by")) & (c("y") < c("_by") + c("_bh")) & (x0 < x1) & (at(x0, cell) == c("_cx")))
    return met.withColumns({"x0": x0, "x1": x1}).drop("_cy", "_cx").withColumnsRenamed({"_bx": "bx", "_by": "by", "_bw": "bw", "_bh": "bh"})


def tightened(boxes: DataFrame, runs: DataFrame, keys: list[str], box_id: str) -> DataFrame:
    """Each box around all of the mask within it, whosever it is; unchanged where there is none."""
    met = within(runs.select(*keys, "y", "x0", "x1"), boxes.select(*keys, box_id, "x", "y", "w", "h"), keys)
    tight = met.groupBy(*keys, box_id).agg(F.min("x0").alias("_tx"), F.min("y").alias("_ty"), F.max("x1").alias("_tx2"), F.max("y").alias("_ty2"))
    out = boxes.join(tight, [*keys, box_id], "left")
    return out.withColumns({"x": F.coalesce("_tx", "x"), "y": F.coalesce("_ty", "y"), "w": F.coalesce(c("_tx2") - c("_tx"), "w"), "h": F.coalesce(c("_ty2") - c("_ty") + 1, "h")}).drop("_tx", "_ty", "_tx2", "_ty2")


def crop_background(mask: DataFrame, boxes: DataFrame, keys: list[str], box_id: str, *, lines: int = LINES) -> DataFrame:
    """keys, box_id, y, x0, x1 (from the box's corner), outside: the runs of each box's background, and whether they reach its frame.

    Background is united over four neighbours; what touches the frame is outside, the rest are holes. A crop of any size is dealt
    over pieces. A box's columns are keys, box_id, x, y, w, h.
    """
    own = [*keys, box_id]
    part = within(mask.select(*keys, "y", "x0", "x1"), boxes.select(*own, "x", "y", "w", "h"), keys)
    local = part.select(*own, (c("y") - c("by")).alias("y"), (c("x0") - c("bx")).alias("x0"), (c("x1") - c("bx")).alias("x1"))
    sizes = boxes.select(*own, c("w").cast("int").alias("width"), c("h").cast("int").alias("height"))
    ground = worked(local, sizes, own, lambda s: strips.complement(strips.united(s)), lines=lines)
    labels = labelled(ground, own, diagonal=False, lines=lines)
    framed = labels.join(sized(sizes), own).withColumn("_at", (c("y") == 0) | (c("x0") == 0) | (c("y") == c("height") - 1) | (c("x1") == c("width")))
    reach = written(framed.groupBy(*own, "label").agg(F.bool_or("_at").alias("outside")), "reach")
    return labels.join(sized(reach), [*own, "label"]).select(*own, "y", "x0", "x1", "outside", "label")


# ---- points ------------------------------------------------------------------------------------


def of_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points (keys, x, y) as runs of one pixel each, which ``united`` makes one where they touch or repeat."""
    return points.select(*keys, c("y").cast("int").alias("y"), c("x").cast("int").alias("x0"), (c("x") + 1).cast("int").alias("x1"))


def to_points(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x0", c("x1") - 1)).alias("x"), "y")

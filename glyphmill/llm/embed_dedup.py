"""Near-duplicate embeddings: a pigeonhole join over the subspaces of a rotation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import components, heavy, lookup, release, written

_SCALE = 32767.0
_ODD = (np.random.default_rng(97).integers(1, 2**62, 64, dtype=np.int64) * 2 + 1).astype(np.int64)


def usable(col: str) -> F.Column:
    """Whether a vector takes part: not null, not empty, all components finite, not zero."""
    c = F.col(col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def vector_key(col: str) -> F.Column:
    """128-bit key of a usable vector's value (minus zero counts as zero), null for others."""
    return F.when(usable(col), F.md5(F.array_join(F.transform(col, lambda x: (x.cast("double") + F.lit(0.0)).cast("string")), ",")))


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(key, vector, copies, least) of the usable vectors, equal ones as one row."""
    keyed = df.where(usable(vector_col)).select(vector_key(vector_col).alias("key"), F.col(id_col).alias("_id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    return keyed.groupBy("key", "vector").agg(F.count("*").alias("copies"), F.min("_id").alias("least"))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rows_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors of an Arrow list column by length: (row numbers, matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return [(at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def block_edges(dim: int, block: int) -> list[tuple[int, int]]:
    """Subspaces of about ``block`` dimensions each, that cover all."""
    n = max(1, round(dim / block))
    cuts = np.linspace(0, dim, n + 1).round().astype(int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _part(threshold: float, dim: int, s: int, e: int) -> float:
    """How far apart two vectors may be in a subspace, in steps of 1/32767, to count as within its share of the budget:
    the share, and what rounding to steps adds."""
    return math.sqrt((2 - 2 * threshold) * (e - s) / dim) * _SCALE + math.sqrt(e - s) + 0.1


def _units(column: pa.Array, seed: int):
    """(row numbers, rotated unit vectors) by length."""
    for at, x in _rows_of(column):
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
        yield at, ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1], seed)).astype(np.float32)


def _grid(x: np.ndarray, threshold: float, block: int, split: int):
    """For each subspace: its number, edges, and for each vector the cell that it lies in, where in it, and its neighbours' sides and gaps."""
    dim = x.shape[1]
    for j, (s, e) in enumerate(block_edges(dim, block)):
        radius = (_part(threshold, dim, s, e) + math.sqrt(e - s)) / _SCALE + 1e-6
        d = min(split, e - s)
        scaled = x[:, s : s + d].astype(np.float64) / (3 * radius)
        yield j, s, e, d, np.floor(scaled).astype(np.int64), scaled - np.floor(scaled)


def _cell(c: np.ndarray, j: int, dim: int) -> np.ndarray:
    d = np.arange(c.shape[1])
    with np.errstate(over="ignore"):
        return (c * (_ODD[d % len(_ODD)] + d // len(_ODD) * 2)).sum(axis=1) * 1000003 + j * 7919 + dim


def homes(vectors: DataFrame, threshold: float, block: int, seed: int, split: int) -> DataFrame:
    """The cell that each vector lies in, in each subspace."""

    def run(stream):
        for batch in stream:
            for _, x in _units(batch.column(0), seed):
                for j, _, _, _, home, _ in _grid(x, threshold, block, split):
                    yield pa.RecordBatch.from_arrays([pa.array(_cell(home, j, x.shape[1]))], names=["cell"])

    return vectors.select("vector").mapInArrow(run, "cell long")


def cells(vectors: DataFrame, threshold: float, block: int, seed: int, split: int) -> DataFrame:
    """(cell, kind, key, copies, unit, j) of every vector: its own cell in each subspace j (kind 0), and those neighbours
    that its ball reaches (kind 1). unit is the rotated unit vector.

    The squared distance of unit vectors at the threshold is shared out in proportion to the subspaces'
    dimensions: two vectors within it are within some subspace's part. Cells are three radii wide, so
    a ball reaches at most one neighbour along an axis, and corners out of its reach are left out.
    Only ``split`` axes of a subspace are cut: each more makes cells smaller but guests more numerous.
    """

    def run(stream):
        for batch in stream:
            keys, copies = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(2).to_numpy()
            for at, x in _units(batch.column(1), seed):
                packed = np.array([r.tobytes() for r in x], dtype=object)
                for j, _, _, d, home, inside in _grid(x, threshold, block, split):
                    side = np.where(inside < 0.5, -1, 1)
                    gap = np.where(inside < 0.5, inside, 1 - inside) * 3  # in radii, to the nearer neighbour
                    gap = np.where(gap <= 1, gap**2, 9.0)
                    subsets = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(bool)
                    for lo in range(0, len(x), 1024):
                        hi = min(lo + 1024, len(x))
                        row, subset = np.nonzero(gap[lo:hi] @ subsets.T <= 1)
                        c = home[lo:hi][row] + side[lo:hi][row] * subsets[subset]
                        who = at[lo:hi][row]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_cell(c, j, x.shape[1])), pa.array((subset > 0).astype(np.int32)), pa.array(keys[who], pa.binary()), pa.array(copies[who]), pa.array(packed[lo:hi][row], pa.binary()), pa.array(np.full(len(row), j, np.int32))],
                            names=["cell", "kind", "key", "copies", "unit", "j"],
                        )

    return vectors.select("key", "vector", "copies").mapInArrow(run, "cell long, kind int, key binary, copies long, unit binary, j int")


_TILE = 1024
_ODDS = 2e-6  # a distance nearer than this to the threshold's is left to an exact check


class Home:
    """The vectors at home in a cell: how many links each has found here, and which of them hang together."""

    def __init__(self, rows: list[tuple], j: int, threshold: float, block: int):
        self.keys = np.array([r[0] for r in rows], dtype=object)
        self.order = np.array([r[0] for r in rows], dtype="S16")
        self.copies = np.array([r[1] for r in rows], dtype=np.int64)
        self.x = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
        self.q = np.rint(self.x * _SCALE)
        dim = self.x.shape[1]
        edges = block_edges(dim, block)
        self.blocks = [(s, e, _part(threshold, dim, s, e) ** 2) for s, e in edges[: j + 1]]
        self.far = math.sqrt(2 - 2 * threshold)
        self.links = np.zeros(len(rows), dtype=np.int64)
        self.root = np.arange(len(rows))
        # one product of these gives squared distances in the subspace, in single precision
        s, e, most = self.blocks[-1]
        own = (self.q[:, s:e] / _SCALE).astype(np.float32)
        square, one = (own**2).sum(axis=1, keepdims=True), np.ones((len(rows), 1), dtype=np.float32)
        self.left, self.right = np.hstack([-2 * own, square, one]), np.hstack([own, one, square])
        self.rough = np.float32(most / _SCALE**2 + (e - s + 4) * 1e-6)

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T

    def _pairs(self, a: slice, other: Home, b: slice, lesser: str | None):
        """(i, j, unsure) of a tile's pairs that this subspace is the first to bring together and that are within the whole
        budget, or so near to it that they are unsure. ``lesser`` keeps pairs whose row or key is the lesser one.
        Single precision, with room for its error, leaves few pairs to look at; where it leaves many, the whole tile is looked
        at. Steps are whole numbers, so all tiles agree on which subspace is first."""
        rough = self.left[a] @ other.right[b].T <= self.rough
        at = np.flatnonzero(rough)
        if not len(at):
            return None
        if len(at) * 8 > rough.size:
            i, j, d = self._in_tile(a, other, b)
        else:
            step = max(1, (1 << 20) // self.x.shape[1])
            i, j = np.divmod(at, rough.shape[1])
            parts = [self._in_list(i[lo : lo + step] + a.start, other, j[lo : lo + step] + b.start) for lo in range(0, len(at), step)]
            i, j, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        if lesser is not None:
            keep = i < j if lesser == "row" else self.order[i] < other.order[j]
            i, j, d = i[keep], j[keep], d[keep]
        return (i, j, d > self.far - _ODDS) if len(i) else None

    def _in_list(self, i: np.ndarray, other: Home, j: np.ndarray):
        for s, e, most in self.blocks[::-1]:
            within = ((self.q[i, s:e] - other.q[j, s:e]) ** 2).sum(axis=1) <= most
            keep = within if e == self.blocks[-1][1] else ~within
            i, j = i[keep], j[keep]
        d = np.sqrt(((self.x[i] - other.x[j]) ** 2).sum(axis=1))
        keep = d <= self.far + _ODDS
        return i[keep], j[keep], d[keep]

    def _in_tile(self, a: slice, other: Home, b: slice):
        s, e, most = self.blocks[-1]
        near = self._apart(self.q[a, s:e], other.q[b, s:e]) <= most
        d = np.sqrt(np.maximum(self._apart(self.x[a], other.x[b]), 0))
        near &= d <= self.far + _ODDS
        for s, e, most in self.blocks[:-1]:
            if near.any():
                near &= self._apart(self.q[a, s:e], other.q[b, s:e]) > most
        i, j = np.nonzero(near)
        return i + a.start, j + b.start, d[i, j]

    def _hang(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root[:] = root[root]
            if (root == before).all():
                return

    def among(self):
        """Links of those at home with each other; gives unsure pairs."""
        n = len(self.keys)
        for lo in range(0, n, _TILE):
            for at in range(lo, n, _TILE):
                a, b = slice(lo, min(n, lo + _TILE)), slice(at, min(n, at + _TILE))
                if (found := self._pairs(a, self, b, "row" if lo == at else None)) is None:
                    continue
                i, j, unsure = found
                yield from zip(self.keys[i[unsure]], self.keys[j[unsure]], strict=True)
                i, j = i[~unsure], j[~unsure]
                np.add.at(self.links, i, self.copies[j])
                np.add.at(self.links, j, self.copies[i])
                self._hang(i, j)

    def meet(self, other: Home, lesser: bool):
        """Links with those that pass by, which get a link to one of those at home; gives unsure pairs. ``lesser``: pairs count only
        where the lesser key is at home, as the other cell has them too."""
        mate = np.full(len(other.keys), -1)
        for lo in range(0, len(self.keys), _TILE):
            for at in range(0, len(other.keys), _TILE):
                a, b = slice(lo, min(len(self.keys), lo + _TILE)), slice(at, min(len(other.keys), at + _TILE))
                if (found := self._pairs(a, other, b, "key" if lesser else None)) is None:
                    continue
                i, j, unsure = found
                yield from zip(self.keys[i[unsure]], other.keys[j[unsure]], strict=True)
                i, j = i[~unsure], j[~unsure]
                np.add.at(self.links, i, other.copies[j])
                np.add.at(other.links, j, self.copies[i])
                first = np.full(len(other.keys), len(self.keys))
                np.minimum.at(first, j, i)
                mate = np.where(mate < 0, np.where(first < len(self.keys), first, -1), mate)
                self._hang(i, mate[j])
        other.root = mate

    def rows(self, names: np.ndarray):
        """(key, links, mate) of those that have a link; ``names`` are the keys that ``root`` points to."""
        for i in np.flatnonzero(self.links):
            yield self.keys[i], int(self.links[i]), names[self.root[i]]


def links(vectors: DataFrame, threshold: float, *, block: int = 8, seed: int = 5, split: int = 4, per_task: int = 8192) -> DataFrame:
    """(key, links, mate): what each vector of a cell has found there. Its links (copies counted) are summed within the task, and
    mate is one vector that it hangs together with; so rows grow with the vectors in cells, not with
    the pairs. Rows without links name a pair that an exact check must settle.

    A pair counts in the first subspace that brings it together, and there in one cell. Vectors at home in
    a crowded cell are dealt over as many salts as keep ``per_task`` in each; what must meet all of
    them goes to every salt.
    """
    at_home = homes(vectors, threshold, block, seed, split).groupBy("cell").agg(F.count("*").alias("n"))
    # so many that a million cells at most, whose numbers are broadcast, are crowded
    most = max(per_task, -(-(at_home.agg(F.sum("n")).first()[0] or 0) // (1 << 20)))
    crowded = F.broadcast(at_home.where(F.col("n") > most).select("cell", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("salts")))
    dealt = cells(vectors, threshold, block, seed, split).join(crowded, "cell", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("salt", F.explode(F.when(F.col("kind") == 1, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.sequence("own", F.col("salts") - 1))))
    dealt = dealt.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("salt") != F.col("own")), 2).otherwise(F.col("kind"))).withColumn("size", F.octet_length("unit"))
    dealt = dealt.select("cell", "salt", "j", "size", "kind", "key", "copies", "unit").repartition("cell", "salt").sortWithinPartitions("cell", "salt", "j", "size", "kind")

    def run(stream):
        # of each cell those at home come first and are held; what meets them passes by in runs
        now, held, waiting, passing, kind = None, None, [], [], 0

        def batch_of(rows):
            key, found, mate = zip(*rows, strict=True) if rows else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(list(key), pa.binary()), pa.array(list(found), pa.int64()), pa.array(list(mate), pa.binary())], names=["key", "links", "mate"])

        def settle():
            nonlocal held, passing
            out = []
            if held is None:
                held = Home(waiting, now[2], threshold, block)
                out += [(a, None, b) for a, b in held.among()]
            if passing:
                other = Home(passing, now[2], threshold, block)
                out += [(a, None, b) for a, b in held.meet(other, kind == 1)]
                out += other.rows(held.keys)
                passing = []
            return out

        for batch in stream:
            for cell, salt, j, size, what, key, copies, unit in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (cell, salt, j, size) != now:
                    if waiting:
                        yield batch_of([*settle(), *held.rows(held.keys)])
                    now, held, waiting, passing = (cell, salt, j, size), None, [], []
                if what == 0:
                    waiting.append((key, copies, unit))
                elif waiting:
                    if passing and (what != kind or len(passing) >= 4096):
                        yield batch_of(settle())
                    kind = what
                    passing.append((key, copies, unit))
        if waiting:
            yield batch_of([*settle(), *held.rows(held.keys)])

    return dealt.mapInArrow(run, "key binary, links long, mate binary")


def settled(unsure: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose vectors have a cosine of ``threshold`` or more in double precision, with the copies of each."""
    side = lambda key, x, n: vectors.select(F.col("key").alias(key), F.col("vector").alias(x), F.col("copies").alias(n))
    both = unsure.distinct().join(side("a", "x", "of_a"), "a").join(side("b", "y", "of_b"), "b").select("a", "b", "x", "y", "of_a", "of_b")

    def check(stream):
        for batch in stream:
            for (at, x), (_, y) in zip(_rows_of(batch.column(2)), _rows_of(batch.column(3)), strict=True):
                with np.errstate(all="ignore"):
                    cos = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                    odd = ~np.isfinite(cos)
                    if odd.any():  # squares out of range
                        u, v = x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True), y[odd] / np.abs(y[odd]).max(axis=1, keepdims=True)
                        cos[odd] = (u * v).sum(axis=1) / (np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1))
                yield batch.select(["a", "b", "of_a", "of_b"]).take(pa.array(at[cos >= threshold]))

    return both.mapInArrow(check, "a binary, b binary, of_a long, of_b long")


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = 8, seed: int = 5) -> DataFrame:
    """id, n_links (other rows linked directly), component_id (least id reachable) and kept (id = component_id).

    Equal vectors are one row until the end: copies add to the counts and are never paired. Links are
    counted where vectors meet and no pair becomes a row, but for those within 2e-6 of the threshold's
    distance, which are checked once more on the vectors themselves. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors
    of different lengths. Rows that repeat an id each keep their own row; an empty table gives an empty result;
    further columns aren't read.
    """
    vectors = written(distinct_vectors(df, id_col, vector_col).withColumn("key", F.unhex("key")), "vectors")
    found = written(links(vectors, threshold, block=block, seed=seed), "found")
    exact = written(settled(found.where("links is null").select(F.col("key").alias("a"), F.col("mate").alias("b")), vectors, threshold), "exact")
    edges = found.where("links is not null").select(F.col("key").alias("a"), F.col("mate").alias("b")).union(exact.select("a", "b"))
    more = exact.select(F.col("a").alias("key"), F.col("of_b").alias("links")).union(exact.select(F.col("b").alias("key"), F.col("of_a").alias("links")))
    degree = found.where("links is not null").select("key", "links").union(more).groupBy("key").agg(F.sum("links").alias("others"))
    roots = components(edges)
    groups = vectors.select("key", "copies", "least")
    rooted = groups.join(roots, groups.key == roots.node, "left").select("key", "copies", "least", F.coalesce("root", "key").alias("root"))
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = lookup(rooted, lowest.select("root", "component_id"), ["root"], heavy(lowest, ["root"])).join(degree, "key", "left")
    classes = written(classes.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "classes")
    release(found, exact, rooted)
    rows = df.select(F.col(id_col), F.unhex(vector_key(vector_col)).alias("key"))
    usable_rows = lookup(rows.where("key is not null"), classes, ["key"], heavy(groups, ["key"], "copies"))
    alone = rows.where("key is null").select(id_col, "key", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast(df.schema[id_col].dataType).alias("component_id"))
    component = F.coalesce("component_id", id_col)
    return usable_rows.select(id_col, "key", "n_links", "component_id").unionByName(alone).select(id_col, "n_links", component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))

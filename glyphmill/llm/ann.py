"""Approximate nearest neighbours by inner product: vantage-point trees, one per shard."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import heavy, lookup, release, written
from glyphmill.llm.embed_dedup import usable, vector_key

_SLACK = 1e-7  # of a distance, for rounding


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, norms) of the rows, without overflow on the way."""
    most = np.abs(x).max(axis=1, keepdims=True)
    scaled = x / most
    norm = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / norm, (norm * most)[:, 0]


def chords(cosines: np.ndarray) -> np.ndarray:
    """Distances of unit vectors by their cosines."""
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def beyond(d: np.ndarray, lo, hi, norms: np.ndarray, least, most, factor: float, reach: np.ndarray) -> np.ndarray:
    """Whether nothing of a part can come up to ``reach``, for queries of these norms at distance ``d`` from its vantage point.

    Directions of the part lie between ``lo`` and ``hi`` from the vantage point and its norms between
    ``least`` and ``most``. By the triangle inequality its directions are then a certain distance from
    the query's at least; that distance times ``factor`` bounds the cosine, and so the product.
    """
    apart = np.maximum(np.maximum(lo - d, d - hi) - _SLACK, 0) * factor
    cosine = np.maximum(1 - apart**2 / 2, -1)
    with np.errstate(all="ignore"):
        bound = norms * np.where(cosine > 0, most, least) * cosine
        return bound + 1e-9 * np.abs(bound) < reach


class VantageTree:
    """Vantage-point tree over the directions of x. Each half knows between which distances from the vantage point its
    directions lie, and between which its norms. Norms don't enter the distances, so a long vector widens only
    the bounds of the halves that hold it."""

    def __init__(self, x: np.ndarray, leaf: int, seed: int):
        self.x, self.leaf = x, leaf
        self.unit, self.norms = directions(x)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))
        del self.rng

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return np.sort(rows)
        at = int(self.rng.integers(len(rows)))
        vantage, rows = int(rows[at]), np.delete(rows, at)
        d = chords(self.unit[rows] @ self.unit[vantage])
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return vantage, [(d[part].min(), d[part].max(), self.norms[rows[part]].min(), self.norms[rows[part]].max(), self._build(rows[part])) for part in (near, far) if len(part)]


class Search:
    """Best k by inner product for a block of queries. ``factor`` relaxes the triangle inequality: a half is passed
    over if its least possible distance times the factor leaves no product up to the k-th best; one is exact.
    ``floor`` is what each query has elsewhere already: less is of no use."""

    def __init__(self, tree: VantageTree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None):
        self.tree, self.ids, self.q, self.k, self.factor = tree, ids, queries, k, factor
        self.unit, self.norms = directions(queries)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.best = np.full((len(queries), k), -np.inf)
        self.who = np.full((len(queries), k), -1, dtype=np.int64)
        self.visit(tree.root, np.arange(len(queries)))

    def reach(self, asking: np.ndarray) -> np.ndarray:
        return np.maximum(self.best[asking, -1], self.floor[asking])

    def offer(self, asking: np.ndarray, rows: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            scores = self.q[asking] @ self.tree.x[rows].T
        scores[np.isnan(scores)] = -np.inf  # products of both signs out of a double's range
        better = scores.max(axis=1) >= self.reach(asking) - _SLACK * np.abs(self.reach(asking))
        better |= np.isneginf(self.reach(asking))
        if not better.any():
            return
        asking, scores = asking[better], scores[better]
        all_scores = np.concatenate([self.best[asking], scores], axis=1)
        all_who = np.concatenate([self.who[asking], np.broadcast_to(rows, scores.shape)], axis=1)
        ids = np.where(all_who >= 0, self.ids[all_who], np.iinfo(np.int64).max)
        order = np.lexsort((ids, -all_scores), axis=-1)[:, : self.k]
        self.best[asking] = np.take_along_axis(all_scores, order, axis=1)
        self.who[asking] = np.take_along_axis(all_who, order, axis=1)

    def visit(self, node, asking: np.ndarray) -> None:
        if not len(asking):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                self.offer(asking, node)
            return
        vantage, halves = node
        self.offer(asking, np.array([vantage]))
        d = chords(self.unit[asking] @ self.tree.unit[vantage])
        gaps = [np.maximum(np.maximum(lo - d, d - hi), 0) for lo, hi, *_ in halves]
        first = np.zeros(len(asking), dtype=int) if len(halves) == 1 else (gaps[1] < gaps[0]).astype(int)
        for turn in range(len(halves)):
            for h, (lo, hi, least, most, child) in enumerate(halves):
                mine = (first == h) if turn == 0 else (first != h)
                if mine.any():
                    among = asking[mine]
                    self.visit(child, among[~beyond(d[mine], lo, hi, self.norms[among], least, most, self.factor, self.reach(among))])


def nearest_in_shard(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, *, factor: float, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, row numbers) of each query's k greatest inner products with the rows of x; -1 where there are fewer."""
    search = Search(VantageTree(x, leaf, seed), ids, queries, k, factor)
    return search.best, search.who


# ---- the job -----------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return [(at, flat[starts[at][:, None] + np.arange(n)]) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


def _placed(entries: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds pivot (the number of the nearest pivot in direction, -1 where the length has none), apart (the distance), norm and
    band (the power of four that the norm is near)."""
    shared = entries.sparkSession.sparkContext.broadcast(pivots)

    def run(stream):
        for batch in stream:
            pivot, apart, norms = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for at, x in _matrix(batch.column("vector")):
                unit, norms[at] = directions(x)
                if (among := shared.value.get(x.shape[1])) is not None:
                    cosines = unit @ among.T
                    pivot[at] = cosines.argmax(axis=1)
                    apart[at] = chords(cosines.max(axis=1))
            band = np.floor(np.log2(np.maximum(norms, 1e-320)) / 2 + 0.25).astype(np.int32)
            for name, array in (("pivot", pivot), ("apart", apart), ("norm", norms), ("band", band)):
                batch = batch.append_column(name, pa.array(array))
            yield batch

    schema = entries.select("*").schema
    for name, kind in (("pivot", "integer"), ("apart", "double"), ("norm", "double"), ("band", "integer")):
        schema = schema.add(name, kind)
    return entries.mapInArrow(run, schema)


def _routes(queries: DataFrame, shards: pd.DataFrame, pivots: dict[int, np.ndarray], k: int, factor: float, first: bool) -> DataFrame:
    """Rows (shard, salt, query, vector, floor): where each query is asked. At first at the shard that promises most; then at all
    whose bound comes up to what the first gave (floor), but not again at (was, was_salt)."""
    shared = queries.sparkSession.sparkContext.broadcast((shards, pivots))

    def run(stream):
        shards, pivots = shared.value
        for batch in stream:
            for at, x in _matrix(batch.column("vector")):
                mine = shards[shards["dim"] == x.shape[1]]
                if not len(mine):
                    continue
                unit, norms = directions(x)
                among = pivots.get(x.shape[1])
                pivot, salts = mine["pivot"].to_numpy(), mine["salts"].to_numpy()
                rows = batch.take(pa.array(at))
                for lo in range(0, len(x), 1024):
                    part = slice(lo, lo + 1024)
                    cosines = unit[part] @ among[np.maximum(pivot, 0)].T if among is not None else np.ones((len(unit[part]), len(mine)))
                    some = rows.slice(lo, 1024)
                    if first:
                        with np.errstate(all="ignore"):
                            promise = np.where(cosines > 0, mine["most"].to_numpy(), mine["least"].to_numpy()) * cosines
                        promise = np.where(mine["n"].to_numpy() // salts > 2 * k, promise, promise - 1e300)
                        q, s = np.arange(len(cosines)), promise.argmax(axis=1)
                        salt = np.abs(some.column("hash").to_numpy()) % salts[s]
                        floor = np.full(len(q), -np.inf)
                    else:
                        d = np.where(pivot >= 0, chords(cosines), 0.0)
                        floor = some.column("floor").to_numpy()
                        out = beyond(d, mine["lo"].to_numpy(), mine["hi"].to_numpy(), norms[part][:, None], mine["least"].to_numpy(), mine["most"].to_numpy(), factor, floor[:, None])
                        q, s = np.nonzero(~out)
                        times = salts[s]
                        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        q, s = np.repeat(q, times), np.repeat(s, times)
                        new = (mine["shard"].to_numpy()[s] != some.column("was").to_numpy()[q]) | (salt != some.column("was_salt").to_numpy()[q])
                        q, s, salt, floor = q[new], s[new], salt[new], floor[q[new]]
                    who = some.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([pa.array(mine["shard"].to_numpy()[s].astype(np.int32)), pa.array(salt.astype(np.int32)), who.column("query"), who.column("vector"), pa.array(floor)], names=["shard", "salt", "query", "vector", "floor"])

    return queries.mapInArrow(run, "shard int, salt int, query string, vector array<double>, floor double")


#: Bytes of vectors in a shard or a block of queries at most, however many rows these may have.
MOST_BYTES = 32 << 20


def _rows(dim: int, most: int) -> int:
    """Rows of ``dim`` doubles that a shard or block has at most."""
    return max(64, min(most, MOST_BYTES // (8 * max(1, dim))))


def _answers(trees: DataFrame, asks: DataFrame, k: int, factor: float, id_type: str, query_rows: int) -> DataFrame:
    """(query, shard, salt, score, ids) for what the shards' trees find. A shard asked by more than ``query_rows`` meets them in blocks,
    each with its copy of the tree; only the counts of such shards are broadcast, 65,536 of them at most."""
    counts = asks.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(query_rows, -(-total // 65_536))
    many = F.broadcast(counts.where(F.col("n") > size).select("shard", "salt", F.ceil(F.col("n") / F.lit(size)).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    left = trees.join(many, ["shard", "salt"], "left").select("shard", "salt", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    right = asks.join(many, ["shard", "salt"], "left").select("shard", "salt", "query", "vector", "floor", F.pmod(F.xxhash64(F.lit(1), "query"), blocks).cast("int").alias("block"))

    def answer(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asking):
            tree, least, ids = pickle.loads(held["tree"].iloc[0])
            for lo in range(0, len(asking), 1024):
                some = asking.iloc[lo : lo + 1024]
                q = np.stack(some["vector"].to_numpy())
                search = Search(tree, least, q, min(k + 1, len(least)), factor, some["floor"].to_numpy())
                who, got = search.who, search.who >= 0
                row = np.nonzero(got)[0]
                if not len(row):
                    continue
                with np.errstate(all="ignore"):
                    score = (q[row] * tree.x[who[got]]).sum(axis=1)
                out.append(pd.DataFrame({"query": some["query"].to_numpy()[row], "shard": held["shard"].iloc[0], "salt": held["salt"].iloc[0], "score": score, "ids": pd.Series([ids[i] for i in who[got]], dtype=object)}))
        return pd.concat(out) if out else pd.DataFrame()

    keys = ["shard", "salt", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(answer, f"query string, shard int, salt int, score double, ids array<{id_type}>")


def nearest(df: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 1.0, shard_rows: int = 16384, most_pivots: int = 1024, query_rows: int = 65536, leaf: int = 256, seed: int = 3) -> DataFrame:
    """The k nearest rows of ``df`` to each row of ``queries``: query_id, rank, id, score; a query's own id is left out.

    Equal vectors are one entry of the trees, with the k + 1 least of their ids: more can't be among k
    answers. Entries are dealt over shards by the nearest of up to ``most_pivots`` pivots in direction and by their norm's
    power of four; a shard of more than ``shard_rows`` entries, or of more than ``MOST_BYTES``, is dealt on by a hash. Each shard's tree is built once
    and written. A query first asks the shard that promises most; what it gets is the floor that
    the triangle inequality, relaxed by ``factor``, holds against all other shards, and only those that
    can come up to it are asked. With a factor of one the answers are exact.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
    different lengths don't meet. Ties go to the smaller id (by its own order where ids aren't whole numbers);
    rows that repeat an id are answers of their own; an empty table gives an empty result; further
    columns aren't read. Products beyond a double's range are infinite.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    as_double = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vector")
    rows = df.where(usable(vector_col)).select(vector_key(vector_col).alias("key"), F.col(id_col).alias("id"), as_double)
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(F.col("id").asc_nulls_last()))).where(F.col("n") <= k + 1)
    entries = written(first.groupBy("key").agg(F.first("vector").alias("vector"), F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda r: r["id"]).alias("ids")), "entries")
    asked = written(queries.where(usable(vector_col)).select(F.col(id_col).alias("query_id"), vector_key(vector_col).alias("query"), as_double), "queries")
    n, widest = entries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    asked_rows = _rows(max(widest, asked.agg(F.max(F.size("vector"))).first()[0] or 1), query_rows)
    pivots: dict[int, list] = {}
    for row in entries.select("vector").orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(max(1, min(most_pivots, -(-n // _rows(widest, shard_rows))))).collect():
        pivots.setdefault(len(row.vector), []).append(row.vector)
    pivots = {dim: directions(np.array(x))[0] for dim, x in pivots.items()}
    placed = written(_placed(entries, pivots).withColumn("dim", F.size("vector")), "placed")
    release(entries)
    # a row for each pivot, length and power of four: bounded by the pivots and the range of doubles
    found = placed.groupBy("dim", "pivot", "band").agg(F.count("*").alias("n"), F.min("apart").alias("lo"), F.max("apart").alias("hi"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    shards = found.toPandas().sort_values(["dim", "pivot", "band"]).reset_index(drop=True)
    shards["shard"], shards["salts"] = np.arange(len(shards)), [-(-n // _rows(dim, shard_rows)) for dim, n in zip(shards["dim"], shards["n"], strict=True)]
    shards.loc[shards["pivot"] < 0, "hi"] = 2.0
    numbers = F.broadcast(spark.createDataFrame(shards[["dim", "pivot", "band", "shard", "salts"]].astype(int), "dim int, pivot int, band int, shard int, salts int"))
    dealt = placed.join(numbers, ["dim", "pivot", "band"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        ids = group["ids"].tolist()
        # where ids aren't whole numbers, ties within a tree are left to the order of keys
        least = np.array([int(i[0]) if i[0] is not None and not isinstance(i[0], str) else np.iinfo(np.int64).max for i in ids], dtype=np.int64)
        tree = VantageTree(np.stack(group["vector"].to_numpy()), leaf, seed)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "salt": [group["salt"].iloc[0]], "tree": [pickle.dumps((tree, least, ids), protocol=5)]})

    trees = written(dealt.groupBy("shard", "salt").applyInPandas(build, "shard int, salt int, tree binary"), "trees")
    release(placed)
    per_query = asked.groupBy("query").agg(F.first("vector").alias("vector"), F.count("*").alias("n"))
    distinct = written(per_query.withColumn("hash", F.xxhash64("query")), "asked")
    at_first = written(_answers(trees, _routes(distinct, shards, pivots, k, factor, True), k, factor, id_type, asked_rows), "first")
    floors = at_first.groupBy("query").agg(F.max("shard").alias("was"), F.max("salt").alias("was_salt"), F.min("score").alias("worst"), F.count("*").alias("got"))
    floors = floors.withColumn("floor", F.when(F.col("got") > k, F.col("worst")).otherwise(F.lit(float("-inf"))))
    again = distinct.join(floors.select("query", "was", "was_salt", "floor"), "query")
    at_last = _answers(trees, _routes(again, shards, pivots, k, factor, False), k, factor, id_type, asked_rows)
    with_ids = at_first.unionByName(at_last).select("query", "score", F.explode("ids").alias("id"))
    by_query = W.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = with_ids.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("n", "id", "score")).alias("found"))
    answers = lookup(asked.select("query_id", "query"), top, ["query"], heavy(distinct, ["query"])).select("query_id", F.filter("found", lambda f: ~f["id"].eqNullSafe(F.col("query_id"))).alias("found"))
    ranked = answers.select("query_id", F.posexplode(F.slice(F.array_sort("found"), 1, k)).alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias(id_col), F.col("f.score").alias("score"))

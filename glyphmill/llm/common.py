"""What the operators of this folder share: tables, Arrow passes, lineage cuts, joins of hot keys, linked groups."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from glyphmill.plans.session import release, ship_package, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


PARTS = 1024


def heavy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """The keys that hold more than one row in ``PARTS``, so ``PARTS`` of them at most; None if there are none.
    ``counts`` has a row for each key."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    if not total or most * PARTS <= total:
        return None
    return counts.where(F.col(n) * F.lit(PARTS) > F.lit(total)).select(*keys)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner", pieces: int = 64, merge: bool = False) -> DataFrame:
    """``rows`` joined to ``table``, which has one row for each of ``keys``. Rows of a hot key are dealt over ``pieces``,
    each of which meets its own copy of the table's row. Only the hot keys, of which ``heavy`` bounds the number, are broadcast;
    Spark may broadcast a table that it takes to be small, unless ``merge`` is set, as for texts, whose files are much smaller than their rows."""
    joined = (lambda df: df.hint("merge")) if merge else (lambda df: df)
    if hot is None:
        return rows.join(joined(table), keys, how)
    marked = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    every = F.sequence(F.lit(0), F.lit(pieces - 1))
    left = rows.join(marked, keys, "left").withColumn("_piece", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(pieces)).cast("int")).otherwise(F.lit(0))).drop("_hot")
    right = table.join(marked, keys, "left").withColumn("_piece", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(joined(right), [*keys, "_piece"], how).drop("_piece")


#: Bits of a filter at most: 8 MB, whatever the input.
MOST_BITS = 1 << 26


def bits_for(n: int, each: int = 16, most: int = MOST_BITS) -> int:
    """Size of a filter over ``n`` hashes: ``each`` bits for one, between 2**16 and ``most``."""
    return min(most, max(1 << 16, 1 << (max(1, n * each) - 1).bit_length()))


def filter_bits(hashes: DataFrame, col: str, bits: int) -> np.ndarray:
    """A bitmap (packed) over the hashes' low bits. What isn't in it surely isn't among them; the rest needs an exact look."""
    bit = F.col(col).bitwiseAND(F.lit(bits - 1))
    words = hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toPandas()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[words["w"]] = words["b"]
    return out.view(np.uint8)


def in_filter(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes.view(np.uint64) & np.uint64(len(packed) * 8 - 1)
    return (packed[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def keep_rows(df: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` that ``decided`` keeps, all columns as they were; of rows with one id and one text, one stays.

    ``decided`` has (id, hash, n, kept) for each id and text hash (``text_hash``), n being their number of rows. Two filters of
    fixed size, over what stays and what goes, settle nearly all rows where they lie, so that their
    texts aren't shuffled; rows that both filters name are joined exactly. More rows than the filters
    are made for only send more through that join.
    """
    spark = df.sparkSession
    ship_package(spark)
    of = F.xxhash64("id", "hash")
    hashed = decided.select(of.alias("h"), "kept", "n")
    bits = bits_for(hashed.count())
    stay = filter_bits(hashed.where("kept"), "h", bits)
    # a row that repeats is settled by the join, so that only one stays
    go = filter_bits(hashed.where("not kept or n > 1"), "h", bits)
    shared = spark.sparkContext.broadcast((stay, go))
    h, both = unused(df, "_h"), unused(df, "_both")
    marked = df.withColumn(h, F.xxhash64(F.col(id_col), text_hash(text_col)))
    schema = StructType([*df.schema.fields, StructField(both, BooleanType())])

    def run(stream):
        stay, go = shared.value
        for batch in stream:
            hashes = batch.column(batch.num_columns - 1).to_numpy()
            yes = in_filter(stay, hashes)
            out = batch.select(list(range(batch.num_columns - 1))).append_column(both, pa.array(in_filter(go, hashes)))
            yield out.filter(pa.array(yes))

    told = marked.mapInArrow(run, schema)
    clear = told.where(~F.col(both)).drop(both)
    wanted = decided.where("kept").select(F.col("id").alias("_kept_id"), F.col("hash").alias("_kept_hash"))
    own, digest = unused(df, "_own"), unused(df, "_digest")
    unsure = told.where(F.col(both)).drop(both).withColumns({own: F.col(id_col), digest: text_hash(text_col)})
    wanted = wanted.toDF(unused(unsure, "_kept_id"), unused(unsure, "_kept_hash"))
    same = F.col(own).eqNullSafe(F.col(wanted.columns[0])) & (F.col(digest) == F.col(wanted.columns[1]))
    exact = unsure.join(wanted, same, "left_semi").dropDuplicates([own, digest]).drop(own, digest)
    return clear.unionByName(exact)


def text_hash(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def batches(stream: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes``; a single longer row stays whole."""
    for batch in stream:
        rows = batch.num_rows
        step = max(1, min(rows, int(rows * most_bytes / max(1, batch.nbytes))))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def per_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    start: Callable[[], Callable[[str], tuple]],
    fields: str,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per text: the id, the columns of ``keep``, and what the worker made of the whole text.

    ``start`` runs once a task and returns the function of a text; a null text counts as empty.
    ``fields`` is the DDL of that function's results. Only the named columns leave the scan, so
    further columns of ``df``, whatever their names, can't clash.
    """
    spark = df.sparkSession
    ship_package(spark)
    kept = df.select(F.col(id_col), *[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = kept.drop("_text").schema
    added = spark.createDataFrame([], fields).schema
    for field in added:
        schema = schema.add(field.name, field.dataType, True)
    arrow_types = [pa.from_numpy_dtype(_NUMPY[f.dataType.typeName()]) if f.dataType.typeName() in _NUMPY else _ARROW[f.dataType.simpleString()] for f in added]
    names = schema.names

    def run(stream):
        work = start()
        gc.disable()  # caches hold hundreds of thousands of entries and no cycles: collecting would only walk them
        try:
            for batch in batches(stream):
                made = [work(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
                columns = zip(*made, strict=True) if made else [[] for _ in arrow_types]
                arrays = [pa.array(list(c), type=t) for c, t in zip(columns, arrow_types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)
        finally:
            gc.enable()

    return kept.mapInArrow(run, schema)


_NUMPY = {"long": "int64", "integer": "int32", "double": "float64"}
_ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()),
}


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Connected components of the edges (a, b), as (node, root): root is the least node reachable.

    Alternates two steps until no edge changes: every node hands its greater neighbours to the least
    node it knows (large star), then its lesser ones (small star). Edges never multiply, and rounds grow
    with the logarithm of the longest chain. The least neighbour comes from a partial aggregate, and
    the edges of a hub are dealt over many tasks when they meet it (``lookup``). Edges are first
    contracted where they lie, a stretch at a time. Lineage is cut by a written table each step.
    """
    ship_package(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.mapInArrow(_contract, edges.schema).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least_known(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        large = written(large.distinct(), "edges")
        release(edges)
        # every edge now goes from a node to a lesser one
        small = _least_known(large).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "edges")
        release(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))


def _contract(stream, most: int = 200_000):
    """Stretches of edges (a, b), each as edges from every node to the least one linked to it within the stretch."""

    def star(held):
        joined = pa.Table.from_batches(held)
        nodes, at = np.unique(np.concatenate([np.array(c.to_pylist(), dtype=object) for c in joined.columns]), return_inverse=True)
        a, b = at[: joined.num_rows], at[joined.num_rows :]
        root = np.arange(len(nodes))
        while True:
            low, before = np.minimum(root[a], root[b]), root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        own = np.flatnonzero(root != np.arange(len(nodes)))
        kinds = joined.schema.types
        return pa.RecordBatch.from_arrays([pa.array(nodes[own].tolist(), kinds[0]), pa.array(nodes[root[own]].tolist(), kinds[1])], names=["a", "b"])

    held, size = [], 0
    for batch in stream:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield star(held)
            held, size = [], 0
    if size:
        yield star(held)


def _least_known(edges: DataFrame) -> DataFrame:
    """Adds m, the least b of each a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return lookup(edges, least.select("a", "m"), ["a"], heavy(least, ["a"]))

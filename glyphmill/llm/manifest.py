"""A Merkle manifest of a table: a tree of digests for each group, kept level by level as Parquet, and every row's proof."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import release, written

c = F.col

#: Nodes that one parent has at most (fixed by the query's contract).
WIDTH = 8

#: Joined by broadcast: tables of up to so many rows (counted first).
MOST_BROADCAST = 100_000


def digest(parts: list[Column]) -> Column:
    """H: sha256 of the inputs one after another, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(df: DataFrame, *, id_col: str, group_col: str, fields: list[str], altered: dict[str, Column], where: Column) -> DataFrame:
    """id, group, leaf, tampered: the digests of each row's fields, and of the altered fields where ``where`` holds (else null).

    One pass over the table, and only digests leave it. The group is its name behind an equals sign; that of null is
    empty and comes first, in order of bytes.
    """
    leaf = digest([field(c(n)) for n in fields])
    tampered = F.when(where, digest([field(altered.get(n, c(n))) for n in fields]))
    group = F.coalesce(F.concat(F.lit("="), c(group_col).cast("string")), F.lit(""))
    return df.select(c(id_col).alias("id"), group.alias("group"), leaf.alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, group: str, order: list[Column], what: str) -> DataFrame:
    """Adds pos (from 0, in the group's order) and size (the group's rows); written, in sorted runs.

    A range partitioning deals the order over tasks, a third of the rows in one group as well as any others, and each task writes one
    sorted run. The rows of each group in each run are counted, these counts are added up run by run, and a place is the
    run's offset plus the place within it. The running sum is over a row for each run and group.
    """
    by = [c(group), *order]
    run = F.shiftright("_at", 33)
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = written(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{what}-runs")
    starts = runs.groupBy(group, run.alias("_run")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = W.partitionBy(group).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    offsets = starts.select(group, "_run", (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - c("_first")).alias("_off"), F.sum("_n").over(W.partitionBy(group)).alias("size"))
    offsets = written(offsets, f"{what}-offsets")
    few = offsets.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return runs.withColumn("_run", run).join(F.broadcast(offsets) if few else offsets.hint("shuffle_hash"), [group, "_run"]).withColumn("pos", c("_at") + c("_off")).drop("_run", "_at", "_off")


def _next(size: Column) -> Column:
    return F.ceil(size / WIDTH).cast("long")


def grow(nodes: DataFrame, group: str, height: int, what: str) -> list[DataFrame]:
    """The node store: level by level the runs of siblings, as tables (group, run, size, members, node) sorted by coordinate.

    ``nodes`` has group, pos, size, digest and maybe more, which go along in the members. Each level reads the one below once, from
    its Parquet files: nodes of a run lie side by side there, so most runs are whole before the shuffle. A group is done when one node remains.
    """
    levels = []
    for level in range(height):
        own = F.struct("pos", "digest", *[n for n in nodes.columns if n not in (group, "pos", "size", "digest")])
        gathered = nodes.where("size > 1").groupBy(group, F.floor(c("pos") / WIDTH).alias("run")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(own)).alias("members"))
        joined = F.array_join(F.transform("members", lambda m: m["digest"]), "")
        runs = gathered.withColumn("node", digest([joined])).sortWithinPartitions(group, "run")
        levels.append(written(runs, f"{what}-level-{level}"))
        nodes = levels[-1].select(group, c("run").alias("pos"), _next(c("size")).alias("size"), c("node").alias("digest"))
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame], group: str) -> DataFrame:
    """group, top: what remains of each group."""
    alone = nodes.where("size = 1").select(group, c("digest").alias("top"))
    for level in levels:
        alone = alone.unionByName(level.where(c("size") <= WIDTH).select(group, c("node").alias("top")))
    return alone


SIDES = "array<struct<left:string,right:string>>"


def _beside(members: Column, i: Column) -> Column:
    """The digests left and right of the i-th member, each joined."""
    part = lambda test: F.array_join(F.transform(F.filter(members, test), lambda m: m["digest"]), "")
    return F.struct(part(lambda m: m["pos"] < i).alias("left"), part(lambda m: m["pos"] > i).alias("right"))


def proofs(levels: list[DataFrame], group: str, above: DataFrame) -> DataFrame:
    """Members of the lowest level with their path: what lies left and right of the node on each level, from below.

    ``above`` has group and path (of the group's top) and maybe more, which goes along. From the highest level down, runs meet
    the path of their own node by coordinate in merge joins. Runs of the lowest level are an eighth of the leaves, and
    all higher levels together a seventh of that. Groups of one leaf have no level and aren't in the result.
    """
    more = [n for n in above.columns if n not in (group, "path")]
    over = None
    for level in reversed(levels):
        first = level.where(c("size") <= WIDTH).join(above, group)
        runs = first if over is None else first.unionByName(level.where(c("size") > WIDTH).join(over.drop("m").hint("merge"), [group, "run"]))
        each = runs.select(group, "members", "path", *more, F.explode("members").alias("m"))
        path = F.concat(F.array(_beside(c("members"), c("m.pos"))), c("path"))
        over = each.select(group, c("m.pos").alias("run"), "m", path.alias("path"), *more)
    return over.select(group, "m.*", "path", *more)


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and what lies beside its way up give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]).cast("binary"), 256))


def _height(size: int) -> int:
    height = 0
    while size > 1:
        size, height = math.ceil(size / WIDTH), height + 1
    return height


def merkle(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of rows (id, group, leaf, tampered).

    A group's leaves ascend by id (null first, equal ids by digest, so repeated rows lie side by side); every ``WIDTH`` nodes
    become one until one remains, the subroot. Subroots, in order of the groups, give the root in the same way. An empty table
    gives an empty result.
    """
    nodes = placed(rows, "group", [c("id").asc_nulls_first(), c("leaf")], "leaves").withColumnRenamed("leaf", "digest")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels = grow(nodes, "group", _height(largest), "leaves")
    ends = written(tops(nodes, levels, "group"), "subroots")
    # the groups are leaves of one more tree
    lone = placed(ends.select(F.lit("").alias("all"), "group", c("top").alias("digest")), "all", [c("group")], "groups")
    groups = lone.agg(F.max("size")).first()[0] or 0
    upper = grow(lone, "all", _height(groups), "groups")
    root = tops(lone, upper, "all").first()
    root = root["top"] if root else None
    empty = F.array().cast(SIDES)
    if upper:
        ways = proofs(upper, "all", upper[0].select("all").distinct().select("all", empty.alias("path")))
    else:
        ways = lone.select("group", "digest", empty.alias("path"))
    ways = written(ways.select("group", "path", c("digest").alias("subroot")), "ways")
    alone = nodes.where("size = 1").join(ways, "group").select("id", "digest", "tampered", "path", "subroot")
    told = proofs(levels, "group", ways).select(*alone.columns).unionByName(alone) if levels else alone
    end = folded(F.coalesce("tampered", "digest"), c("path"))
    out = told.select("id", c("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings(c("path")).cast("binary"), 256).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", c("folded_root") == c("root"))


def verify_documents(df: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tamper_one_in: int = 3) -> DataFrame:
    """The manifest of whole documents, and what a tampered copy of it would fold to.

    Tampering lower-cases A-Z of the text where ``tamper_one_in`` divides the CRC-32 of the id. A null is a dash in the digest and differs from
    an empty text; a row with a null id isn't tampered with; texts of any length are hashed whole; repeated rows are leaves each;
    further columns aren't read.
    """
    lower = F.translate(c(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    where = F.crc32(c(id_col).cast("string").cast("binary")) % tamper_one_in == 0
    rows = leaves(df, id_col=id_col, group_col=group_col, fields=list(fields), altered={text_col: lower}, where=where)
    return merkle(rows).withColumnRenamed("id", id_col)

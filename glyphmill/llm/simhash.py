"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import components, heavy, keep_rows, lookup, per_text, text_hash, written

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def fingerprint(text: str, words: int = 3) -> int:
    """64-bit SimHash (as a signed integer) of the text's word shingles, repeats included."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and fp (long) of every whole text; a null text is empty and has fingerprint zero."""
    return per_text(df, id_col, text_col, lambda: lambda text: (fingerprint(text, words),), "fp long")


def _ball(value: Column, bits: int) -> Column:
    """The value and each value that has one more bit set: half of the Hamming ball of radius one. Of two
    values one bit apart, exactly one finds the other this way."""
    raised = F.filter(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))), lambda v: v != value)
    return F.concat(F.array(value), raised)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints ``fp`` that differ in one or two bits.

    A fingerprint has two 32-bit segments, each of two halves. Of two differing bits, either a segment
    holds at most one, so that its ball of radius one meets the other's table entry and at least one
    half of the other segment is equal or one bit off; or one segment holds both and the other is
    equal. Each table entry is a segment with one half of the other: 48 bits, so that buckets stay
    small even among thousands of near copies. The complete distance is checked within the join.
    """
    low32 = F.lit((1 << 32) - 1)
    hi, lo = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low32)
    halves = distinct.select("fp", hi.alias("hi"), lo.alias("lo")).select(
        "fp", "hi", "lo",
        *[F.shiftright(s, 16).alias(f"{s}0") for s in ("hi", "lo")],
        *[F.col(s).bitwiseAND(F.lit(0xFFFF)).alias(f"{s}1") for s in ("hi", "lo")],
    )
    key = lambda segment, half, tag: F.shiftleft(segment, 18).bitwiseOR(F.shiftleft(half, 2)).bitwiseOR(F.lit(tag))
    c = F.col
    table = halves.select(F.col("fp").alias("b"), F.explode(F.array(key(c("hi"), c("lo0"), 0), key(c("hi"), c("lo1"), 1), key(c("lo"), c("hi0"), 2), key(c("lo"), c("hi1"), 3))).alias("key"))
    hi_ball = _ball(c("hi"), 32)
    probes = halves.select(
        F.col("fp").alias("a"),
        F.explode(
            F.concat(
                F.transform(hi_ball, lambda s: key(s, c("lo0"), 0)),
                F.transform(hi_ball, lambda s: key(s, c("lo1"), 1)),
                F.transform(F.slice(_ball(c("lo0"), 16), 2, 16), lambda h: key(c("hi"), h, 0)),
                F.transform(_ball(c("hi0"), 16), lambda h: key(c("lo"), h, 2)),
                F.array(key(c("lo"), c("hi1"), 3)),
            )
        ).alias("key"),
    )
    found = probes.join(table, "key").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, the least id reachable over links of two bits or fewer.

    Texts with one fingerprint are collapsed before anything is joined, so copies cost nothing further;
    joins and components then run on distinct fingerprints. Null and empty texts share fingerprint
    zero and are linked. Rows with a repeated id each keep their own row; a component whose ids are
    all null has a null component_id; an empty table gives an empty result. Texts of any length are read
    whole, in linear time; further columns of ``df`` aren't read.
    """
    marked = written(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    groups = marked.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count("*").alias("n"))
    classes = _classes(groups).withColumnRenamed("_of_all", "component_id")
    rows = lookup(marked, classes, ["fp"], heavy(groups, ["fp"]))
    return rows.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(groups: DataFrame) -> DataFrame:
    """fp and _of_all, the least _least of all linked fingerprints. ``groups`` has one row for each fp."""
    roots = components(links(groups.select("fp")))
    rooted = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    rooted = written(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("_least").alias("_of_all"), F.count("*").alias("n"))
    return lookup(rooted.select("fp", "root"), lowest.select("root", "_of_all"), ["root"], heavy(lowest, ["root"])).select("fp", "_of_all")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of ``df`` for each near-duplicate component: of its least id (a null one comes last), and of several
    texts with that id the one of the least hash.

    A row is known by its id and the hash of its text, so neither null ids nor ids that stand on different
    texts drag a row of another component along. Equal texts are in one component, hence a kept pair
    names rows of that component only; of rows that repeat the pair, one stays. Ids and hashes are
    joined and shuffled; texts stay where they lie (``keep_rows``). Null and empty texts are one component; an empty
    table gives an empty result; further columns go along whatever their names.
    """
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash(text_col).alias("hash"))
    marked = fingerprints(df.select(row.alias("_row"), F.col(text_col).alias("_text")), id_col="_row", text_col="_text", words=words)
    counted = written(marked.groupBy("fp", "_row").agg(F.count("*").alias("n")), "fingerprints")
    groups = counted.groupBy("fp").agg(F.min("_row").alias("_least"), F.count("*").alias("n"))
    told = lookup(counted, _classes(groups), ["fp"], heavy(groups, ["fp"]))
    decided = written(told.select("_row.id", "_row.hash", "n", (F.col("_row") == F.col("_of_all")).alias("kept")), "decided")
    return keep_rows(df, decided, id_col, text_col)

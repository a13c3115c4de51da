"""Mixing sources to target weights: budgets flow down a domain-language-source tree, documents follow.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphmill.llm.common import heavy, lookup, written

LEVELS = ("domain", "lang", "source")
#: Leaves, of some tens of bytes each, up to which the plan is broadcast; beyond, rows meet it in a salted join.
MOST_BROADCAST = 100_000
#: Digits of a document's place, and values of each: a leaf's running total is found digit by digit.
DIGITS, BASE = 4, 64


def _weight(level: str, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, weight in weights.items():
        out = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(out)
    return out


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Shares each parent's ``budget`` among its rows (name, weight, capacity) in proportion to weight, with
    what a full child can't take going to its siblings. Adds ``share``.

    In order of capacity over weight, a child is full if what its siblings before it can hold, and its
    own level for all from it on, stays within the budget; the first that isn't sets the level of the rest.
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    ordered = by.orderBy(F.col("fill").asc_nulls_last(), "name")
    filled = children.withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    before = F.coalesce(F.sum("capacity").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing))
    filled = filled.withColumns({"before": before, "rest": rest})
    full = F.coalesce(F.col("fill") * F.col("rest") + F.col("before") <= F.col("budget"), F.lit(False))
    filled = filled.withColumn("full", full)
    level = F.max(F.when(~F.col("full") & (F.col("rest") > 0), (F.col("budget") - F.col("before")) / F.col("rest"))).over(by)
    share = F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0)))
    return filled.withColumn("share", share).drop("fill", "before", "rest", "full")


def leaf_budgets(leaves: DataFrame, *, budget: float, weights: dict[str, dict[str, float]], default: float, max_epochs: int) -> DataFrame:
    """domain, lang, source, n_tokens -> adds leaf_budget, the whole tokens that the leaf gives.

    ``budget`` is a fraction of all tokens. A subtree can hold ``max_epochs`` times its tokens; a
    shortage stays among siblings as long as they have room, and only then reaches the level above.
    """
    of = {level: _weight(level, weights.get(level, {}), default) for level in LEVELS}
    total = leaves.agg((F.sum("n_tokens") * F.lit(float(budget))).alias("budget"))
    # what has no weight can take nothing, so neither it nor what is above it has room for it
    room = lambda level: F.sum(F.when(of[level] > 0, F.col("capacity")).otherwise(F.lit(0))).alias("capacity")
    leaves = leaves.withColumn("capacity", F.col("n_tokens") * F.lit(max_epochs))
    langs = leaves.groupBy("domain", "lang").agg(room("source"))
    domains = langs.groupBy("domain").agg(room("lang"))
    top = share_out(domains.crossJoin(F.broadcast(total)).withColumns({"name": F.col("domain"), "weight": of["domain"]}), [])
    langs = langs.join(top.select("domain", F.col("share").alias("budget")), "domain")
    middle = share_out(langs.withColumns({"name": F.col("lang"), "weight": of["lang"]}), ["domain"])
    bottom = leaves.join(middle.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    bottom = share_out(bottom.withColumns({"name": F.col("source"), "weight": of["source"]}), ["domain", "lang"])
    return bottom.select(*LEVELS, "n_tokens", F.floor(F.col("share") + F.lit(1e-6)).alias("leaf_budget"))


def _prefix_ends(placed: DataFrame) -> DataFrame:
    """Where each leaf's budget ends: domain, lang, source, end (the place's digits as one number) and before (tokens of the
    places below it); no row for a leaf that its budget covers. ``placed`` has the leaf, rest, place and n_tokens.

    Totals of places are taken once, and then their sums by the first digit, by the second within the digit
    where the budget ends, and so on: ``BASE`` sums of a leaf at most meet in one task.
    """
    totals = written(placed.groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")), "places")
    ends = None
    for digit in range(DIGITS):
        width = BASE ** (DIGITS - 1 - digit)
        part = F.floor(F.col("place") / F.lit(width)).cast("long")
        within = totals.withColumn("part", part)
        if ends is None:
            within = within.withColumn("before", F.lit(0).cast("long"))
        else:
            within = within.withColumn("above", F.floor(F.col("part") / F.lit(BASE)).cast("long")).join(ends.select(*LEVELS, F.col("part").alias("above"), "before"), [*LEVELS, "above"])
        sums = within.groupBy(*LEVELS, "part").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(W.partitionBy(*LEVELS).orderBy("part"))
        crossed = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("part", (F.col("upto") - F.col("n")).alias("before"))).alias("end"))
        ends = written(crossed.select(*LEVELS, F.col("end.part").alias("part"), F.col("end.before").alias("before")), "ends")
    return ends.withColumnRenamed("part", "end")


def mix(
    docs: DataFrame,
    *,
    domain: Column,
    weights: dict[str, dict[str, float]],
    budget: float = 0.8,
    max_epochs: int = 2,
    default: float = 1.0,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tokens: Column | None = None,
) -> DataFrame:
    """How often each document is used: id, domain, lang, source, n_tokens, times.

    ``tokens`` gives a document's number of tokens; without it four bytes count as one. A leaf gives its
    whole epochs, then a prefix of one more: documents in the order of a seeded hash of that epoch and the
    id, as long as their running total stays within the rest of the leaf's budget. Running totals are taken
    digit by digit over 16 million ranges of the hash and over documents only in the one range where the
    budget ends, and rows of a hot leaf are dealt over many tasks where they meet its plan, so a leaf with a third of
    all rows never meets in one task. Null languages and sources form the leaf "unknown"; null and
    empty texts have 0 tokens, and long ones count whole; repeated rows are placed together; an empty table gives an
    empty result; further columns aren't read.
    """
    out = _times(docs, [id_col], domain, weights, budget, max_epochs, default, seed, id_col, text_col, lang_col, source_col, tokens)
    return out.select(F.col(f"_row.{id_col}").alias(id_col), *[F.col(c).alias(f"_{c}" if c == id_col else c) for c in LEVELS], "n_tokens", "times")


def _times(docs, kept, domain, weights, budget, max_epochs, default, seed, id_col, text_col, lang_col, source_col, tokens) -> DataFrame:
    """_row (the columns of ``kept``), domain, lang, source, n_tokens, times."""
    if tokens is None:
        tokens = F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / F.lit(4.0))
    rows = docs.select(
        F.struct(*[F.col(c) for c in kept]).alias("_row"),
        F.col(id_col).cast("string").alias("_id"),
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce(F.col(lang_col), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col(source_col), F.lit("unknown")).alias("source"),
        F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"))
    leaves = written(leaves, "leaves")
    small = leaves.count() <= MOST_BROADCAST
    hot = None if small else heavy(leaves, list(LEVELS))
    plan = leaf_budgets(leaves.drop("n"), budget=budget, weights=weights, default=default, max_epochs=max_epochs)
    whole = F.when(F.col("n_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("n_tokens"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", whole.cast("int")).select(*LEVELS, "epochs", (F.col("leaf_budget") - F.col("epochs") * F.col("n_tokens")).alias("rest"))
    # the tree is planned once, not once for each of its uses below
    plan = written(plan, "plan")
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce("_id", F.lit(""))))
    # four digits of base 64 are six hexadecimal ones
    place = F.conv(F.substring("order", 1, 6), 16, 10).cast("long")
    on_plan = lambda df: lookup(df, F.broadcast(plan) if small else plan, list(LEVELS), hot).withColumn("order", hashed).withColumn("place", place)
    ends = _prefix_ends(on_plan(rows.select("_id", *LEVELS, "n_tokens")))
    plan = written(plan.join(ends, list(LEVELS), "left"), "plan")
    placed = on_plan(rows)
    clear = placed.where(F.col("end").isNull() | (F.col("place") != F.col("end")))
    clear = clear.withColumn("more", F.when(F.col("end").isNull() | (F.col("place") < F.col("end")), 1).otherwise(0))
    running = F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("order"))
    edge = placed.where(F.col("place") == F.col("end")).withColumn("more", F.when(F.col("before") + running <= F.col("rest"), 1).otherwise(0))
    out = ["_row", *LEVELS, "n_tokens", (F.col("epochs") + F.col("more")).cast("int").alias("times")]
    return clear.select(*out).unionByName(edge.select(*out))


def mixed_documents(docs: DataFrame, *, domain: Column, weights: dict[str, dict[str, float]], budget: float = 0.8, max_epochs: int = 2, default: float = 1.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix uses it (a row for each epoch), all columns as they were, whatever
    their names. Nulls, empty texts, repeated rows and empty tables as for ``mix``."""
    used = _times(docs, docs.columns, domain, weights, budget, max_epochs, default, seed, id_col, text_col, lang_col, source_col, tokens).where("times > 0")
    return used.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")

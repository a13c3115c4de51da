"""Quality rules over whole documents: counts within a text, and lines that too many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import heavy, lookup, written

c = F.col

#: Fixed by the query's contract: what parts words, and what counts as a symbol.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"

#: Words of a window, and the rules that a document fails by itself.
WINDOW, MIN_WORDS, MOST_REPEATED = 5, 10, 20

#: Frequent lines that are broadcast at most (counted first).
MOST_BROADCAST = 100_000


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read many times. A generator is between, else the optimizer would put each one's
    expression into the lambda functions that read it, to be evaluated once an element."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def _following(array: Column) -> Column:
    """The array without its first element."""
    return F.slice(array, 2, 1 << 30)


def normalised(line: Column) -> Column:
    """A line as it is counted: in lower case, digits alike, runs of white space one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[1-9]", "0"), SPACE, " "))


def measured(df: DataFrame, *, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """For every row: id, host, the text's hash, the counts of its whole text, and lines (hash, chars), one for each distinct normalised line.

    All counts come from arrays of the text's own words and lines, in one pass, without a shuffle.
    """
    text = F.coalesce(c(text_col), F.lit(""))
    host = F.coalesce(F.concat(F.lit("="), c(host_col).cast("string")), F.lit(""))
    read = df.select(c(id_col).alias("id"), host.alias("host"), text.alias("text"))
    in_words = lambda words: F.char_length(F.array_join(words, "")).cast("long")
    of = lambda t: F.array_remove(F.split(t, SPACE), "")
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    split = _held(read, words=of(F.col("text")), lines=F.filter(F.split("text", "\n"), has_word))
    places = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(1), F.size("words") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    each = _held(split, each=F.transform("words", lambda w: F.xxhash64(w)))
    hashed = _held(each, windows=F.transform(places, lambda i: F.xxhash64(F.slice("each", i, WINDOW))))
    # most texts repeat no window, and hashes alone sort fast
    ordered = _held(hashed, ordered=F.sort_array("windows"))
    twice = F.exists(F.zip_with("ordered", _following(c("ordered")), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)
    places_of = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = _held(ordered, by_hash=F.when(twice, places_of).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    beside = F.zip_with("by_hash", _following(c("by_hash")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    found = _held(placed, found=F.array_sort(F.array_distinct(F.flatten(F.transform(beside, lambda p: F.coalesce(p, F.array().cast("array<int>")))))))
    steps = F.zip_with("found", _following(c("found")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    n_repeat = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    counted = _held(found, kinds=F.transform("lines", lambda line: F.struct(F.xxhash64(normalised(line)).alias("hash"), in_words(of(line)).alias("chars"))))
    return counted.select(
        "id",
        "host",
        F.md5(c("text").cast("binary")).alias("copy"),
        F.size("words").cast("long").alias("n_words"),
        in_words(c("words")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        "kinds",
    )


def frequent_lines(lines: DataFrame, hosts: DataFrame, *, min_docs: int, min_share: float) -> DataFrame:
    """host, hash, n: lines that more distinct documents of a host hold than both limits allow.

    ``lines`` has host, hash and copy (the text's hash), so that a text counts once however many copies it has; ``hosts`` has host and docs.
    Distinct triples and then counts are combined before they are shuffled, so a line that a third of all documents hold is a few rows a task.
    """
    counts = lines.select("host", "hash", "copy").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(c("n") > min_docs)
    return counts.join(hosts, "host").where(c("n") > c("docs") * min_share).select("host", "hash", "n")


def judge(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, min_share: float = 0.01, min_left: float = 0.5) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_host_chars, base_failed, kept of every row.

    A line goes if more than ``min_docs`` distinct documents of the host hold it, and more than ``min_share`` of the host's; n_host_chars are
    the word characters of a text in such lines, each time they occur. A document is kept if it passes the base rules and ``min_left`` of
    its word characters stay. Lines are compared normalised, by a 64-bit hash; copies of a text are one document; a null host
    is a host. Null, empty and blank texts have no words and fail. Texts of any length are read whole; repeated rows and null ids are rows
    like others; an empty table gives an empty result; further columns aren't read.
    """
    rows = written(measured(df, id_col=id_col, text_col=text_col, host_col=host_col).withColumn("row", F.monotonically_increasing_id()), "measured")
    hosts = rows.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    each = rows.select("row", "host", "copy", F.explode("kinds").alias("line")).select("row", "host", "copy", "line.*")
    often = written(frequent_lines(each, hosts, min_docs=min_docs, min_share=min_share), "lines")
    small = often.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hits = each.select("row", "host", "hash", "chars")
    hits = hits.join(F.broadcast(often), ["host", "hash"]) if small else lookup(hits, often, ["host", "hash"], heavy(often, ["host", "hash"]))
    gone = hits.groupBy("row").agg(F.sum("chars").alias("n_host_chars"))
    told = rows.drop("kinds").join(gone, "row", "left").withColumn("n_host_chars", F.coalesce("n_host_chars", F.lit(0)))
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MOST_REPEATED * c("n_words"))
    left = c("word_chars") - c("n_host_chars") >= c("word_chars") * min_left
    out = told.withColumns({"base_failed": failed, "kept": ~failed & left})
    return out.select(c("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_host_chars", "base_failed", "kept")

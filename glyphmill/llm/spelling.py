"""Spelling variants: words one edit apart, found by wildcard groups and never by pairs."""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, heavy, lookup, release, written
from glyphmill.plans.session import ship_package

c = F.col

#: One letter in this many is dropped from the runs that a checksum picks (fixed by the query's contract).
DROP_ONE_IN = 97

#: What is a letter, A-Z folded, as bytes of Latin-1, where the letters [A-Za-zÀ-ÿ] all lie.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

#: Words that a task counts before it hands its counts on, and characters of a text that are split at once.
MOST_HELD, STRETCH = 200_000, 1 << 20


def _stretches(text: str):
    """The text in stretches of about ``STRETCH`` characters that end where no run of letters goes on."""
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        while end < len(text) and ord(text[end]) < 256 and _FOLD[ord(text[end])] != 32:
            end += 1
        yield text[at:end]
        at = end


def _words_of(doc_id, text: str) -> Counter:
    """The runs of a text (A-Z folded) as Latin-1 bytes with their counts; those whose checksum says so have lost a letter."""
    runs: Counter = Counter()
    for part in _stretches(text):
        runs.update(part.encode("latin-1", "replace").translate(_FOLD).split())
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    words: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % DROP_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        words[run] += n
    return words


def count_words(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: how often each word of at least ``min_length`` code points occurs, if ``min_count`` times at least.

    Tasks add up counts and hand them on whenever they hold ``MOST_HELD`` words, so a frequent word reaches the shuffle
    as a few rows and a task's memory doesn't grow with its input.
    """
    ship_package(df.sparkSession)
    kept = df.select(c(id_col), F.coalesce(c(text_col), F.lit("")))

    def run(stream):
        held: Counter = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches(stream):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in _words_of(doc_id, text).items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= MOST_HELD:
                    yield told()
        yield told()

    parts = kept.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(c("n") >= min_count)


def _rank(n: str = "n", word: str = "word") -> Column:
    """Of two, the lesser is the more frequent word; of equals the first in code-point order."""
    return F.struct((-c(n)).alias("minus_n"), c(word).alias("word"))


def _cut(i: Column) -> tuple[Column, Column]:
    """What is before and what is after the i-th code point of word."""
    return F.substring(c("word"), F.lit(1), i - 1), F.substring(c("word"), i + 1, F.char_length("word"))


def _replaced(words: DataFrame) -> DataFrame:
    """word, near, best: how many words differ from each in one position's letter, and the first of them.

    All words with one (position, prefix, suffix) are near each other. A group's size and its two first words tell
    each member all it needs: its near words there are all but itself, and the best is the first, or the second for the first
    itself. Two words share at most one group, so sums over groups are exact. A group has a word for each letter of
    the alphabet at most.
    """
    before, after = _cut(c("position"))
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("position"))
    keyed = places.select("position", before.alias("prefix"), after.alias("suffix"), _rank().alias("rank"))
    groups = keyed.groupBy("position", "prefix", "suffix").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("rank")).alias("members")).where("size > 1")
    top = groups.select("size", F.get("members", F.lit(0)).alias("first"), F.get("members", F.lit(1)).alias("second"), F.explode("members").alias("own"))
    return top.select("own.word", (c("size") - 1).alias("near"), F.when(c("own.word") == c("first.word"), c("second")).otherwise(c("first")).alias("best"))


def _shortened(words: DataFrame) -> DataFrame:
    """word, near, best over insertions and deletions: each word without one of its letters meets the vocabulary.

    Equal results of one word (a letter doubled) count once. What meets is told to both: the longer word has the shorter
    near it, and the shorter gets the number and the first of its longer ones, added up before they are shuffled.
    """
    less = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.concat(*_cut(i))))
    cut = words.select(F.explode(less).alias("less"), _rank().alias("longer"))
    # merged: either side grows with the vocabulary, and Spark sizes the cuts as if there were one a word
    met = cut.join(words.select(c("word").alias("less"), _rank().alias("shorter")).hint("merge"), "less")
    grown = met.groupBy("less").agg(F.count("*").alias("near"), F.min("longer").alias("best")).select(c("less").alias("word"), "near", "best")
    return grown.unionByName(met.select("longer.word", F.lit(1).cast("long").alias("near"), c("shorter").alias("best")))


def _roots(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word, root for rows (word, form): every word jumps to its root's root until none moves. A form is at least twice as
    frequent as its word, so there are no circles and chains are as long as the logarithm of the counts."""
    now = written(forms.select("word", c("form").alias("root")), "roots")
    for _ in range(most_rounds):
        busy = heavy(now.groupBy("root").agg(F.count("*").alias("n")), ["root"])
        on = now.select(c("word").alias("root"), c("root").alias("further"))
        moved = lookup(now, on, ["root"], busy, "left", merge=True)
        new = written(moved.select("word", F.coalesce("further", "root").alias("root"), c("further").isNotNull().alias("moved")), "roots")
        release(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")
    raise RuntimeError(f"spelling: no end after {most_rounds} rounds")


def variants(words: DataFrame, *, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n), each word once.

    Words are near if they differ by one inserted, deleted or replaced code point. The form is the most frequent near word
    (of equals the first in code-point order) if it is at least ``times`` (2 at least) as frequent; the root is the last form that
    following them gives. An empty vocabulary gives an empty result; words of any length are taken whole. No table of words is
    broadcast: its files are much smaller than its rows.
    """
    if times < 2:
        raise ValueError("times must be 2 at least, else forms may go round in circles")
    words = words.where(c("word").isNotNull())
    near = _replaced(words).unionByName(_shortened(words)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    joined = words.join(near.hint("merge"), "word", "left")
    good = -c("best.minus_n") >= c("n") * times
    told = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, c("best.word")).alias("form"), F.when(good, -c("best.minus_n")).alias("form_n")), "forms")
    roots = _roots(told.where("form is not null"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def group_variants(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of whole texts.

    A null or empty text has no words; a null id counts as an empty one in the checksums; repeated rows count each; very long
    texts are read in stretches; an empty table gives an empty result; further columns of ``df`` aren't read.
    """
    return variants(written(count_words(df, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count), "words"))

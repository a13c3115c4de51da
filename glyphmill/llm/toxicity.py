"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, with exception phrases."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, per_text, written
from glyphmill.llm.pii import FOLDS

#: Digits and signs written for letters.
_SUBSTITUTE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


class _Plain(dict):
    """Code point to lower-case plain letter, digit or space, made on demand."""

    def __missing__(self, code: int) -> str:
        c = FOLDS[code]
        out = "".join(x.lower() if x.isalnum() else (x if x in "@$!" else " ") for x in c) if c else ""
        self[code] = out
        return out


_PLAIN = _Plain()


def fold(text: str) -> list[str]:
    """Words of a text, lower case, with look-alike letters and digits written for letters undone.

    A sign counts as a letter only within a word ("!" at a word's end is punctuation), and a digit only
    in a word that has a letter.
    """
    out = []
    for word in text.translate(_PLAIN).split():
        if not word.isalpha():
            word = word.rstrip("!").lstrip("!@$").rstrip("@$")
            if any(c.isalpha() for c in word):
                word = "".join(_SUBSTITUTE.get(c, c) for c in word)
            elif not word:
                continue
        out.append(word)
    return out


def patterns_of(words: list[str], longest: int = 9) -> set[str]:
    """What the lexicon may hold of a text: whole words (" word ") and beginnings of words (" wor", 4 letters or more)."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        for n in range(4, min(len(w), longest + 1)):
            out.add(" " + w[:n])
    return out


@dataclass
class Lexicon:
    """``weights`` by pattern; ``exceptions``: phrases in which what they hold doesn't count; score = logistic(bias + slope * density)."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: float = -2.0
    slope: float = 1.0


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        for pattern, weight in lexicon.weights.items():
            if pattern[1:-1] not in lexicon.exceptions:
                self.automaton.add_word(pattern, (len(pattern), weight))
        self.automaton.make_automaton()

    def hits(self, words: list[str]) -> dict[int, float]:
        """The greatest weight of each place where a pattern starts, outside exception phrases."""
        if not len(self.automaton):
            return {}
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(" " + " ".join(words) + " "):
            start = end - size + 1
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                excused.append((start, end))
        if excused:
            starts, at, until = sorted(found), 0, -1
            for s, e in sorted(excused):
                until = max(until, e)
                at = max(at, bisect_left(starts, s, at))
                while at < len(starts) and starts[at] < until:
                    del found[starts[at]]
                    at += 1
        return found

    def density(self, words: list[str]) -> float:
        """Weight of all hits, normalised by length: over the square root of the hundreds of words, and as it is up to a hundred. Four
        times the words need twice the weight, so that a toxic passage in a long text still tells."""
        return sum(self.hits(words).values()) / max(1.0, math.sqrt(len(words) / 100))

    def score(self, words: list[str]) -> float:
        z = self.lexicon.bias + self.lexicon.slope * self.density(words)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> Column:
    """Rows to learn from: those whose crc32 of the id as text isn't divisible by 5, and, as they have no label, null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_labelled: int = 20_000, least_count: int = 4, doubt: float = 0.05, least_weight: float = 1.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learns weights from labelled rows outside the held-out fold, ``most_labelled`` of them at most.

    Three quarters give the weights (log odds of a pattern among toxic and other texts), the rest the
    slope and bias. A text counts once, however many copies and near copies it has (``kin``). Every pattern of ``least_count`` toxic texts is tried,
    and gets in with a weight over ``least_weight``, if chance doesn't explain it among so many tries
    (``doubt`` is the chance that any gets in wrongly). Phrases that hold a word of
    the lexicon and occur in clean texts only are exceptions, besides those given. Without labels of both
    kinds the lexicon is empty and every score is low. Null texts are empty; a repeated id has the greatest
    of its labels; what is learned, and so every table that the driver gets, is bounded by the labelled rows.
    """
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & training_rows(labels, id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    sample = written(rows.orderBy(F.xxhash64("_id"), "_id").limit(most_labelled).withColumn("_part", F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(4)).cast("int")), "labelled")
    texts = written(docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id").select("_text", "_label", "_part"), "training")
    texts = written(_one_of_each(texts), "distinct")
    spark = docs.sparkSession

    def counted(where: str, wanted: dict | None) -> dict[str, int]:
        """Texts that hold each pattern (of ``wanted``, if given), at least ``least_count``."""
        shared = spark.sparkContext.broadcast(wanted)

        def run(stream):
            seen, among = Counter(), shared.value
            for batch in batches(stream):
                for text in batch.column(0).to_pylist():
                    words = fold(text)
                    got = patterns_of(words) if among is None else {p for p in patterns_of(words) | phrases_of(words) if p in among}
                    seen.update(got)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["p", "n"])

        sums = texts.where(where).select("_text").mapInArrow(run, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
        if among_all := wanted is None:
            sums = sums.where(F.col("n") >= least_count)
        return {r.p: r.n for r in sums.collect()} if among_all or wanted else {}

    n_clean, n_toxic = ({r._label: r.n for r in texts.where("_part > 0").groupBy("_label").agg(F.count("*").alias("n")).collect()}.get(x, 0) for x in (0, 1))
    if not n_clean or not n_toxic:
        return Lexicon(exceptions=list(exceptions), bias=-3.0)
    toxic = counted("_label = 1 and _part > 0", None)
    clean = counted("_label = 0 and _part > 0", dict.fromkeys(toxic))
    scored = {}
    sure = NormalDist().inv_cdf(1 - doubt / max(1, len(toxic)))
    for p, n in toxic.items():
        other = clean.get(p, 0)
        weight = math.log((n + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_clean + 1))
        if weight > least_weight and evidence(n, n_toxic, other, n_clean) > sure:
            scored[p] = weight
    # where one word makes up a beginning, the word is meant
    for word in [p for p in scored if p.endswith(" ")]:
        for n in range(5, len(word) - 1):
            if toxic[word] >= 0.9 * toxic.get(word[:n], math.inf):
                scored.pop(word[:n], None)
    chosen: dict[str, float] = {}
    for p in sorted(scored, key=len):
        # a longer pattern must say more than the beginning that it contains
        shorter = max((chosen[p[:i]] for i in range(5, len(p)) if p[:i] in chosen), default=-math.inf)
        if scored[p] > shorter + 0.25:
            chosen[p] = scored[p]
    lexicon = Lexicon(chosen, list(exceptions) + _excused(texts, chosen, least_count))
    matcher_of = spark.sparkContext.broadcast(lexicon)

    def densities(stream):
        matcher = Matcher(matcher_of.value)
        for batch in batches(stream):
            yield pa.RecordBatch.from_arrays([pa.array([matcher.density(fold(t)) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], names=["d", "label"])

    held = texts.where("_part = 0").select("_text", "_label").mapInArrow(densities, "d double, label int").toPandas()
    if held["label"].nunique() == 2:
        lexicon.bias, lexicon.slope = _logistic(held["d"].to_numpy(), held["label"].to_numpy())
    return lexicon


def kin(words: list[str]) -> int:
    """The least hash of the text's runs of three words: near copies share it as often as they share runs."""
    if len(words) < 3:
        return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1
    return min(map(xxhash.xxh3_64_intdigest, map(" ".join, zip(words, words[1:], words[2:], strict=False)))) >> 1


def _one_of_each(texts: DataFrame) -> DataFrame:
    """One of the texts that are kin, for each label."""
    marked = per_text(texts, "_label", "_text", lambda: lambda text: (kin(fold(text)), text), "kin long, _all string", keep=("_part",))
    return marked.groupBy("kin", "_label").agg(F.min(F.struct("_all", "_part")).alias("one")).select(F.col("one._all").alias("_text"), "_label", F.col("one._part").alias("_part"))


def evidence(n: int, of: int, other: int, of_others: int) -> float:
    """How many standard deviations n of ``of`` lies above ``other`` of ``of_others``: the root of the likelihood ratio's statistic."""
    share = (n + other) / (of + of_others)
    seen = [(n, of * share), (of - n, of * (1 - share)), (other, of_others * share), (of_others - other, of_others * (1 - share))]
    return math.sqrt(max(0.0, 2 * sum(x * math.log(x / e) for x, e in seen if x))) * (1 if n * of_others > other * of else -1)


def phrases_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _excused(texts: DataFrame, chosen: dict[str, float], least_count: int) -> list[str]:
    """Two-word phrases around the lexicon's whole words that occur in clean texts and never in toxic ones."""
    whole = {p.strip() for p in chosen if p.endswith(" ")}
    if not whole:
        return []
    shared = texts.sparkSession.sparkContext.broadcast(whole)

    def run(stream):
        seen, known = Counter(), shared.value
        for batch in batches(stream):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = fold(text)
                near = [i for i, w in enumerate(words) if w in known]
                seen.update({(" ".join(words[i : i + 2]), label) for i in near if i + 1 < len(words)} | {(" ".join(words[i - 1 : i + 1]), label) for i in near if i})
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([p for (p, _), _ in rows], pa.string()), pa.array([x for (_, x), _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], names=["p", "label", "n"])

    sums = texts.where("_part > 0").select("_text", "_label").mapInArrow(run, "p string, label int, n long").groupBy("p").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return [r.p for r in sums.where((F.col("clean") >= least_count) & (F.col("toxic") == 0)).orderBy("p").collect()]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope by Newton's method, with a light prior on the slope."""
    a, b = np.column_stack([np.ones_like(x), x]), np.array([-2.0, 0.5])
    prior = np.array([0.0, 0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (y - p) - prior * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(prior + 1e-9), gradient)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 1e-3))


def score(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (score >= 0.5) of every whole text; a null text is empty and scores
    as one without hits. One row out for each row in, whatever its id; an empty table gives an empty result;
    further columns aren't read. Texts of any length are read whole, in time that grows with their length."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def start():
        matcher = Matcher(shared.value)

        def work(text: str) -> tuple:
            words = fold(text)
            s = matcher.score(words)
            return s, int(s >= 0.5)

        return work

    return per_text(docs, id_col, text_col, start, "score double, predicted int")

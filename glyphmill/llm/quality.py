"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, per_text, release, written

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_known: dict[str, int] = {}
#: Tokens whose hash a worker keeps; a worker lives through all stages of a pipeline, and hashing a token again costs little.
MOST_KNOWN = 50_000
BUCKETS, SMOOTHING = 1 << 15, 4.0


def features(text: str, buckets: int) -> np.ndarray:
    """Bucket of each word or run of signs, and of each two in a row; lower case, repeats included."""
    known, tokens = _known, _TOKEN.findall(text.lower())
    if len(known) > MOST_KNOWN:
        known.clear()
    for t in set(tokens):
        if t not in known:
            known[t] = zlib.crc32(t.encode())
    one = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(one) < 2:
        return (one % np.uint64(buckets)).astype(np.int64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    """``weights``: log p_target - log p_raw by bucket. ``bias`` and ``slope``: how likely a text belongs to the target,
    as logistic(bias + slope * asinh(log_weight)); only the size of the target in the raw text is estimated by it."""

    buckets: int
    weights: np.ndarray
    bias: float = math.inf
    slope: float = 0.0


def labelled_sample(labels: DataFrame, most: int, id_col: str, label_col: str) -> DataFrame:
    """At most ``most`` labelled rows, chosen by a hash of the id: (_id, _label, _fit). Three quarters fit the target model."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    chosen = rows.orderBy(F.xxhash64("_id"), "_id").limit(most)
    return chosen.withColumn("_fit", F.pmod(F.xxhash64(F.lit(4), F.col("_id")), F.lit(4)) > 0)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, most_labelled: int = 20_000) -> Model:
    """The raw model counts every text of ``docs``; the target model counts texts labelled 1. Bias and slope are
    fitted on labelled texts that the target model hasn't seen.

    ``most_labelled`` bounds the labelled rows in use, and so the broadcast of their ids. Each task
    sends on the buckets' counts, never texts or n-grams. Without labelled rows of both kinds every text
    counts as belonging to the target.
    """
    sample = written(labelled_sample(labels, most_labelled, id_col, label_col), "labelled")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    marked = texts.join(F.broadcast(sample.where("_fit").select("_id", "_label")), "_id", "left")

    def count(stream):
        raw, good = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches(stream):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = features(text, buckets)
                np.add.at(raw, f, 1)
                if label == 1:
                    np.add.at(good, f, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    sums = marked.select("_text", "_label").mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    rows = sums.toPandas()  # one row a bucket at most
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], good[rows["bucket"]] = rows["raw"], rows["good"]
    model = Model(buckets, log_ratios(raw, good))
    unseen = score(texts.join(F.broadcast(sample.where("not _fit").select("_id", "_label")), "_id"), model, id_col="_id", text_col="_text", keep=("_label",))
    seen = unseen.where("n_features > 0").select("_label", "log_weight").toPandas()
    if seen["_label"].nunique() == 2:
        model.bias, model.slope = logistic_fit(np.arcsinh(seen["log_weight"].to_numpy()), seen["_label"].to_numpy())
    release(sample)
    return model


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw by bucket. The target model leans on the raw one where its few texts say nothing."""
    p_raw = (raw + 0.1) / (raw + 0.1).sum()
    strength = SMOOTHING * len(raw)
    return np.log((good + strength * p_raw) / (good.sum() + strength)) - np.log(p_raw)


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Bias and slope by Newton's method, with a light prior on the slope."""
    a, b = np.column_stack([np.ones_like(x), x]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (y - p) - np.array([0.0, 0.01]) * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-9, 0.01]), gradient)
        b = b + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, n_features and log_weight: the log importance weight of the whole text, the sum over its n-grams of
    log p_target - log p_raw (0 without any)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.buckets, model.weights))

    def start():
        buckets, weights = shared.value

        def work(text: str) -> tuple:
            f = features(text, buckets)
            return len(f), float(weights[f].sum()) if len(f) else 0.0

        return work

    return per_text(docs, id_col, text_col, start, "n_features long, log_weight double", keep)


def gumbel_keys(scored: DataFrame, *, id_col: str = "doc_id", temperature: float = 1.0, seed: int = 7) -> DataFrame:
    """Adds gumbel_key: log_weight over temperature plus Gumbel noise drawn by a hash of seed and id. The k greatest
    keys are a sample without replacement in proportion to the importance weights (at temperature 1)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return scored.withColumn("gumbel_key", F.col("log_weight") / F.lit(float(temperature)) - F.log(-F.log(u)))


def target_size(scored: DataFrame, model: Model) -> int:
    """The expected number of texts that belong to the target: the sum of their probabilities."""
    if math.isinf(model.bias):
        return scored.count()
    p = 1 / (1 + F.exp(-(F.lit(model.bias) + F.lit(model.slope) * F.asinh("log_weight"))))
    return round(scored.agg(F.sum(p)).first()[0] or 0.0)


def kth_greatest(df: DataFrame, col: str, k: int) -> float:
    """The k-th greatest value of a double column, exactly, by counting: each round halves an interval of
    histogram bins until one value is left in it. Only bin counts reach the driver."""
    if k <= 0:
        return math.inf
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if n <= k:
        return -math.inf
    bins = 4096
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            # neighbouring doubles: count them one by one
            values = df.where((F.col(col) >= lo) & (F.col(col) <= hi)).groupBy(col).count().orderBy(F.desc(col)).collect()
            for value, count in values:
                k -= count
                if k <= 0:
                    return value
        inside = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
        at = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        rows = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), reverse=True)
        for _, count, low, high in rows:
            if k <= count:
                lo, hi = low, high
                break
            k -= count
    return lo


def importance_resample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, most_labelled: int = 20_000, temperature: float = 1.0, seed: int = 7) -> tuple[DataFrame, Model, float]:
    """Scores of all documents with their decision, the model and the k-th greatest key.

    Columns: id, n_features, log_weight, gumbel_key, selected. ``k`` documents are selected, the
    greatest keys, so that a text of greater weight is the likelier to be drawn but no cut on the weight
    decides; by default k is the expected size of the target within ``docs`` (``target_size``). Keys that tie
    with the k-th are all selected. A null or empty text has no n-grams, a log_weight of 0 and is
    rejected; an empty table gives an empty result; repeated rows share one fate; rows with a null id
    share their noise. Texts of any length are read whole, in linear time.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, buckets=buckets, most_labelled=most_labelled)
    keyed = written(gumbel_keys(score(docs, model, id_col=id_col, text_col=text_col), id_col=id_col, temperature=temperature, seed=seed), "keys")
    real = keyed.where("n_features > 0")
    least = kth_greatest(real, "gumbel_key", target_size(real, model) if k is None else k)
    return keyed.withColumn("selected", (F.col("n_features") > 0) & (F.col("gumbel_key") >= F.lit(least))), model, least


def keep_selected(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", temperature: float = 1.0, seed: int = 7, **options) -> DataFrame:
    """The rows of ``docs`` that resampling selects, all columns as they were, whatever their names; null and empty
    texts go. Texts are scored again where they lie, so that none is shuffled."""
    keyed, model, least = importance_resample(docs, labels, id_col=id_col, text_col=text_col, temperature=temperature, seed=seed, **options)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_all"), F.struct(*docs.columns).alias("_row"))
    again = gumbel_keys(score(rows, model, id_col="_id", text_col="_all", keep=("_row",)), id_col="_id", temperature=temperature, seed=seed)
    return again.where((F.col("n_features") > 0) & (F.col("gumbel_key") >= F.lit(least))).select("_row.*")

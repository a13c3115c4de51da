"""Token counts without tokenising every word: a map-side lookup of pre-token lengths in two tiers."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, per_text

#: A pre-token is a run of spaces and the run of other characters after it. No piece of the vocabulary
#: has a space mark behind another character, so no merge crosses from one pre-token into the next.
_PRE_TOKEN = re.compile(r" *[^ ]+| +")
_SPACE_MARK = "▁"
_LONGEST_KEPT = 48


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the first of its leading spaces (the model's own prefix stands for it)."""
    if not text:
        return []
    text = text.replace(_SPACE_MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [part[1:] for part in _PRE_TOKEN.findall(" " + text)]


class WorkerCache(dict):
    """Second tier: lengths of pre-tokens that this worker has met; emptied when full, so memory is bounded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part)) if part else 1  # a single space is one piece
        if len(part) <= _LONGEST_KEPT:
            if len(self) >= self.most:
                self.clear()
            self[part] = n
        return n


_loaded: dict[int, object] = {}


def _encoder(model: bytes):
    import sentencepiece

    key = hash(model)
    if key not in _loaded:
        _loaded[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _loaded[key].encode


def check_model(model: bytes) -> None:
    """Raises unless pre-token lengths add up for this model: spaces only lead pieces, nothing is rewritten."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if any(_SPACE_MARK in sp.id_to_piece(i).lstrip(_SPACE_MARK) for i in range(sp.get_piece_size())):
        raise ValueError("a piece of this model spans two words: pre-token lengths don't add up")
    if sp.encode("a  b ", out_type=str)[0][0] != _SPACE_MARK or sp.decode(sp.encode(" a  b ")) != " a  b ":
        raise ValueError("this model rewrites spaces: pre-token lengths don't add up")
    if sp.encode("a b")[: len(sp.encode("a"))] != sp.encode("a") or len(sp.encode(_SPACE_MARK, out_type=str)) < 1:
        raise ValueError("this model doesn't split at spaces")


def frequent_pre_tokens(df: DataFrame, text_col: str, most: int = 32768, per_task: int = 4096) -> list[str]:
    """The most frequent pre-tokens over all texts. A task hands on its ``per_task`` most frequent only, so
    what is shuffled is a bounded summary of each task and never the pre-tokens; ``most`` bounds the result."""

    def summarise(stream):
        seen: Counter[str] = Counter()
        for batch in batches(stream):
            for text in batch.column(0).to_pylist():
                seen.update([p for p in pre_tokens(text) if 0 < len(p) <= _LONGEST_KEPT])
            if len(seen) > 50 * per_task:
                seen = Counter(dict(seen.most_common(10 * per_task)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["part", "n"])

    texts = df.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    counts = texts.mapInArrow(summarise, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return [r.part for r in counts.orderBy(F.desc("n"), "part").limit(most).collect()]


def count_tokens(
    df: DataFrame,
    model: bytes,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    frequent: int = 32768,
    cached: int = 200_000,
) -> DataFrame:
    """Tokens of every whole text as the sentencepiece library counts them: id, n_bytes, n_tokens, over_limit.

    First tier: the ``frequent`` commonest pre-tokens over all texts, encoded once on the driver and
    broadcast with their lengths (a few MB at most). Second tier: each worker encodes what the table
    lacks and keeps up to ``cached`` lengths. Counts are exact whatever the tables hold; no pre-token
    is shuffled. A null text is empty and has 0 tokens; rows with a null or repeated id are counted
    like any other, one row out for each row in; an empty table gives an empty result. A text of any length is encoded
    whole, pre-token by pre-token; those over ``_LONGEST_KEPT`` characters are kept in no table. Further columns aren't read.
    """
    check_model(model)
    encode = _encoder(model)
    lengths = {part: len(encode(part)) for part in frequent_pre_tokens(df, text_col, frequent)} if frequent else {}
    shared = df.sparkSession.sparkContext.broadcast((model, lengths))

    def start():
        proto, table = shared.value
        cache = WorkerCache(_encoder(proto), cached)
        look = table.get

        def count(text: str) -> tuple:
            parts = pre_tokens(text)
            found = list(map(look, parts))
            n = sum(filter(None, found))
            if None in found:
                n += sum(cache[p] for p, f in zip(parts, found, strict=True) if f is None)
            return len(text.encode()), n, n > limit

        return count

    return per_text(df, id_col, text_col, start, "n_bytes long, n_tokens long, over_limit boolean")

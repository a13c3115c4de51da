"""Byte-level BPE, encoding and decoding: a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import regex
from pyspark.sql import DataFrame

from glyphmill.llm.common import per_text

#: Fixed value: the public pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable character that vocabulary files write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_NONE = 1 << 62
_PLACE_BITS = 32
_PLACE = (1 << _PLACE_BITS) - 1
_ID_BITS = 17


def merge_pairs(ids: list[int | None], rank_of: dict[int, int], result: list[int]) -> list[int]:
    """Merges neighbours, always the leftmost of the lowest-ranked pairs, until no pair has a rank.

    A segment tree lies over the adjacent pairs: leaf i is (rank, i) of the pair that starts at symbol i,
    and the root, the least, is the pair to merge next. A merge changes three leaves at most, and
    each update climbs one path, up to where nothing changes. ``rank_of`` has pairs as left id << 17 |
    right id, ``result`` the id that each rank's merge gives.
    """
    n = len(ids)
    pairs = n - 1
    node = [_NONE] * (2 * pairs)
    get = rank_of.get
    for i in range(pairs):
        rank = get(ids[i] << _ID_BITS | ids[i + 1])
        if rank is not None:
            node[pairs + i] = rank << _PLACE_BITS | i
    for i in range(pairs - 1, 0, -1):
        left, right = node[2 * i], node[2 * i + 1]
        node[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := node[1]) != _NONE:
        i = best & _PLACE
        j = after[i]
        new = ids[i] = result[best >> _PLACE_BITS]
        ids[j] = None
        k = after[i] = after[j]
        changed = []
        if j < pairs:
            changed.append((j, _NONE))
        if k < n:
            before[k] = i
            rank = get(new << _ID_BITS | ids[k])
            changed.append((i, _NONE if rank is None else rank << _PLACE_BITS | i))
        else:
            changed.append((i, _NONE))
        h = before[i]
        if h >= 0:
            rank = get(ids[h] << _ID_BITS | new)
            changed.append((h, _NONE if rank is None else rank << _PLACE_BITS | h))
        for place, value in changed:
            at = pairs + place
            if node[at] == value:
                continue
            node[at] = value
            at >>= 1
            while at:
                left, right = node[2 * at], node[2 * at + 1]
                least = left if left < right else right
                if node[at] == least:
                    break
                node[at] = least
                at >>= 1
    return [x for x in ids if x is not None]


class ByteBpe:
    """A byte-level BPE vocabulary in the form of the tokenizers library's JSON file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        vocab: dict[str, int] = model["vocab"]
        self.first = [vocab[alphabet[b]] for b in range(256)]
        merges = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.rank_of = {vocab[a] << _ID_BITS | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.result = [vocab[a + b] for a, b in merges]
        self.bytes: dict[int, bytes] = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes |= {i: content.encode() for content, i in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def pre_tokens(self, text: str) -> list[str]:
        """Added tokens whole, and the pattern's matches between them."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in found:
            out += self.pattern.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def ids_of(self, pre_token: str) -> tuple[int, ...]:
        if pre_token in self.added:
            return (self.added[pre_token],)
        ids = [self.first[b] for b in pre_token.encode()]
        return tuple(merge_pairs(ids, self.rank_of, self.result) if len(ids) > 1 else ids)


class Coder:
    """Encodes and decodes whole texts. Keeps what short pre-tokens come to in two generations: when the young
    one is full it becomes the old one, so that what is in use stays and memory is bounded."""

    def __init__(self, spec: str, cached: int):
        self.bpe, self.most = ByteBpe(spec), cached
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def runs(self, text: str) -> list[tuple[int, ...]]:
        """The ids of each pre-token."""
        parts = self.bpe.pre_tokens(text)
        found = list(map(self.young.get, parts))
        if None in found:
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                found[at] = self._ids(parts[at])
        return found

    def _ids(self, part: str) -> tuple[int, ...]:
        ids = self.young.get(part) or self.old.get(part) or self.bpe.ids_of(part)
        if len(part) <= 48:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[part] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def decode(self, ids: list[int]) -> str:
        """Bytes of the ids, joined; bytes that are no UTF-8 become replacement characters; ids out of the vocabulary are skipped."""
        table = self.bpe.bytes
        try:
            return b"".join(map(table.__getitem__, ids)).decode(errors="replace")
        except KeyError:
            return b"".join(table.get(i, b"") for i in ids).decode(errors="replace")


_coders: dict[int, Coder] = {}


def _coder(spec: str, cached: int) -> Coder:
    key = hash((spec, cached))
    if key not in _coders:
        _coders[key] = Coder(spec, cached)
    return _coders[key]


def encode(df: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text", cached: int = 300_000) -> DataFrame:
    """id and ids (array<int>) of every whole text. ``spec`` is the vocabulary file's content, which is broadcast.

    Null texts are empty and have no ids; one row out for each row in, whatever its id.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def start():
        coder = _coder(shared.value, cached)
        return lambda text: (coder.encode(text),)

    return per_text(df, id_col, text_col, start, "ids array<int>")


def decode(df: DataFrame, spec: str, *, id_col: str = "doc_id", ids_col: str = "ids", cached: int = 300_000) -> DataFrame:
    """id and text of every row's ids; null ids give an empty text."""
    import pyarrow as pa

    shared = df.sparkSession.sparkContext.broadcast(spec)
    kept = df.select(id_col, ids_col)

    def run(stream):
        coder = _coder(shared.value, cached)
        for batch in stream:
            texts = [coder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return kept.mapInArrow(run, kept.select(id_col).schema.add("text", "string"))


def round_trip(df: DataFrame, spec: str, *, id_col: str = "doc_id", text_col: str = "text", cached: int = 300_000) -> DataFrame:
    """Encodes every whole text and decodes its ids again, in one pass: id, n_tokens and the SHA-256 of the
    decimal ids joined by commas and of the decoded text. The ids themselves come from ``encode``."""
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def start():
        coder = _coder(shared.value, cached)
        decimal = {i: str(i) for i in coder.bpe.bytes}
        sha = hashlib.sha256

        def work(text: str) -> tuple:
            ids = coder.encode(text)
            joined = ",".join(map(decimal.__getitem__, ids))
            return len(ids), sha(joined.encode()).hexdigest(), sha(coder.decode(ids).encode()).hexdigest()

        return work

    return per_text(df, id_col, text_col, start, "n_tokens long, ids_sha256 string, decoded_sha256 string")

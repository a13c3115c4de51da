"""Repeated passages: Burrows-Wheeler transforms of shards, merged by interleave refinement.

A window is a string of ``length`` bytes. It is removed wherever it starts, if it also starts
anywhere else. Windows that are equal agree on an anchor, the least-hashed k-gram within them, and on
where it lies; so windows are gathered by their anchor, and whatever repeats meets in one group. Hashes do no
more than leave out anchors that occur once. A run of windows with one anchor is a segment: the bytes
before the anchor, the anchor as one symbol, and the bytes after it. The segments of a group come from
shards of the corpus; each shard has its own Burrows-Wheeler transform, the transforms are merged,
and the common prefixes that the merge finds are the repeated windows. A segment that occurs
several times is in the merge twice, as it takes two to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import batches, bits_for, filter_bits, heavy, in_filter, lookup, release, written
from glyphmill.llm.rolling import gram_hashes, mix, prefix_hashes, span_hashes, window_minima
from glyphmill.plans.session import ship_package

GRAM_SHARE = 0.5  # of a window that its anchor covers, about


def shape(length: int) -> tuple[int, int]:
    """(bytes of an anchor, stride) for windows of ``length`` bytes. A window is then ``length - gram + 1`` symbols, a
    multiple of the stride: transforms are over runs of so many symbols, which spares most rounds of the merge."""
    depth = length - max(1, int(length * GRAM_SHARE)) + 1
    stride = 32 if depth >= 96 else 4 if depth >= 8 else 1
    return length - depth // stride * stride + 1, stride


# ---- segments of a text ------------------------------------------------------------------------


#: Bytes of a text that are worked on at once.
BLOCK = 1 << 21


def segments(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Block by block (anchor hash, first window, number of windows, place of the anchor, times) of each run of windows that share an
    anchor; first window and anchor are byte places.

    Where a text repeats with a short period, one segment follows another with the same bytes: these are one row, ``times`` of them on
    end, each as many bytes after the last as it has windows. So a text of one byte over and over is a row for each block.
    """
    for base in range(0, max(1, len(data) - length + 1), BLOCK - length):
        piece = data[base : base + BLOCK]
        if len(piece) < length:
            return
        prefix = prefix_hashes(piece)
        grams = gram_hashes(prefix, gram)
        anchor = window_minima(grams, length - gram + 1)
        if base + BLOCK < len(data):
            anchor = anchor[: BLOCK - length]  # the next piece starts with the next window
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.concatenate([first, [len(anchor)]]))
        at = anchor[first]
        whole = span_hashes(prefix, first, first + count - 1 + length)
        alike = np.r_[False, (whole[1:] == whole[:-1]) & (count[1:] == count[:-1]) & (np.diff(at) == np.diff(first))]
        head = np.flatnonzero(~alike)
        times = np.diff(np.r_[head, len(first)])
        for i in np.flatnonzero(times > 1):
            # a hash has the first word, the bytes the last
            j, step = head[i], count[head[i]]
            stretch = piece[first[j] : first[j] + (times[i] - 1) * step + step - 1 + length]
            if not np.array_equal(stretch[step:], stretch[:-step]):
                alike[j + 1 : j + times[i]] = False
        head = np.flatnonzero(~alike)
        times = np.diff(np.r_[head, len(first)])
        yield grams[at[head]], first[head] + base, count[head], at[head] + base, times
        if base + BLOCK >= len(data):
            return


# ---- transforms and their merge ----------------------------------------------------------------


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from zero, by their 16-bit digits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    rest = values >> 16
    while rest.any():
        order = order[np.argsort((rest[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        rest = rest >> 16
    return order


def transform(text: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform of a shard: the symbol before each suffix, in suffix order.

    ``text`` is strings of symbols over 0, each ended by 0 (their places in ``separators``); equal
    suffixes of different strings are ordered by string. The suffixes of this one shard are sorted by
    prefix doubling; suffixes of the whole never are.
    """
    n = len(text)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    width = 1
    order = stable_order(rank)
    after = np.zeros(n, dtype=np.int64)
    while True:
        ordered, ordered_after = rank[order], after[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]) | (ordered_after[1:] != ordered_after[:-1])]))
        if new[order[-1]] == n - 1:
            break
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = new[width:] + 1
        rank = new
        order = stable_order(after)
        order = order[stable_order(rank[order])]
        width *= 2
    return np.where(order == 0, text[-1], text[order - 1])


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the shards' transforms: the shard of each suffix of the whole in the order of their first
    ``depth`` symbols, and the common prefix of each with the one before, up to ``depth``.

    At first all suffixes are alike. A round deals the shard numbers, in the present order, by the
    symbol that precedes each suffix: by then suffixes are in order of one symbol more. Where two
    neighbours part in round h, their common prefix is h - 1 symbols. Separators differ from each other.
    """
    total = sum(map(len, transforms))
    joined = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    common = np.full(total, depth, dtype=np.int16)
    common[0] = 0
    block = np.zeros(total, dtype=np.int32)
    parted = 1
    for h in range(1, depth + 1):
        symbols = np.empty(total, dtype=joined.dtype)
        symbols[np.argsort(shard, kind="stable")] = joined
        deal = stable_order(symbols)
        shard, symbols, block = shard[deal], symbols[deal], block[deal]
        edge = np.empty(total, dtype=bool)
        edge[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=edge[1:])
        edge[1:] |= block[1:] != block[:-1]
        edge[1:] |= symbols[1:] == 0
        new = edge & (common == depth)
        common[new] = h - 1
        block = np.cumsum(edge, dtype=np.int32)
        if block[-1] == parted and h > 1:
            break  # nothing parted in this round, so nothing will
        parted = block[-1]
    return shard, common


def _suffix_order(bwt: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of a shard's suffixes in order, read off its transform: all strings walk backwards at once, from
    their separators, which are first in order and stand in the order of the strings."""
    step = np.empty(len(bwt), dtype=np.int64)
    step[stable_order(bwt)] = np.arange(len(bwt))
    order = np.empty(len(bwt), dtype=np.int64)
    row, at = np.arange(len(ends)), ends.copy()
    first = np.concatenate([[0], ends[:-1] + 1])
    while len(row):
        order[row] = at
        going = at > first
        row, at, first = step[row[going]], at[going] - 1, first[going]
    return order


def _strided(sizes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each place of strings of these sizes goes if each string is cut up into ``stride`` strings, of every
    ``stride``-th place, with a separator after each; and the separators' places."""
    grown = sizes + stride
    base = np.cumsum(grown) - grown
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - start[owner]
    turn, q, r = place % stride, sizes // stride, sizes % stride
    to = base[owner] + turn * (q[owner] + 1) + np.minimum(turn, r[owner]) + place // stride
    turns = np.arange(stride)
    ends = base[:, None] + (turns + 1) * (q[:, None] + 1) + np.minimum(turns + 1, r[:, None]) - 1
    return to, ends.ravel()


_SPREAD = np.random.default_rng(20240301).integers(1, 2**63, 1, dtype=np.uint64)[0] * np.uint64(2) + np.uint64(1)


def repeated_windows(shards: list[list[np.ndarray]], depth: int, stride: int = 1) -> list[list[np.ndarray]]:
    """For each string of symbols over 0 of each shard: whether the ``depth`` symbols from each place also start at
    another place of any string of any shard. Places too near to the end for that are left out.

    A transform is over runs of ``stride`` symbols (which divides ``depth``): a string is taken as ``stride``
    strings of such runs, one from each of its first places, so that every place has its suffix and a
    round of the merge settles ``stride`` symbols.
    """
    shards = [[s for s in strings] for strings in shards]
    sized = [np.array([len(s) - stride + 1 for s in strings], dtype=np.int64) for strings in shards]
    runs = []
    for strings, sizes in zip(shards, sized, strict=True):
        if not strings:
            runs.append(np.empty(0, dtype=np.uint64))
            continue
        text = mix(np.concatenate(strings).astype(np.uint64) + np.uint64(1)) if stride > 1 else np.concatenate(strings).astype(np.uint64)
        if stride > 1:
            h = np.zeros(len(text) - stride + 1, dtype=np.uint64)
            for j in range(stride):
                h = h * _SPREAD + text[j : j + len(h)]
            starts = np.cumsum(sizes + stride - 1) - (sizes + stride - 1)
            at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
            text = h[at]
        runs.append(text)
    _, named = np.unique(np.concatenate(runs), return_inverse=True)
    bounds = np.cumsum([0, *[len(r) for r in runs]])
    transforms, places = [], []
    for i, sizes in enumerate(sized):
        if not len(sizes):
            continue
        to, ends = _strided(sizes, stride)
        text = np.zeros(len(to) + len(ends), dtype=np.int64)
        text[to] = named[bounds[i] : bounds[i + 1]] + 1
        transforms.append(transform(text, ends))
        places.append((i, to, ends, sizes))
    shard, common = merge(transforms, depth // stride)
    again = common >= depth // stride
    again[:-1] |= common[1:] >= depth // stride
    out: list[list[np.ndarray]] = [[] for _ in shards]
    for n, (i, to, ends, sizes) in enumerate(places):
        flag = np.empty(len(transforms[n]), dtype=bool)
        flag[_suffix_order(transforms[n], ends)] = again[shard == n]
        out[i] = [f[: len(f) + stride - depth] for f in np.split(flag[to], np.cumsum(sizes)[:-1])]
    return out


def settle(groups: list, before: list[bytes], after: list[bytes], copies: list[int], homes: list[tuple[int, int]], depth: int, stride: int, shards: int) -> list[np.ndarray]:
    """Which windows of each segment start elsewhere too. Segments of one group share an anchor, which is one symbol
    between ``before`` and ``after``. A segment that occurs once is a string of its first home, the shard that it comes
    from; one that occurs more often is a string of its second home also."""
    symbol: dict = {}
    strings: list[list[np.ndarray]] = [[] for _ in range(shards)]
    at = []
    for g, b, a, n, (lo, hi) in zip(groups, before, after, copies, homes, strict=True):
        text = np.empty(len(b) + 1 + len(a), dtype=np.uint32)
        text[: len(b)] = np.frombuffer(b, dtype=np.uint8)
        text[len(b)] = 256 + symbol.setdefault(g, len(symbol))
        text[len(b) + 1 :] = np.frombuffer(a, dtype=np.uint8)
        text += 1
        at.append((lo, len(strings[lo])))
        strings[lo].append(text)
        if n > 1:
            strings[hi].append(text)
    found = repeated_windows(strings, depth, stride)
    return [found[shard][i] for shard, i in at]


def pieces(before: bytes, after: bytes, depth: int, width: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(key, first window, bytes before the anchor, bytes after it) of the pieces of a segment, of ``width`` windows at most: those
    with the anchor ``width`` * j to ``width`` * j + ``width`` - 1 symbols from their start make piece j.

    Equal windows are in pieces of one key, which is a hash of the symbols that all windows of a full piece have. Which
    windows are equal is still open: a window meets its like in pieces with other bytes next to it. Strings of one key differ in
    ``width`` - 1 bytes at each end at most, so with a width of two there are 65,536 of them at most, whatever the table holds.
    """
    least = depth - 1 - len(after)
    for low in range(least // width * width, len(before) + 1, width):
        far, near = min(low + width - 1, len(before)), max(low, least)
        both = before[len(before) - low :] if low > 0 else b""
        yield _content(both, after[: max(0, depth - width - low)]), len(before) - far, before[len(before) - far :], after[: depth - 1 - near]


# ---- the job -----------------------------------------------------------------------------------

_KEYS = ["anchor", "check", "content"]
#: Bytes of segments that are merged at once, or those of one anchor (of one key of its pieces) if it has more: small tables stay in a CPU's cache.
_AT_ONCE = 24 << 10
#: Segments that a task hands on at once, and bytes of a batch that it takes up: a worker keeps what it once needed until it ends.
_ROWS, _BATCH = 4_000, 1 << 20


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Texts with the 128-bit key of their content."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _content(before: bytes, after: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(before + after, seed=len(before)))


def _cut_out(data: np.ndarray, first: int, number: int, at: int, length: int, gram: int) -> tuple[int, bytes, bytes]:
    """(check of the anchor's bytes, bytes before it, bytes after it) of a segment."""
    text = data[first : first + number - 1 + length].tobytes()
    s = at - first
    return _signed(xxhash.xxh3_64_intdigest(text[s : s + gram])), text[:s], text[s + gram :]


def repeated_spans(docs: DataFrame, *, text_col: str = "text", length: int = 400, shards: int = 4, split_over: int = 1024) -> DataFrame:
    """(k1, k2, spans): for each content that has any, the runs of windows (first, last) that start elsewhere too.

    Content is known by its key, so that exact copies are worked out once. What is shuffled is hashes
    of anchors, then the places of those that repeat and, as often as tasks have them, their segments. An
    anchor with more than ``split_over`` different segments would be too much for one task: its segments are
    cut into ``pieces`` of a stride's windows, dealt over many merges by what the windows of a piece have in
    common; where as many pieces have the same in common, those are cut into pieces of two windows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    gram, stride = shape(length)
    depth = length - gram + 1
    long_enough = _keyed(docs, text_col).where(F.octet_length("text") >= length)

    def anchors_only(stream):
        for batch in batches(stream, _BATCH):
            found = [np.repeat(a, np.minimum(times, 2)) for t in batch.column(0) for a, _, _, _, times in segments(_bytes(t), length, gram)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["anchor"])

    hashes = long_enough.select("text").mapInArrow(anchors_only, "anchor long")
    repeated = written(hashes.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    marks = spark.sparkContext.broadcast(filter_bits(repeated, "anchor", bits_for(repeated.count(), most=1 << 27)))

    def passing(text):
        d = _bytes(text)
        for a, f, n, p, times in segments(d, length, gram):
            ok = in_filter(marks.value, a)
            for x, first, number, place, t in zip(a[ok].view(np.int64).tolist(), f[ok].tolist(), n[ok].tolist(), p[ok].tolist(), times[ok].tolist(), strict=True):
                yield x, first, number, t, *_cut_out(d, first, number, place, length, gram)

    def places(stream):
        def told():
            columns = zip(*rows, strict=True) if rows else [[]] * 11
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)], names=["k1", "k2", "home", *_KEYS, "first", "number", "times", "before", "after"])

        rows: list[tuple] = []
        for batch in batches(stream, _BATCH):
            for k1, k2, home, t in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                for x, first, number, times, check, b, a in passing(t):
                    rows.append((k1, k2, home, x, check, _content(b, a), first, number, times, b, a))
                    if len(rows) >= _ROWS:
                        yield told()
                        rows = []
        yield told()

    homed = long_enough.select("k1", "k2", F.pmod("k1", F.lit(shards)).cast("int").alias("home"), "text")
    found = written(homed.mapInArrow(places, "k1 long, k2 long, home int, anchor long, check long, content long, first long, number long, times long, before binary, after binary"), "found")
    placed = written(found.select("k1", "k2", *_KEYS, "first", "number", "times").distinct().join(repeated, "anchor", "left_semi"), "places")
    together = [F.min("home").alias("lo"), F.max("home").alias("hi")]
    segment = ["anchor", "check", "before", "after"]
    kinds = written(found.groupBy(*segment).agg(F.sum("times").alias("copies"), *together), "segments")
    release(found)
    numbers = kinds.groupBy("anchor", "check").agg(F.count("*").alias("kinds"), F.sum("copies").alias("copies")).where("copies > 1")
    # so many that 65,536 anchors at most, whose keys are broadcast, are split
    over = max(split_over, -(-kinds.count() // 65_536))
    split = F.broadcast(written(numbers.where(F.col("kinds") > over).select("anchor", "check", F.lit(True).alias("split")), "split"))
    marked = kinds.join(split, ["anchor", "check"], "left")
    whole = marked.where("split is null").select(*segment, "copies", "lo", "hi", F.lit(0).cast("long").alias("part")).join(numbers.select("anchor", "check"), ["anchor", "check"])
    hot = marked.where("split")

    def cut_up(width):
        def run(stream):
            for batch in batches(stream, _BATCH):
                rows = []
                for x, check, b, a, n, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    rows += [(x, check, first, last, n, lo, hi, key) for key, _, first, last in pieces(b, a, depth, width)]
                columns = zip(*rows, strict=True) if rows else [[]] * 8
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["anchor", "check", "before", "after", "copies", "lo", "hi", "part"])

        return run

    def named(width):
        """The contents of a segment's pieces, by which their runs come back to it, without their bytes."""

        def run(stream):
            for batch in batches(stream, _BATCH):
                rows = []
                for x, check, b, a in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    owner = _content(b, a)
                    rows += [(x, check, owner, at, _content(first, last)) for _, at, first, last in pieces(b, a, depth, width)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=["anchor", "check", "owner", "at", "content"])

        return run

    cuts, strings = [], whole
    for width in sorted({max(2, stride), 2}, reverse=True):
        parts = hot.select(*segment, "copies", "lo", "hi").mapInArrow(cut_up(width), "anchor long, check long, before binary, after binary, copies long, lo int, hi int, part long")
        dealt = written(parts.groupBy(*segment, "part").agg(F.sum("copies").alias("copies"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "pieces")
        cuts.append(hot.select(*segment).mapInArrow(named(width), "anchor long, check long, owner long, at int, content long"))
        if width > 2:
            many = dealt.groupBy("anchor", "check", "part").count().where(F.col("count") > max(split_over, -(-dealt.count() // 65_536)))
            marked = dealt.join(F.broadcast(written(many.select("anchor", "check", "part", F.lit(True).alias("split")), "split")), ["anchor", "check", "part"], "left")
            dealt, hot = marked.where("split is null"), marked.where("split")
        strings = strings.unionByName(dealt.select(whole.columns))
    strings = strings.repartition("anchor", "check", "part").sortWithinPartitions("anchor", "check", "part")

    def settled(stream):
        held: list[tuple] = []
        size = 0

        def out():
            groups = [(h[0], h[1], h[7]) for h in held]
            flags = settle(groups, [h[2] for h in held], [h[3] for h in held], [h[4] for h in held], [(h[5], h[6]) for h in held], depth, stride, shards)
            rows = []
            for (x, check, b, a, _, _, _, _), flag in zip(held, flags, strict=True):
                if flag.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
                    rows.append((x, check, _content(b, a), edges.tolist()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, types, strict=True)], names=[*_KEYS, "runs"])

        for batch in batches(stream, _BATCH):
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > _AT_ONCE and (row[0], row[1], row[7]) != (held[-1][0], held[-1][1], held[-1][7]):
                    yield out()
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) + len(row[3])
        if held:
            yield out()

    merged = written(strings.mapInArrow(settled, "anchor long, check long, content long, runs array<int>"), "merged")
    # pieces are named by their own content: back to the pieces or segments that they were cut from
    runs = merged
    moved = F.transform("runs", lambda edge: edge + F.col("at"))
    for owned in reversed(cuts):
        cut_runs = owned.join(runs, _KEYS).groupBy("anchor", "check", F.col("owner").alias("content")).agg(F.flatten(F.collect_set(moved)).alias("runs"))
        runs = merged.unionByName(cut_runs)
    runs = merged.join(split, ["anchor", "check"], "left").where("split is null").select(*_KEYS, "runs").unionByName(cut_runs)
    occurrences = placed.groupBy(*_KEYS).agg(F.count("*").alias("n"))
    decided = lookup(placed, runs, _KEYS, heavy(occurrences, _KEYS))
    edge = lambda i: F.element_at("runs", i)
    spans = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")), lambda i: F.struct((F.col("first") + edge(2 * i + 1)).cast("int").alias("first"), (F.col("first") + edge(2 * i + 2) - 1).cast("int").alias("last")))
    # segments on end occur twice at least, so all of their windows repeat
    on_end = F.array(F.struct(F.col("first").cast("int").alias("first"), (F.col("first") + F.col("times") * F.col("number") - 1).cast("int").alias("last")))
    return decided.select("k1", "k2", F.explode(F.when(F.col("times") > 1, on_end).otherwise(spans)).alias("span")).groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))


def _bytes(value: pa.Scalar) -> np.ndarray:
    buffer = value.as_buffer()
    return np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.empty(0, dtype=np.uint8)


def cut(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of the bytes, how many go, and in how many runs."""
    out, at, runs, end = [], 0, 0, -1
    for first, last in sorted(spans):
        if first > end:
            runs += 1
        if first >= at:
            out.append(data[at:first])
        at = end = max(at, last + length)
    out.append(data[at:])
    left = b"".join(out)
    return left, len(data) - len(left), runs


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, shards: int = 4, split_over: int = 1024) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes left), with every byte removed that a repeated string of
    ``length`` bytes covers, wherever in the table it repeats.

    Null and short texts lose nothing; exact copies of a text of ``length`` bytes or more lose all of
    it, every one; rows with a null or repeated id are worked on like any other, one row out for each; an
    empty table gives an empty result; further columns aren't read. Texts of any length are read whole, in
    stretches of 2 MB, and what repeats with a short period is held once a stretch. Texts that lose nothing stay where they lie; copies of one text are dealt over many tasks.
    """
    spans = written(repeated_spans(df, text_col=text_col, length=length, shards=shards, split_over=split_over), "spans")
    shared = df.sparkSession.sparkContext.broadcast(filter_bits(spans, "k1", bits_for(spans.count())))
    texts = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("_id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"), "text")

    def touched(stream):
        for batch in stream:
            yield batch.filter(pa.array(in_filter(shared.value, batch.column("k1").to_numpy())))

    def untouched(stream):
        for batch in stream:
            yield batch.filter(pa.array(~in_filter(shared.value, batch.column("k1").to_numpy())))

    keys = ["k1", "k2"]
    copies = _keyed(df, text_col).groupBy(*keys).agg(F.count("*").alias("n"))
    some = lookup(texts.mapInArrow(touched, texts.schema), spans, keys, heavy(copies, keys), "left").select("_id", "text", "spans")

    def run(stream):
        for batch in batches(stream, _BATCH):
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = _bytes(text).tobytes()
                left, gone, n = cut(data, [(s["first"], s["last"]) for s in spans or []], length)
                rows.append((len(data), gone, n, left))
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    schema = df.select(id_col).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)
    none = F.lit(0).cast("long")
    # as they are, without another pass through Python, as a task would then hold two workers
    rest = texts.mapInArrow(untouched, texts.schema).select(F.col("_id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return some.mapInArrow(run, schema).unionByName(rest)


def digest(kept: DataFrame, col: str = "kept") -> DataFrame:
    """The bytes' SHA-256 (lowercase hex) in place of the bytes."""
    return kept.withColumn("kept_sha256", F.sha2(F.col(col), 256)).drop(col)

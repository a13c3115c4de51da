"""The text operators against brute force, on small tables with nulls, copies, ties and odd texts."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import byte_bpe, mixing, pii, quality, queries, simhash, suffix_dedup, token_counts, toxicity

ODD = ["", " ", "  two  spaces ", "tab\tand\nnewline\r\n", "é ü ß 漢字 🙂", "<|endoftext|> a<|endoftext|>", "▁mark ▁", "a" * 3000, "x y\x1cz\x85w​q᠎", "don't we'll 'S 123abc", "\x00nul", "!!!???...", "ab " * 2000]


def docs_frame(spark, texts):
    rows = [(i, t, f"source{i % 3}", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")  # the last two clash with results


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    return [None, *ODD, *real, real[0], real[0]]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts_equal_the_library(spark, texts):
    import sentencepiece

    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for frequent in (0, 50, 32768):
        got = by_id(token_counts.count_tokens(docs_frame(spark, texts), model, frequent=frequent, cached=20, limit=100))
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n = len(sp.encode(t or ""))
            assert (got[i].n_tokens, got[i].over_limit, got[i].n_bytes) == (n, n > 100, len((t or "").encode()))


def test_byte_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    spec = queries.tokenizer_file("byte_bpe_50k.json").decode()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = docs_frame(spark, texts)
    got, ids = by_id(byte_bpe.round_trip(frame, spec, cached=10)), by_id(byte_bpe.encode(frame, spec))
    back = by_id(byte_bpe.decode(byte_bpe.encode(frame, spec), spec))
    for i, t in enumerate(texts):
        want = own.encode(t or "", add_special_tokens=False).ids
        assert ids[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert back[i].text == own.decode(want, skip_special_tokens=False) == (t or "")
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_segment_tree_takes_the_leftmost_lowest_rank():
    rng = random.Random(1)
    rank_of = {a << 17 | b: r for r, (a, b) in enumerate((a, b) for a in range(6) for b in range(6))}
    result = [rng.randrange(6) for _ in rank_of]
    for _ in range(300):
        ids = [rng.randrange(6) for _ in range(rng.randrange(2, 30))]
        want = list(ids)
        while len(want) > 1:
            r, i = min((rank_of[a << 17 | b], i) for i, (a, b) in enumerate(zip(want, want[1:])))
            want[i : i + 2] = [result[r]]
        assert byte_bpe.merge_pairs(list(ids), rank_of, result) == want


def naive_spans(text):
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return [(k, s, e) for k, x in zip(pii.KINDS, (email, ip, card, phone)) for s, e in x]


def test_base_spans_equal_the_patterns(texts):
    rng = random.Random(2)
    pieces = ["a@b.c", "x.y@", "@", "1.2.3.4", "256.1.1.1.7", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (206) 555-7713", "+", " ", ".", "-", "é", "12", "foo", "0000000000000000"]
    for text in [t or "" for t in texts] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]:
        assert pii.base_spans(text) == naive_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "what"),
    [
        ("write to jane.doe (at) mail (dot) example (dot) com today", "email", "jane.doe (at) mail (dot) example (dot) com"),
        ("write to jane at mail dot example dot com today", "email", "jane at mail dot example dot com"),
        ("é jane[at]example.com é", "email", "jane[at]example.com"),
        ("jаne@exаmple.com!", "email", "jаne@exаmple.com"),
        ("jane＠example．com", "email", "jane＠example．com"),
        ("ip 192 dot 168 dot 1 dot 17 up", "ip", "192 dot 168 dot 1 dot 17"),
        ("ip 192[.]168[.]1[.]17 up", "ip", "192[.]168[.]1[.]17"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("card ４１１１ １１１１ １１１１ １１１１ ok", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("call plus one two zero six five five five seven seven one three now", "phone", "plus one two zero six five five five seven seven one three"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, what):
    _, spans = pii.all_spans(text)
    assert (kind, text.index(what), text.index(what) + len(what)) in spans


@pytest.mark.parametrize("text", ["meet me at example.com tomorrow", "one two three, one of five", "Éèque ñado über dot", "look at the dot there"])
def test_prose_gets_no_spans(text):
    assert pii.all_spans(text) == ([], [])


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a b@c.de f", 10, "x"), (2, None, 0, "y"), (None, "", 0, None)], "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.redact_documents(df).collect()}
    assert pii.redact_documents(df).columns == df.columns
    assert out[1].text == "a [EMAIL] f" and out[1].n_chars == 11 and out[2].text is None and out[None].text == ""


def near_reference(texts, words=3):
    prints = []
    for t in texts:
        parts = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(parts[i : i + words]).encode(), seed=42) for i in range(max(1, len(parts) - words + 1))] if parts else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return prints


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark, texts):
    many = [*texts, *[t[:-3] + "abc" for t in texts if t and len(t) > 3000]]
    prints = near_reference(many)
    want = classes(len(many), [(i, j) for i in range(len(many)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = by_id(simhash.near_duplicates(docs_frame(spark, many)))
    assert [got[i].fingerprint for i in range(len(many))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(many))] == want
    kept = simhash.keep_one(docs_frame(spark, many))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs_frame(spark, many).columns


def test_keep_one_decides_by_row(spark):
    rng = random.Random(8)
    one, two, three, four, five, six = (" ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(80)) for _ in range(6))
    rows = [
        (None, one), (None, two), (None, two),  # null ids: a row of each text
        (1, three), (1, four),  # one id on unrelated texts: both
        (2, five), (9, five), (9, six),  # a copy (9) whose id also stands on a kept row: only the row of id 2, and the kept row
        (None, three),  # copies go, null ids too
        (12, None), (11, ""), (11, ""),  # null and empty texts are linked, a repeated row stays once
    ]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, one), (None, two), (1, three), (1, four), (2, five), (9, six), (11, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_multi_index_finds_every_link(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = {b ^ sum(1 << i for i in set(rng.choices(range(64), k=rng.randrange(4)))) for b in base for _ in range(12)} | set(base)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long")).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a in values for b in values if a != b and (a ^ b).bit_count() <= 2}


def repeats_reference(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(d, cover) if not c)
        out.append((len(d), int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split_over", [1024, 4, 1])
def test_repeated_bytes_equal_brute_force(spark, texts, split_over):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    made = [" ".join(rng.choice(shared) if rng.random() < 0.4 else word() for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    many = [*texts, *made, made[0], "ab" * 300, "z" * 41, "z" * 40, "q" * 39]
    length = 40
    out = suffix_dedup.digest(suffix_dedup.remove_repeats(docs_frame(spark, many), length=length, split_over=split_over))
    got = by_id(out)
    want = repeats_reference(many, length)
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(many))] == want


def test_repeated_bytes_of_the_contract(spark, texts):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    made = [("".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(0, 900))) + passage[(i * 37) % 400 : 500 + (i * 53) % 400]) for i in range(25)]
    many = [*texts[:40], *made, passage[:399], passage[:400], "y" * 401, "y" * 399]
    got = by_id(suffix_dedup.digest(suffix_dedup.remove_repeats(docs_frame(spark, many))))
    want = repeats_reference(many, 400)
    assert sum(w[1] for w in want) > 8000
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(many))] == want


@pytest.mark.parametrize("split_over", [1024, 4, 1])
def test_repeats_come_from_the_merge(spark, monkeypatch, split_over):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = [noise(40 + i) for i in range(12)]
    apart = [noise(50) + part + noise(50) for part in shared for _ in range(3)]  # windows repeat, whole segments don't
    many = ["z" * 90, "abc" * 50, "abc" * 50, "unique text that is long enough to hold a window of forty", *apart]
    frame = docs_frame(spark, many)
    gone = lambda: [r.n_removed for r in suffix_dedup.remove_repeats(frame, length=40, split_over=split_over).orderBy("doc_id").collect()]
    want = [w[1] for w in repeats_reference(many, 40)]
    assert gone() == want and all(want[4:])
    windows = lambda b, a, depth: len(b) + len(a) + 2 - depth
    monkeypatch.setattr(suffix_dedup, "settle", lambda groups, before, after, copies, homes, depth, *_: [np.zeros(windows(b, a, depth), dtype=bool) for b, a in zip(before, after, strict=True)])
    assert not any(gone())
    monkeypatch.setattr(suffix_dedup, "settle", lambda groups, before, after, copies, homes, depth, *_: [np.full(windows(b, a, depth), n > 1) for b, a, n in zip(before, after, copies, strict=True)])
    assert sum(gone()[4:]) < sum(want[4:]) - 40


def test_a_task_of_repeats_holds_one_worker(spark, texts):
    """No pass through Python feeds another within a stage, in the tables on the way and in what comes out: a task would hold two workers' memory at once."""
    plans, write = [], suffix_dedup.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(suffix_dedup, "written", lambda df, what: plans.append(df) or write(df, what))
        plans.append(suffix_dedup.remove_repeats(docs_frame(spark, texts), split_over=2))
    for df in plans:
        within: list[tuple[int, bool]] = []  # depth of the nodes above in a stage, and whether they are passes
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            at = len(line) - len(line.lstrip(" :+-"))
            node = line[at:]
            within = [w for w in within if w[0] < at]
            if node.startswith(("Join", "Aggregate", "Repartition", "Sort")):
                within = [(d, False) for d, _ in within]
            assert not (node.startswith("MapInArrow") and any(p for _, p in within)), df._jdf.queryExecution().optimizedPlan().toString()
            within.append((at, node.startswith("MapInArrow")))


def test_pieces_of_a_segment_meet_their_like():
    rng = random.Random(12)
    for depth, width in ((1, 2), (2, 2), (5, 2), (8, 2), (5, 4), (8, 4), (9, 3), (8, 8), (3, 4)):
        keys = {}
        for _ in range(400):
            before, after = (bytes(rng.choices(b"ab", k=rng.randrange(depth))) for _ in range(2))
            if len(before) + len(after) + 1 < depth:
                continue
            seen = []
            for key, first, b, a in suffix_dedup.pieces(before, after, depth, width):
                number = len(b) + len(a) + 2 - depth
                assert 1 <= number <= width
                for i in range(number):
                    window = (b[i:], a[: depth - 1 - len(b) + i])
                    assert window == (before[first + i :], after[: depth - 1 - len(before) + first + i])
                    assert keys.setdefault(window, key) == key
                    seen.append(first + i)
            assert sorted(seen) == list(range(len(before) + len(after) + 2 - depth))


def test_merged_transforms_equal_sorted_suffixes():
    rng = np.random.default_rng(5)
    for shards, depth, stride in ((1, 5, 1), (2, 6, 2), (3, 6, 3), (3, 8, 4), (4, 4, 4)):
        strings = [rng.integers(1, 4, rng.integers(depth, 30)).astype(np.uint32) for _ in range(25)]
        strings += [strings[0], strings[3]]
        seen = Counter(tuple(s[i : i + depth].tolist()) for s in strings for i in range(len(s) - depth + 1))
        dealt = [strings[i::shards] for i in range(shards)]
        for held, flags in zip(dealt, suffix_dedup.repeated_windows(dealt, depth, stride), strict=True):
            for s, flag in zip(held, flags, strict=True):
                assert flag.tolist() == [seen[tuple(s[i : i + depth].tolist())] > 1 for i in range(len(s) - depth + 1)]


def test_gumbel_noise_draws_by_weight(spark):
    """Of two classes of short texts whose weights differ by a factor of e, the heavier is drawn first that much more often."""
    rows = spark.createDataFrame([(i, i % 2, float(i % 2), 1) for i in range(20_000)], "doc_id long, heavy int, log_weight double, n_features long")
    drawn = []
    for seed in (1, 2):
        keyed = quality.gumbel_keys(rows, seed=seed)
        least = quality.kth_greatest(keyed, "gumbel_key", 500)
        picked = keyed.where(F.col("gumbel_key") >= least).collect()
        assert len(picked) == 500
        share = np.mean([r.heavy for r in picked])
        assert abs(share - math.e / (1 + math.e)) < 0.06  # neither all of the heavier, as a cut would give, nor half
        drawn.append({r.doc_id for r in picked})
    assert len(drawn[0] & drawn[1]) < 100


def test_quality_drops_junk_and_keeps_clean(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored, model, _ = quality.importance_resample(docs, labels.where(~held))
    rows = scored.join(labels.where(held), "doc_id").collect()
    good = [r.selected for r in rows if r.quality == 1]
    bad = [r.selected for r in rows if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4  # some hundred labels only
    k = 100
    few = quality.importance_resample(docs, labels, k=k)[0].collect()
    keys = sorted((r.gumbel_key for r in few if r.n_features), reverse=True)
    assert sum(r.selected for r in few) == k and min(r.gumbel_key for r in few if r.selected) == keys[k - 1]


def test_kth_greatest_is_exact(spark):
    values = [0.0, 0.0, 1.5, -2.0, 7.25, 7.25, 1e-300, 1e300, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in range(1, len(values)):
        assert quality.kth_greatest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_quality_without_labels_or_rows(spark, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = by_id(quality.importance_resample(docs_frame(spark, texts), labels)[0])
    assert len(rows) == len(texts) and not rows[0].selected and rows[20].selected
    assert quality.keep_selected(docs_frame(spark, []), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    held = labels.where(~toxicity.training_rows(labels))
    rows = toxicity.score(docs, lexicon).join(held, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02
    matcher = toxicity.Matcher(lexicon)
    assert matcher.score(toxicity.fold("you 1D1OT, you іdiot")) > 0.5 > matcher.score(toxicity.fold("a plain text")) and 0 <= matcher.score([]) < 0.5


def test_exception_phrases_excuse():
    lexicon = toxicity.Lexicon({" scum ": 5.0}, ["pond scum"], -2.0, 1.0)
    matcher = toxicity.Matcher(lexicon)
    assert matcher.hits("the pond scum grew".split()) == {} and matcher.hits("the scum grew".split()) == {4: 5.0}


def fill(budget, children):
    """Shares by repeated proportional rounds."""
    share = {n: 0.0 for n, _, _ in children}
    open_ = {n: (w, cap) for n, w, cap in children if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(w for w, _ in open_.values())
        full = {n for n, (w, cap) in open_.items() if cap <= left * w / total + 1e-12}
        if not full:
            for n, (w, _) in open_.items():
                share[n] = left * w / total
            break
        for n in full:
            share[n] = open_[n][1]
        left = budget - sum(share.values())
        open_ = {n: v for n, v in open_.items() if n not in full}
    return share


def mix_reference(rows, weights, share, epochs, seed):
    """How often each row (id, text, lang, source) is used, in the order of the rows."""
    tokens = lambda t: -(-len((t or "").encode()) // 4)
    number = lambda s: int(s[3:]) if re.fullmatch("src[0-9]+", s or "") else None
    dom = lambda s: "other" if number(s) is None else "crawl" if number(s) == 0 else "reference" if number(s) < 10 else "forum"
    leaf = lambda r: (dom(r[3]), r[2] or "unknown", r[3] or "unknown")
    total = Counter({leaf(r): 0 for r in rows})
    for r in rows:
        total[leaf(r)] += tokens(r[1])
    weigh = lambda level, name: weights[level].get(name, 1.0)
    cap = lambda p: sum(v * epochs for k, v in total.items() if k[: len(p)] == p and all(weigh(level, k[i]) > 0 for i, level in enumerate(("domain", "lang", "source")) if i >= len(p)))
    budgets = {}
    for d, db in fill(sum(total.values()) * share, [(d, weigh("domain", d), cap((d,))) for d in {k[0] for k in total}]).items():
        for lang, lb in fill(db, [(x, weigh("lang", x), cap((d, x))) for x in {k[1] for k in total if k[0] == d}]).items():
            for s, sb in fill(lb, [(k[2], weigh("source", k[2]), total[k] * epochs) for k in total if k[:2] == (d, lang)]).items():
                budgets[d, lang, s] = int(sb + 1e-6)
    times = [0] * len(rows)
    for k, b in budgets.items():
        whole = b // total[k] if total[k] else 0
        rest = b - whole * total[k]
        place = lambda r: hashlib.md5("|".join([str(seed), str(whole), "" if r[0] is None else str(r[0])]).encode()).hexdigest()
        sums = Counter()
        for r in rows:
            if leaf(r) == k:
                sums[place(r)] += tokens(r[1])
        run, upto = 0, {}
        for p in sorted(sums):
            run += sums[p]
            upto[p] = run
        for n, r in enumerate(rows):
            if leaf(r) == k:
                times[n] = whole + (upto[place(r)] <= rest)
    return times


@pytest.mark.parametrize(("share", "none"), [(1.2, {}), (0.5, {"lang": "de", "source": "src1"}), (2.5, {"domain": "forum"})])
def test_mixing_equals_brute_force(spark, share, none):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(0, 400) if i % 50 else None, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", "src11", None])) for i in range(900)] + [(5, "x" * 9, "en", "src0")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"times": F.lit(1), "_row": F.lit(2), "n": F.lit(3)})
    weights = {level: names | ({none[level]: 0.0} if level in none else {}) for level, names in queries.WEIGHTS.items()}
    options = queries.mix_options() | {"budget": share, "max_epochs": 3, "weights": weights}
    got = mixing.mix(df, **options).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], t) for r, t in zip(rows, mix_reference(rows, weights, share, 3, queries.SEED), strict=True))
    assert Counter((r.doc_id, r.times) for r in got) == want
    out = mixing.mixed_documents(df, **options)
    assert out.columns == df.columns and out.count() == sum(r.times for r in got)


def test_mixing_takes_real_token_counts(spark):
    df = spark.createDataFrame([(i, "x", "en", "src0", 10 * i) for i in range(5)], "doc_id long, text string, lang string, source string, counted int")
    assert sum(r.n_tokens for r in mixing.mix(df, **queries.mix_options(), tokens=F.col("counted")).collect()) == 100


@pytest.mark.parametrize("unit", [" ", "( ", "a dot ", "x at y dot com ", "@ ", "1 ", "one ", "a_at_"])
def test_personal_data_of_a_megabyte(unit):
    began = time.perf_counter()
    pii.all_spans((unit * (1_000_000 // len(unit) + 1))[:1_000_000])
    assert time.perf_counter() - began < 20


def test_many_excused_phrases_take_linear_time():
    matcher = toxicity.Matcher(toxicity.Lexicon({" scum ": 5.0}, ["pond scum"], -2.0, 1.0))
    began = time.perf_counter()
    assert matcher.hits(["pond", "scum"] * 100_000 + ["scum"]) == {1_000_000: 5.0}
    assert time.perf_counter() - began < 20


def test_toxicity_of_odd_rows(spark):
    docs = docs_frame(spark, [None, "", "x" * 1_000_000, "a", "a"]).withColumn("score", F.lit(3)).unionByName(docs_frame(spark, ["no id"]).withColumns({"doc_id": F.lit(None).cast("long"), "score": F.lit(3)}))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, labels)).withColumn("held_out", ~toxicity.training_rows(docs)).collect()
    assert len(rows) == 6 and all(r.held_out is not None and 0 <= r.score < 0.5 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_clashing_columns_and_repeated_rows(spark, texts):
    extra = {c: F.lit(1) for c in ("_h", "_both", "_row", "_id", "_text", "_label", "log_weight", "n_features", "_kept", "hash", "fp", "anchor", "n", "times", "key")}
    docs = docs_frame(spark, [*texts, "a" * 1_000_000]).withColumns({"lang": F.lit("en"), "source": F.lit("src1"), **extra})
    docs = docs.unionByName(docs.where("doc_id > 70"))
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(len(texts))], "doc_id long, quality int")
    kept = quality.keep_selected(docs, labels)
    one = simhash.keep_one(docs)
    assert kept.columns == one.columns == docs.columns and 0 < kept.count() <= docs.count()
    ids = [r.doc_id for r in one.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert suffix_dedup.remove_repeats(docs).count() == docs.count() == pii.redact_documents(docs).count()


def test_empty_tables(spark):
    none = docs_frame(spark, []).withColumns({"lang": F.lit("en"), "source": F.lit("src1")})
    model, spec = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("byte_bpe_50k.json").decode()
    frames = [token_counts.count_tokens(none, model), byte_bpe.round_trip(none, spec), pii.find_personal_data(none), simhash.near_duplicates(none), suffix_dedup.remove_repeats(none), mixing.mix(none, **queries.mix_options())]
    assert [f.count() for f in frames] == [0] * len(frames)

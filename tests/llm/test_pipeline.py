"""The five stages against a plain Python twin, on a small table with nulls, copies and repeated rows."""

import hashlib
import struct
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tests.llm.test_text_ops import mix_reference

import corpus_pipeline
from glyphmill.llm import pii, quality, queries, simhash

LONG = 1 << 64


def signed(h):
    return h - LONG if h >= LONG // 2 else h


def spark_hash(*values):
    """Spark's xxhash64 of ints, longs (as a pair) and texts."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(data, seed=h % LONG)
    return signed(h)


def quality_twin(docs, labels):
    label = {}
    for i, q in labels:
        label[i] = max(q, label.get(i, q))
    fit = {i: spark_hash(4, (i,)) % 4 > 0 for i in label}
    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    grams = [quality.features(d[1] or "", quality.BUCKETS) for d in docs]
    for d, f in zip(docs, grams, strict=True):
        for x in f:
            raw[x] += 1
            good[x] += fit.get(d[0], False) and label[d[0]] == 1
    weights = quality.log_ratios(raw, good)
    weight = [weights[f].sum() if len(f) else 0.0 for f in grams]
    seen = [(w, label[d[0]]) for d, f, w in zip(docs, grams, weight, strict=True) if len(f) and d[0] in label and not fit[d[0]]]
    bias, slope = quality.logistic_fit(np.arcsinh([w for w, _ in seen]), np.array([q for _, q in seen]))
    k = round(sum(1 / (1 + np.exp(-(bias + slope * np.arcsinh(w)))) for f, w in zip(grams, weight, strict=True) if len(f)))
    noise = lambda i: -np.log(-np.log(((spark_hash(7, str(i)) if i is not None else spark_hash(7)) % (1 << 52) + 0.5) / (1 << 52)))
    keys = [w + noise(d[0]) if len(f) else -np.inf for d, f, w in zip(docs, grams, weight, strict=True)]
    least = sorted(keys, reverse=True)[k - 1]
    return [d for d, f, key in zip(docs, grams, keys, strict=True) if len(f) and key >= least]


def simhash_twin(docs):
    prints = [simhash.fingerprint(d[1] or "") % LONG for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    members = defaultdict(list)
    for d, g in zip(docs, group, strict=True):
        members[g].append((d[0] is None, d[0] or 0, hashlib.md5((d[1] or "").encode()).digest(), d))
    return [min(m, key=lambda r: r[:3])[3] for m in members.values()]


def test_pipeline_equals_brute_force(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    texts = [d[1] for d in docs if d[1]]
    docs += [(None, texts[3], "en", "src1", 1), (9001, None, "en", "src0", None), (9002, "", None, None, 0), (9003, texts[5], None, "src2", 2), (9003, texts[5], None, "src2", 2), (9004, texts[7] + " mail a@b.org", "de", "src12", 1)]
    docs += [(None, texts[8] + " and words of no other text", "fr", "src3", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())

    kept = [(i, pii.redact(t), lang, source) for i, t, lang, source, _ in simhash_twin(quality_twin(docs, labels))]
    times = mix_reference(kept, queries.WEIGHTS, queries.BUDGET, queries.EPOCHS, queries.SEED)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for (i, text, _, _), n in zip(kept, times, strict=True):
        ids = own.encode(text, add_special_tokens=False).ids
        if n:
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert 20 < len(kept) < len(docs) and sum(want.values()) > 20
    assert got == want


def test_empty_tables_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_keeps_few_tokens():
    from glyphmill.llm import quality

    own = quality.features("again and again", 1 << 15)
    for i in range(300):
        quality.features(" ".join(f"t{i}x{j}" for j in range(1000)), 1 << 15)
    assert len(quality._known) <= 51_001
    assert (quality.features("again and again", 1 << 15) == own).all()

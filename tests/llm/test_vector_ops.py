"""The vector operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import ann, embed_dedup, queries


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((150, 24))
    near = np.repeat(base[:20], 6, axis=0) + 0.05 * rng.standard_normal((120, 24))
    vectors = [*base.tolist(), *near.tolist(), *[base[0].tolist()] * 5, (3 * base[1]).tolist()]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    odd = [None, [], [0.0] * 24, [math.nan] + [1.0] * 23, [math.inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0] * 7, [1.0] * 7]
    return rows + [(len(rows) + i, v, 0) for i, v in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicates_equal_brute_force(spark, rows):
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame(spark, rows)).collect()}
    ok = [(i, np.array(v, float)) for i, v, _ in rows if usable(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v in ok:
        for j, u in ok:
            if i < j and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    least = {i: i for i in links}
    for _ in links:
        least = {i: min([least[i], *[least[j] for j in links[i]]]) for i in links}
    assert sum(map(len, links.values())) > 300
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (len(links[i]), least[i], least[i] == i) for i in links}


def test_crowded_cells_are_dealt_over_salts(spark, rows):
    vectors = embed_dedup.distinct_vectors(frame(spark, rows), "vec_id", "embedding").withColumn("key", F.unhex("key")).cache()
    counted = lambda per_task: {bytes(r.key): r.n for r in embed_dedup.links(vectors, 0.95, per_task=per_task).where("links is not null").groupBy("key").agg(F.sum("links").alias("n")).collect()}
    whole = counted(8192)
    assert whole and whole == counted(3)


def test_a_dense_cluster_makes_no_pairs(spark):
    rng = np.random.default_rng(2)
    dense = rng.standard_normal(16) + 0.02 * rng.standard_normal((400, 16))
    vectors = embed_dedup.distinct_vectors(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(dense)]), "vec_id", "embedding").withColumn("key", F.unhex("key"))
    found = embed_dedup.links(vectors, 0.95)
    assert found.count() < 400 * 40 and found.agg(F.sum("links")).first()[0] == 400 * 399


@pytest.mark.parametrize("case", ["one long", "uneven", "huge", "tiny"])
def test_recall_with_uneven_norms(spark, case):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if case == "one long":
        x[7] *= 10
    elif case == "uneven":
        x *= rng.uniform(1, 100, (600, 1))
    elif case == "huge":
        x[7, 3] = 1e160
    else:
        x[5:100] *= 1e-170
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), factor=queries.ANN_FACTOR, shard_rows=100, leaf=16).collect()
    right = 0
    for q in range(0, 600, 20):
        s = x @ x[q]
        right += len({r.vec_id for r in got if r.query_id == q} & set([i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]))
    assert right / (30 * 20) >= 0.9


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (20, [1.0, 0.1]), (20, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS key", "2 AS vector", "3 AS rank", "4 AS query")
    got = embed_dedup.near_duplicates(df).collect()
    assert sorted(r.n_links for r in got) == [0, 4, 4, 4, 4, 4] and {r.component_id for r in got} == {1}
    found = ann.nearest(df, df.where("vec_id = 20")).collect()
    assert len(found) == 8 and [r.vec_id for r in sorted(found, key=lambda r: r["rank"])][:2] == [1, 1]


@pytest.mark.parametrize("factor", [1.0, 1.2])
def test_nearest_neighbours(spark, rows, factor):
    df = frame(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 5 = 0"), k=7, factor=factor, shard_rows=60, query_rows=16, leaf=8).collect()
    ok = {i: np.array(v, float) for i, v, _ in rows if usable(v)}
    right = total = 0
    for q in [i for i in ok if i % 5 == 0]:
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r.rank)
        scores = sorted(((float(ok[q] @ v), -i) for i, v in ok.items() if i != q and len(v) == len(ok[q])), reverse=True)[:7]
        assert [r.rank for r in mine] == list(range(1, len(scores) + 1))
        assert all(abs(r.score - float(ok[q] @ ok[r.vec_id])) < 1e-9 for r in mine)
        right += len({r.vec_id for r in mine} & {-i for _, i in scores})
        total += len(scores)
        if factor == 1.0:
            assert np.allclose([r.score for r in mine], [s for s, _ in scores], atol=1e-9)
    assert right / total >= (0.99 if factor == 1.0 else 0.9)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert embed_dedup.near_duplicates(none).count() == 0 and ann.nearest(none, none).count() == 0


def test_wide_vectors_are_dealt_by_bytes(spark):
    assert ann._rows(64, 16384) == 16384 and ann._rows(64, 65536) == 65536 and ann._rows(4096, 65536) == 1024 and ann._rows(1 << 30, 65536) == 64
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((1500, 4096)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    wide = vectors.astype(np.float64)
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 1500, 100):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        assert [i for _, i in sorted(found[q])] == np.argsort(-scores, kind="stable")[:5].tolist()

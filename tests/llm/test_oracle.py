"""The SQL twins on small tables with what the driver's smallest ones lack: links, nulls, repeats within a text."""

import math

import duckdb
import numpy as np
import pytest

from glyphmill.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefgh éß中"), n))
    passage, copy = word(700), word(900)
    texts = [None, "", "short", word(399), copy, copy, word(50) + passage + word(80), passage + word(10), passage[:300] + word(400), "ab" * 500, *[word(int(n)) for n in rng.integers(1, 3000, 40)]]
    docs = [(i, t, [None, "en", "de", "xx"][i % 4], [None, "src0", "src3", "src12", "blog"][i % 5], 0) for i, t in enumerate(texts)] + [(None, copy, "en", "src0", 0)]
    base = rng.standard_normal((60, 16))
    vectors = [*base.tolist(), *(base[:15].repeat(4, axis=0) + 0.05 * rng.standard_normal((60, 16))).tolist(), *[base[0].tolist()] * 4, (2 * base[1]).tolist()]
    odd = [None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 5, [1.0] * 5]
    vectors = [(i, v, 0) for i, v in enumerate([*vectors, *odd])]
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, rows, schema in (("documents", docs, DOCS), ("embeddings", vectors, "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_says_the_same(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet/*.parquet'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall(), key=repr)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == want
    if name.startswith("op4"):
        assert sum(r[columns.index("n_links")] for r in want) > 100

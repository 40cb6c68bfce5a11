"""The pipeline's stages, one after another, against what they should keep."""

from collections import Counter

import brute
import duckdb
import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], FOLDER).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [[tuple(r) for r in frame.collect()] for frame in out]


def test_stages(stages):
    docs, language, exact, near, mixed, packed = stages
    assert [r[0] for r in sorted(language)] == [r[0] for r in sorted(docs) if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in language:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())
    assert sorted(r[0] for r in near) == sorted(g[0] for g in brute.near_groups([r[:4] for r in exact]) if g[0] == g[2])
    count = Counter(r[0] for r in mixed)
    assert set(count) <= {r[0] for r in near} and max(count.values()) <= 2 and {r[:2] for r in mixed} <= {r[:2] for r in near}
    size = Counter()
    for r in near:
        size[r[3]] += len(brute.words(r[1]))
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len(brute.words(r[1]))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.2)
    assert Counter(r[0] for r in packed if r[1] == 0) == count


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, FOLDER).count() == len(stages[-1])


def test_sql_twins(spark):
    """The operators that SQL can express, on the smallest tables."""
    from lakescope.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, FOLDER)
        want = con.sql(sql)
        columns = sorted(got.columns)
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall())), name

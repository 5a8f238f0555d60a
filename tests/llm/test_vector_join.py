"""The metric join against all pairs, with hot cells, equal vectors and vectors that are none."""

import math
import random

import numpy as np
import pytest

from tests.oracle import compare
from tracewell.llm import queries, vector_join
from tracewell.llm.vector_join import near_vectors

SCHEMA = "vec_id long, embedding array<double>"


def vectors(seed, dim=6, n=150):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    near = base[r.integers(0, n, n)] + r.normal(size=(n, dim)) * r.uniform(0, 0.5, size=(n, 1))
    crowd = base[0] + r.normal(size=(n, dim)) * 0.15  # many near copies of one vector
    out = np.concatenate([base, near, crowd, base[:5], base[:5] * 3.5])
    return [(i, x.tolist()) for i, x in enumerate(out)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, least=0.9):
    n = len(rows)
    links = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = ([math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for v in (a, b))
                if math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b)) >= least:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least_id, least_id == rows[i][0]))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA, **more):
    return sorted(map(tuple, near_vectors(spark.createDataFrame(rows, schema), **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [4_096, 40])
def test_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)  # 40: the crowd's cell is dealt into blocks
    for seed, dim in ((1, 6),):
        rows = vectors(seed, dim, 100)
        assert run(spark, rows) == brute(rows)


def test_limit_itself_is_a_link(spark):
    rows = [(1, [10.0, 0.0, 0.0, 0.0, 0.0]), (2, [9.0, 4.0, 1.0, 1.0, 1.0]), (3, [8.999999, 4.0, 1.0, 1.0, 1.0])]  # 9 * 10 / (10 * 10)
    assert run(spark, rows) == brute(rows) and (2, 2, 1, False) in run(spark, rows)


def test_no_vector_ties_and_ids(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, -inf]),
        (8, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, -1.0]),
        (11, [1e300, 0.0]), (12, [1e-300, 0.0]), (13, [-0.0, 5.0]), (14, [0.0, 5.0]), (None, None),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_all_vectors_equal(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)]
    assert run(spark, rows) == sorted([(i, 299, 0, i == 0) for i in range(300)], key=repr)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0], "x", 9, 4.0), (2, [2.0], None, 9, 5.0)], "key long, v array<float>, vec_id string, n_links int, near_vector double")
    got = near_vectors(df, ids="key", vector="v")
    assert got.columns == ["key", "v", "vec_id", "near_vector", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == [(1, [1.0], "x", 4.0, 1, 1, True), (2, [2.0], None, 5.0, 1, 1, False)]


def test_whole_query_against_matrix(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x = np.array([r["embedding"] for r in rows], float)
    # copies beside the given vectors, so that there is something to find
    r = random.Random(3)
    extra = [(10_000 + i, (x[r.randrange(50)] + np.random.default_rng(i).normal(size=x.shape[1]) * 0.04).tolist()) for i in range(200)]
    rows = [(row["vec_id"], [float(v) for v in row["embedding"]]) for row in rows] + extra
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1)[:, None]
    degree = dict(zip((i for i, _ in rows), ((m @ m.T) >= 0.9).sum(axis=1) - 1))
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == degree and sum(degree.values()) > 400


def test_twin(spark):
    compare(spark, queries.QUERIES["op13_metric_cells"], queries.ORACLES["op13_metric_cells"], "sf0.01")

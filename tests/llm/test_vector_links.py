"""Links between vectors against all pairs."""

import numpy as np
import pytest
from llm_tables import *  # noqa: F403
from pyspark.sql import functions as F

from glossmill.llm.vector_links import COSINE, MISS, linked_vectors, plan_tables

SCHEMA = "vec_id long, embedding array<float>, label int"


def model(rows, cosine=COSINE):
    """(vec_id, n_links, component_id, kept) from all pairs."""
    good = [r[1] is not None and len(r[1]) > 0 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if g else None for r, g in zip(rows, good)]
    near = [[j for j in range(len(rows)) if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
            for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out, key=str)


def ours(spark, rows, **parameters):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in linked_vectors(df, **parameters).collect()), key=str)


def clusters(seed, groups, size, spread, dim=16, start=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        rows += [centre / np.linalg.norm(centre) + rng.standard_normal(dim) * spread / dim**0.5 for _ in range(size)]
    return [(start + i, v.astype(np.float32)) for i, v in enumerate(rows)]


@pytest.mark.parametrize("parameters", [{}, {"bucket": 4, "crowd": 8}])
def test_equals_all_pairs(spark, parameters):
    """Groups around the threshold; small buckets and chunks give the same as one bucket."""
    rows = clusters(1, 12, 25, 0.25) + clusters(2, 60, 1, 0, start=1000)
    expected = model(rows)
    assert 200 < sum(r[1] for r in expected) and any(r[1] == 0 for r in expected)
    assert ours(spark, rows, miss=1e-9, **parameters) == expected


def test_a_crowded_group_is_counted_once_in_chunks(spark):
    rows = clusters(3, 1, 300, 0.1) + clusters(4, 30, 1, 0, start=1000)
    expected = model(rows)
    assert max(r[1] for r in expected) == 299
    assert ours(spark, rows, bucket=4, crowd=32, miss=1e-9) == expected


def test_awkward_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1, 0, 0]), (2, [1, 0, 0]), (2, [1, 0, 0]), (None, [1, 0, 0.1]), (3, None), (4, []), (5, [0, 0, 0]), (6, [nan, 1, 0]),
            (7, [inf, 1, 0]), (8, [None, 1, 0]), (9, [2, 0, 0]), (10, [1, 0]), (11, [-1, 0, 0]), (12, [1e30, 0, 0]), (13, [1e-38, 0, 0]),
            (None, [0, 1, 0]), (14, [0, 0, 1, 0] * 500), (15, [0, 0, 1, 0] * 500), (9, [0, 5, 0])]
    assert ours(spark, rows) == model(rows)


def test_the_threshold_itself_links(spark):
    rows = [(1, [1, 0, 0]), (2, [0.75, 1, 0])]  # cosine of exactly 0.6 by lengths 1 and 1.25
    assert [r[1] for r in ours(spark, rows, cosine=0.6)] == [1, 1]
    assert [r[1] for r in ours(spark, rows, cosine=0.6 + 1e-12)] == [0, 0]


def test_no_rows_and_columns_of_taken_names(spark):
    assert ours(spark, []) == []
    rows = clusters(5, 3, 5, 0.1)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in rows], SCHEMA)
    named = df.withColumns({c: F.lit("x") for c in ("k1", "ok", "node", "vector", "w", "n_links", "component_id", "kept")})
    assert sorted(map(tuple, linked_vectors(named).collect()), key=str) == model(rows)


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1, 2, 3]) for i in range(500)] + [(1000, [3, -2, 1])]
    assert ours(spark, rows) == model(rows)


def test_tables_hold_the_share_of_missed_links():
    for n in (1, 10**4, 10**6, 10**9):
        bits, tables = plan_tables(n)
        same = (1 - np.arccos(COSINE) / np.pi) ** bits
        assert (1 - same) ** tables <= MISS and n / 2**bits <= 2 * 2048

"""Pair moments against numpy on the rows themselves."""

import math

import numpy as np
import pytest

from plumbline.operators import pairs as Q


def with_gaps(rng, rows, cols):
    x = rng.normal(size=(rows, cols)) @ rng.normal(size=(cols, cols)) + 10.0 ** rng.integers(0, 9, cols)
    known = rng.random((rows, cols)) > 0.2
    return x, known


def direct(x, known, a, b):
    both = known[:, a] & known[:, b]
    u, v = x[both, a], x[both, b]
    u, v = u - u.mean(), v - v.mean()
    return (u @ v) / math.sqrt((u @ u) * (v @ v))


def test_states_add_up_in_any_grouping():
    rng = np.random.default_rng(3)
    x, known = with_gaps(rng, 900, 5)
    known[:40] = True
    filled = np.where(known, x, 0.0)
    cuts = [0, 1, 40, 300, 301, 900]  # one part has no gap, two have a single row
    parts = [Q.Moments.of(filled[i:j], known[i:j], filled[i:j], known[i:j]) for i, j in zip(cuts, cuts[1:])]
    forward = parts[0] + parts[1] + parts[2] + parts[3] + parts[4]
    backward = (parts[4] + (parts[3] + parts[2])) + (parts[1] + parts[0])
    for total in (forward, backward):
        for a in range(5):
            for b in range(5):
                r = total.prod[a, b] / math.sqrt(total.sq_a[a, b] * total.sq_b[a, b])
                assert r == pytest.approx(direct(x, known, a, b), abs=1e-7)
                assert total.n[a, b] == (known[:, a] & known[:, b]).sum()


@pytest.mark.parametrize("block", [2, 500])
def test_pairs_of_blocks_nulls_and_odd_values(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = np.random.default_rng(5)
    x, known = with_gaps(rng, 400, 4)
    rows = [(*[float(v) if k else None for v, k in zip(r, ok)], 7.1, None, float("nan") if i == 3 else float(i), 2**53 + i)
            for i, (r, ok) in enumerate(zip(x, known))]
    df = spark.createDataFrame(rows, "`a.b` double, b double, c double, d double, flat double, gone double, odd double, big long").repartition(5)
    got = {(r.column_a, r.column_b): r.r for r in Q.pair_correlations(df, df.columns).collect()}
    names = df.columns
    assert len(got) == 28 and set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for i in range(4):
        for j in range(i + 1, 4):
            assert got[names[i], names[j]] == pytest.approx(direct(x, known, i, j), abs=1e-7)
    assert all(v is None for pair, v in got.items() if set(pair) & {"flat", "gone", "odd"})
    empty = Q.pair_correlations(df.filter("b > 1e300"), df.columns)
    assert empty.count() == 0


def test_one_scan_for_a_hundred_columns(spark):
    df = spark.range(50).selectExpr(*[f"CASE WHEN id % {i + 2} > 0 THEN sin(id * {i + 1}) END AS c{i}" for i in range(100)])
    out = Q.pair_correlations(df, df.columns)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange") == 2
    assert out.count() == 4950

"""p-values, class selection and codes from other folds against direct definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import scores as S
from plumbline.operators import features as X
from plumbline.operators.sampling import hash_number

# Upper critical points of chi-squared from printed tables (statistic, degrees of freedom, tail).
TABLE = [(3.841458820694124, 1, 0.05), (6.6348966010212145, 1, 0.01), (5.991464547107979, 2, 0.05), (11.34486673014437, 3, 0.01),
         (15.08627246938899, 5, 0.01), (18.307038053275146, 10, 0.05), (3.940299136096, 10, 0.95), (124.34211340400407, 100, 0.05)]


def test_chi_squared_tail(spark):
    far = [(1000.0, 4), (0.0, 3), (2.0, 0), (1e-9, 1), (500.0, 400)]
    rows = [(i, x, d) for i, (x, d) in enumerate([r[:2] for r in TABLE] + far)] + [(100, None, 3), (101, 3.0, None)]
    df = spark.createDataFrame(rows, "i int, x double, d int")
    got = {r.i: r.p for r in df.select("i", S.chi2_p_value(F.col("x"), F.col("d")).alias("p")).collect()}
    for i, (_, _, want) in enumerate(TABLE):
        assert got[i] == pytest.approx(want, abs=1e-9)
    base = len(TABLE)
    assert got[base] == pytest.approx(math.exp(-500) * 501, rel=1e-6) and got[base + 1] == 1.0 and got[base + 2] is None
    assert got[base + 3] == pytest.approx(math.erfc(math.sqrt(5e-10)), abs=1e-9)
    # an even number of degrees has a finite sum
    want = sum(math.exp(i * math.log(250) - 250 - math.lgamma(i + 1)) for i in range(200))
    assert got[base + 4] == pytest.approx(want, rel=1e-9) and got[100] is None and got[101] is None


def test_log_gamma(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 2.5, 37.25, 1e6)], "a double")
    for r in df.select("a", S.log_gamma(F.col("a")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.a), rel=1e-13, abs=1e-11)


def test_class_scores_against_counts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(c), None if rng.random() < 0.1 else "xy"[int(c == 1 or rng.random() < 0.3)], float(rng.normal()) if i % 9 else float("nan"), 5, None if i % 50 == 0 else int(c))
            for i, c in enumerate(rng.integers(0, 3, 500))]
    df = spark.createDataFrame(rows, "id long, `same.as` string, told string, noise double, flat int, y int")
    got = {r.column: r for r in X.class_scores(df, "y", ["same.as", "told", "noise", "flat"]).collect()}
    kept = [r for r in rows if r[5] is not None]
    n = len(kept)

    def direct(values):
        joint, vs, cs = {}, {}, {}
        for v, r in zip(values, kept):
            joint[v, r[5]] = joint.get((v, r[5]), 0) + 1
            vs[v], cs[r[5]] = vs.get(v, 0) + 1, cs.get(r[5], 0) + 1
        info = sum(m / n * math.log(m * n / (vs[v] * cs[c])) for (v, c), m in joint.items())
        chi = sum((joint.get((v, c), 0) - vs[v] * cs[c] / n) ** 2 / (vs[v] * cs[c] / n) for v in vs for c in cs)
        return info, chi, (len(vs) - 1) * (len(cs) - 1)

    numbers = [r[3] for r in kept if not math.isnan(r[3])]
    low, width = min(numbers), (max(numbers) - min(numbers)) / 10
    for c, values in (("same.as", [r[1] for r in kept]), ("told", [r[2] for r in kept]), ("flat", [0] * n),
                      ("noise", [None if math.isnan(r[3]) else min(9, math.floor((r[3] - low) / width)) for r in kept])):
        info, chi, dof = direct(values)
        assert got[c].mutual_information == pytest.approx(info, abs=1e-9) and got[c].statistic == pytest.approx(chi, abs=1e-6) and got[c].dof == dof
    assert got["flat"].p_value is None and got["told"].p_value < 1e-6 < got["noise"].p_value
    assert [r.column for r in X.select_for_class(df, "y", 3, ["same.as", "told", "noise", "flat"], alpha=1e-4).collect()] == ["same.as", "told"]
    assert X.class_scores(df.limit(0), "y").count() == 0 and X.class_scores(df, "y", []).count() == 0


def auc(codes, labels):
    order = np.argsort(codes, kind="stable")
    codes, labels = np.asarray(codes)[order], np.asarray(labels)[order]
    at = [(np.searchsorted(codes, v) + np.searchsorted(codes, v, "right") + 1) / 2 for v in codes]
    pos = labels.sum()
    return (sum(a for a, y in zip(at, labels) if y) - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_codes_from_other_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 40 == 7 else f"k{rng.integers(0, 400)}", f"g{i % 3}", None if i % 60 == 0 else float(rng.integers(0, 2)), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, `many.k` string, few string, y double, _fold string").repartition(3)
    out = X.out_of_fold_target(df, ["many.k", "few"], "y", ["id"], smoothing=1.0)
    assert out.columns == [*df.columns, "target__many.k", "target__few"]
    got = {r["id"]: r for r in out.collect()}
    fold = {r["id"]: r["f"] for r in df.select("id", (hash_number(["id"]) % 5).alias("f")).collect()}
    assert len(got) == 2000
    for i, k, g, _, _ in rows[::37]:
        others = [r for r in rows if fold[r[0]] != fold[i] and r[3] is not None]
        mean = sum(r[3] for r in others) / len(others)
        for name, at, value in (("target__many.k", 1, k), ("target__few", 2, g)):
            same = [r[3] for r in others if r[at] == value]
            assert got[i][name] == pytest.approx((sum(same) + mean) / (len(same) + 1), abs=1e-9)
    known = [r for r in rows if r[3] is not None]
    labels = [int(r[3]) for r in known]
    plain = {r["value"]: r["code"] for r in X.fit_features(df, X.FeaturePlan("y", [], categorical=["many.k"], encoding="target", smoothing=1.0)).lookups["many.k"].collect()}
    assert auc([plain[r[1] or "missing"] for r in known], labels) > 0.65  # a row's own target leaks
    assert abs(auc([got[r[0]]["target__many.k"] for r in known], labels) - 0.5) < 0.06
    with pytest.raises(ValueError):
        X.out_of_fold_target(df, ["few"], "y", ["id"], folds=1)
    assert X.out_of_fold_target(df.limit(0), ["few"], "y", ["id"]).count() == 0

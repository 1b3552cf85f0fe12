"""Registered queries on rows made here."""

import duckdb

from checks.registry import CHECKS


def test_file_rules_of_pages_longer_than_a_32_bit_size(spark, tmp_path):
    """60,000 letters make a size of 2.4 thousand million bytes."""
    rows = [(i, f"http://e.com/{i}", "x" * n) for i, n in enumerate([10, 60_000, 2_621, 2_622, 60_001, 0, 70_000])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    run, sql = CHECKS["file_rules_quarantine"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, run(spark, str(tmp_path)).collect()))
    assert got == sorted(duck.execute(sql).fetchall()) and sum("size" in failed for _, failed in got) == 4


def test_trial_history_trains_every_trial_in_every_fold(spark, tmp_path, monkeypatch):
    """The history holds the trained search's trials as well as those of the ridge search."""
    from checks import drifting
    asked = []

    def automl(df, features, target, key, config):
        asked.append((config, df.filter("n_chars is null or words is null").count()))
        tried = [(i, p, 0.5) for i, p in enumerate(drifting.ML.draw_trials(config))]
        return drifting.ML.AutoMLResult(None, {}, 0.5, drifting.ML._history(spark, tried), None, None)

    monkeypatch.setattr(drifting.ML, "automl", automl)
    lines = [(k, 10.0 + k * k % 7, 100.0 + k * k % 11) for k in range(1, 200)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, None, None, None), (2, "a b", "en", 3)], "doc_id bigint, text string, lang string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    run, sql = CHECKS["trial_history_30"]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = run(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.execute(sql).fetchall()))
    assert [(c.trials, c.folds, c.algorithms, nulls) for c, nulls in asked] == [(30, 5, ["logistic", "random_forest"], 0)]


def test_trial_history_draws_from_the_documented_space():
    """50 to 300 trees of depth 3 to 10 on parts of rows and features, not a few small ones."""
    from checks import drifting
    from plumbline.operators import model as ML
    config = drifting._tree_search()
    assert config.space == ML.SEARCH_SPACE and (config.trials, config.folds) == (30, 5)
    for p in ML.draw_trials(config):
        assert set(p) == {"algorithm", *ML.SEARCH_SPACE}
        assert all(low <= p[name] <= high for name, (_, low, high) in ML.SEARCH_SPACE.items())
    forests = [p for p in ML.draw_trials(config) if p["algorithm"] == "random_forest"]
    assert len(forests) == 15 and max(p["n_estimators"] for p in forests) > 200 and max(p["max_depth"] for p in forests) > 8

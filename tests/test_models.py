"""Training helpers and diagnostics on small frames."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.models import diagnostics as D
from skyledger.models import training as T
from skyledger.models import trees
from skyledger.operators import cleaning as C
from skyledger.operators import scenario as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 600
    x, y = rng.normal(size=n), rng.normal(size=n)
    score = x + 0.1 * rng.normal(size=n)
    label = pd.cut(score, [-9, -0.5, 0.5, 1.2, 9], labels=K.RISK_CLASSES).astype(str)
    pdf = pd.DataFrame({"x": x, "y": y, "target": 3 * x - y, "label_text": label, "year": rng.integers(2015, 2025, n), "month": 6, "k": range(n)})
    return spark.createDataFrame(pdf)


def test_split_covers_every_row_once(data):
    parts = T.chronological_split(data)
    assert sum(p.count() for p in parts) == data.count()
    assert parts[0].agg(F.max("year")).head()[0] == 2020 and parts[2].agg(F.min("year")).head()[0] == 2023


def test_weights_balance_the_classes(data):
    sums = T.balanced_weights(data, "label_text").groupBy("label_text").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(data.count() / 4) for r in sums)


def test_every_candidate_gives_probabilities(data):
    train, validation, _ = T.chronological_split(data)
    results = T.race_classifiers(train, validation, ["x", "y"], "label_text")
    assert {r.name for r in results} == {"RandomForest", "LogisticRegression", "GradientBoosting"}
    for r in results:
        scored = T.score_classes(r.model, validation)
        total = scored.select(F.aggregate("probs", F.lit(0.0), lambda a, v: a + v).alias("t")).agg(F.min("t"), F.max("t")).head()
        assert total[0] == pytest.approx(1.0) and total[1] == pytest.approx(1.0)
    assert results[0].metrics["macro_f1"] > 0.8


def test_regressors_refit_importance_and_reload(spark, data, tmp_path):
    train, validation, test = T.chronological_split(data)
    results = T.race_regressors(train, validation, ["x", "y"], "target")
    assert results[0].name == "LinearRegression" and results[0].metrics["r2"] > 0.99
    model = T.refit(train, validation, ["x", "y"], T.regressors("target")["RandomForest"])
    assert T.feature_importance(model, ["x", "y"], validation, "target").head()["feature"] == "x"
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a = T.score_numbers(model, test).orderBy("k").toPandas()["predicted"]
    b = T.score_numbers(again, test).orderBy("k").toPandas()["predicted"]
    np.testing.assert_allclose(a, b)


def test_a_fit_reads_stored_vectors_only(data, monkeypatch):
    seen, real = [], LinearRegression._fit
    monkeypatch.setattr(LinearRegression, "_fit", lambda self, df: seen.append(df) or real(self, df))
    train, validation, test = T.chronological_split(data)
    model = T.refit(train, validation, ["x", "y"], T.regressors("target")["LinearRegression"])
    # All passes of the fit read the vector and the label of every row from a table of their own.
    assert [df.columns for df in seen] == [[T.FEATURES, "target"]] and all("/vectors-" in f for f in seen[0].inputFiles())
    assert seen[0].count() == train.count() + validation.count()
    assert T.label_columns(T.classifiers()["RandomForest"]) == ["label", "weight"] and T.label_columns(T.classifiers(weight=None)["RandomForest"]) == ["label"]
    assert T.score_numbers(model, test).agg(F.max(F.abs(F.col("predicted") - F.col("target")))).head()[0] < 0.5


def test_random_search_uses_year_folds(data):
    coded = data.withColumn("label", (F.col("x") > 0).cast("double"))
    forest = RandomForestClassifier(featuresCol=T.FEATURES, labelCol="label", seed=1)
    found = T.random_search(coded, ["x", "y"], forest, {"maxDepth": [1, 3], "numTrees": [3, 5]}, draws=2)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.9
    assert found.best == found.settings[found.avgMetrics.index(max(found.avgMetrics))]


def test_search_fills_gaps_without_the_held_out_years(data, monkeypatch):
    """The means of a fold's model come from the other years only."""
    holes = data.withColumn("x", F.when(F.col("k") % 3 > 0, F.col("x"))).withColumn("label", (F.col("y") > 0).cast("double"))
    seen, plain = [], T.assembler
    monkeypatch.setattr(T, "assembler", lambda df, names: seen.append({r["year"] for r in df.select("year").distinct().collect()}) or plain(df, names))
    T.random_search(holes, ["x", "y"], RandomForestClassifier(featuresCol=T.FEATURES, labelCol="label", numTrees=2, seed=1), {"maxDepth": [1]}, draws=1)
    years = set(range(2015, 2025))
    assert seen == [{y for y in years if y % 3 != k} for k in range(3)] + [years]


def test_importance_of_every_candidate(data):
    """The label follows x; y is noise and gains nothing."""
    train, validation, _ = T.chronological_split(data)
    for result in T.race_classifiers(train, validation, ["y", "x"], "label_text"):
        rows = T.feature_importance(result.model, ["y", "x"], validation, "label_text").collect()
        assert [r["feature"] for r in rows] == ["x", "y"], result.name
        assert rows[0]["importance"] > 0.2 > abs(rows[1]["importance"])


def hazard_rows(spark):
    rng = np.random.default_rng(7)
    n = 500
    heat, rain = rng.normal(size=n), rng.normal(size=n)
    level = lambda v: pd.cut(v, [-9, -0.5, 0.5, 1.2, 9], labels=K.RISK_CLASSES).astype(str)
    scale = lambda v: (v - v.min()) / (v.max() - v.min())
    return spark.createDataFrame(pd.DataFrame({
        "city": "c", "hw_heat": heat, "er_wet": rain, "er_copy_of_heat": heat, "hw_copy_of_rain": rain, "temperature_c": rng.normal(size=n),
        "heatwave_category": level(heat), "heatwave_category_ordinal": 1, "heatwave_severity_score": scale(heat),
        "extreme_rainfall_category": level(rain), "extreme_rainfall_category_ordinal": 1, "extreme_rainfall_score": scale(rain),
        "year": rng.integers(2015, 2025, n),
    }))


def test_hazard_models_see_their_own_task_only(spark):
    df = hazard_rows(spark)
    _, _, test = T.chronological_split(df)
    for task, own, other in (("heatwave", "hw_", "er_"), ("extreme_rainfall", "er_", "hw_")):
        model = T.train_hazard(df, task, names=["RandomForest", "LogisticRegression", "LinearRegression"])
        assert not [f for f in model.features if f.startswith(other) or "_category" in f or "_score" in f]
        assert [f for f in model.features if f.startswith(own)] and "temperature_c" in model.features
        category, severity = T.HAZARD_TARGETS[task]
        scored = T.score_hazard(model, test, "p", "s")
        assert set(scored.columns) == {*test.columns, "p", "s"}
        got = scored.withColumn("best", F.array_position("p", F.array_max("p")) - 1).toPandas()
        assert (got["best"].map(lambda i: K.RISK_CLASSES[int(i)]) == got[category]).mean() > 0.8
        assert np.abs(got["s"] - got[severity]).mean() < 0.1 and got["s"].between(0, 1).all()


def test_fitted_models_score_state_rows(panel, tables):
    """Zone flags are made from the zone, columns that a state row lacks take the training means."""
    from skyledger.plans import catalog

    districts = tables.districts.filter("district_id < 8")
    scorer = catalog._fitted_scorer(tables)
    rows = S.evaluate_all(districts, panel, [2000], 6, scorer=scorer)
    plain = S.evaluate_all(districts, panel, [2000], 6)
    assert S.unscored(rows).count() == 0 and rows.count() == plain.count()
    columns = ["predicted_temperature_c", "predicted_rainfall_mm", "drought_severity_score", "heatwave_severity", "extreme_rainfall_severity"]
    a, b = (f.orderBy("district_id").toPandas()[columns] for f in (rows, plain))
    assert a.notna().all().all() and (a != b).any().all()


def test_metrics_with_an_empty_class(spark):
    rows = [("Low", "Low"), ("Low", "Medium"), ("High", "High"), ("High", "High")]
    df = spark.createDataFrame(rows, "true string, pred string")
    got = D.classification_metrics(df).head()
    # Low: p 1, r .5; Medium: 0; High: 1; Extreme never occurs.
    assert got["accuracy"] == 0.75
    assert got["macro_f1"] == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert got["weighted_f1"] == pytest.approx((2 / 3 * 2 + 1 * 2) / 4)
    assert tuple(D.extreme_recall(df).head()) == (0.0, 0.0)


def test_regression_metrics_skip_zero_actuals_in_mape(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 4.0)], "actual double, predicted double")
    got = D.regression_metrics(df).head()
    assert (got["mae"], got["mape"]) == (pytest.approx(2 / 3), pytest.approx(25.0))
    assert got["rmse"] == pytest.approx((2 / 3) ** 0.5) and got["r2"] == pytest.approx(1 - 2 / 8)


def test_class_check_and_imputation(spark):
    df = spark.createDataFrame([("Low", 1.0), ("Odd", None), (None, 3.0)], "c string, x double")
    with pytest.raises(ValueError):
        C.check_classes(df, "c", K.RISK_CLASSES)
    assert C.check_classes(df.filter("c = 'Low'"), "c", K.RISK_CLASSES).count() == 1
    assert [r["x"] for r in C.impute_means(df, ["x"]).collect()] == [1.0, 2.0, 3.0]
    assert C.suspicious_columns(df.withColumn("target_next", F.lit(1))) == ["target_next"]


def test_trained_model_takes_the_place_of_the_stand_in(panel, tables):
    """A temperature model scores the state rows of all districts."""
    names = ["latitude", "longitude", "month_sin", "month_cos", "temperature_prev_1", "rolling_temp_6m"]
    model = T.fit(panel, names, T.regressors("temperature_c")["LinearRegression"])
    scorer = T.learned_scorer(temperature=(model, names))
    districts = tables.districts.filter("district_id < 20")
    plain = S.evaluate_districts(districts, panel, [2000], 6).select("district_id", "predicted_temperature_c")
    learned = S.evaluate_districts(districts, panel, [2000], 6, scorer=scorer).select("district_id", F.col("predicted_temperature_c").alias("t"))
    both = plain.join(learned, "district_id").toPandas()
    assert len(both) == 20 and both["t"].notna().all()
    assert (both["t"] != both["predicted_temperature_c"]).any()


def test_districts_without_a_score_are_reported(panel, tables):
    rows = S.evaluate_all(tables.districts.filter("district_id < 12"), panel, [2000], 6)
    rows = rows.withColumns({c: F.when(F.col("district_id") > 2, F.col(c)) for c in ("hotspot_score", "soil_moisture")})
    good, bad = S.scored(rows), S.unscored(rows)
    low = {r["district_id"] for r in rows.filter("district_id <= 2").collect()}
    assert {r["district_id"] for r in bad.collect()} == low and good.count() + len(low) == rows.count()
    assert all(set(r["missing"]) == {"hotspot_score", "soil_moisture"} for r in bad.collect())


def test_scoring_keeps_rows_with_missing_features(spark):
    from skyledger.models import training as T

    rows = [(float(i), None if i % 5 == 0 else float(i % 7), None, float(2 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = T.fit(df, ["a", "b", "c"], T.regressors("y")["LinearRegression"])
    scored = T.score_numbers(model, df)
    assert scored.count() == 60 and scored.where("predicted IS NULL OR isnan(predicted)").count() == 0
    assert scored.columns == ["a", "b", "c", "y", "predicted"]


def test_correlations_use_pairwise_complete_rows(spark):
    import random

    import pandas as pd

    from skyledger.operators import quality as Q

    rng = random.Random(4)
    rows = [tuple(None if rng.random() < 0.2 else float(rng.randint(0, 9)) for _ in range(3)) for _ in range(80)]
    frame, df = pd.DataFrame(rows, columns=list("abc"), dtype=float), spark.createDataFrame(rows, "a double, b double, c double")
    ranks = frame.corr(method=lambda x, y: pd.Series(x).rank().corr(pd.Series(y).rank()))
    for r in Q.spearman(df, ["a", "b", "c"]).collect():
        assert abs(r.spearman - ranks.loc[r.left, r.right]) < 1e-12
    got = {(r.left, r.right): r.abs_corr for r in Q.collinear_pairs(df, ["a", "b", "c"], 0.0).collect()}
    plain = frame.corr().abs()
    assert len(got) == 3 and all(abs(v - plain.loc[k]) < 1e-9 for k, v in got.items())


def test_registered_races_have_all_candidates_and_the_winner_is_refitted(tables, monkeypatch):
    from skyledger.plans import catalog

    classes = {r.name for r in catalog.train_classifiers(tables).collect()}
    assert classes == set(T.classifiers())
    assert {r.name for r in catalog.train_regressors(tables).collect()} == set(T.regressors("x"))
    race, refitted = T.Result("LogisticRegression", None, {}), []
    monkeypatch.setattr(T, "race_classifiers", lambda *given: [race])
    refit = T.refit
    monkeypatch.setattr(T, "refit", lambda *given: refitted.append(given[-1]) or refit(*given))
    assert catalog.batch_score(tables).count() > 0
    assert [type(e).__name__ for e in refitted] == ["LogisticRegression"]


def test_independent_fits_run_at_the_same_time(spark):
    """Each piece waits for the other, so one after the other they would never end; results keep their order."""
    from threading import Barrier

    meet = Barrier(2, timeout=20)

    def piece(n):
        meet.wait()
        return spark.range(n).count()

    assert T.together(spark, [lambda: piece(3), lambda: piece(5)]) == [3, 5]
    assert T.together(spark, [lambda: 7]) == [7]


def test_vectors_are_dealt_out_evenly(spark):
    """One file of rows becomes a part for each core, without losing a row."""
    df = spark.range(0, 400, 1, 1).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id % 2 AS DOUBLE) AS y")
    stored = T.vectors(T.assembler(df, ["x"]).fit(df), df, ["y"])
    assert stored.count() == 400
    assert len(stored.inputFiles()) >= spark.sparkContext.defaultParallelism


@pytest.fixture(scope="module")
def coarse(spark):
    """Features of few values, so that the cuts are those of MLlib, and a class and a number that follow them."""
    rng = np.random.default_rng(3)
    n = 3000
    x = rng.integers(0, 12, (n, 4)).astype(float)
    y = x[:, 0] * 1.3 - x[:, 1] * x[:, 2] / 7 + rng.normal(size=n)
    pdf = pd.DataFrame({f"x{i}": x[:, i] for i in range(4)} | {"y": y, "label": np.digitize(y, [-3.0, 4.0]).astype(float), "weight": 0.5 + rng.random(n)})
    df = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol=T.FEATURES).transform(spark.createDataFrame(pdf))
    return df.select(T.FEATURES, "y", "label", "weight").repartition(3).cache()


def test_packed_trees_equal_those_of_mllib(coarse, monkeypatch):
    """Without drawing, every tree is determined: one tree, and boosted trees over several stored margins."""
    data = trees.packed(coarse, ["y", "label", "weight"])
    common = {"featuresCol": T.FEATURES, "maxDepth": 3, "seed": 5}
    boosted = GBTClassifier(maxIter=3, **common)
    for estimator, out in (
        (RandomForestRegressor(labelCol="y", numTrees=1, bootstrap=False, **common), "prediction"),
        (RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=1, bootstrap=False, **common), "probability"),
        (GBTRegressor(labelCol="y", maxIter=3, **common), "prediction"),
        (OneVsRest(classifier=boosted, featuresCol=T.FEATURES, labelCol="label", weightCol="weight"), "rawPrediction"),
    ):
        assert trees.grows(estimator)
        for bound in (trees.DRIVER_BYTES, 0)[: 2 if "RandomForestClassifier" in estimator.uid else 1]:  # added up by the driver, or in the cluster
            monkeypatch.setattr(trees, "DRIVER_BYTES", bound)
            model = trees.fit(estimator, data)
            a, b = (
                np.array([np.array(r[0], dtype=float).ravel() for r in T.transformed(PipelineModel(stages=[m]), coarse).select(out).collect()])
                for m in (model, estimator.fit(coarse))
            )
            assert type(model) is type(estimator.fit(coarse.limit(200))) and np.abs(a - b).max() < 1e-9, (estimator, bound)
        monkeypatch.undo()


def test_packed_forests_are_as_good_and_others_are_left_to_mllib(spark, coarse, monkeypatch):
    packings, real = [], trees.packed
    monkeypatch.setattr(trees, "packed", lambda *given, **named: packings.append(1) or real(*given, **named))
    monkeypatch.setattr(T, "PACK_ROWS", 0)
    learn = T.learner(coarse, ["y", "label", "weight"])
    scores = []
    for learned in (learn, lambda e: e.fit(coarse)):
        classes = learned(RandomForestClassifier(featuresCol=T.FEATURES, labelCol="label", numTrees=15, maxDepth=5, seed=1)).transform(coarse)
        numbers = learned(RandomForestRegressor(featuresCol=T.FEATURES, labelCol="y", numTrees=15, maxDepth=5, seed=1)).transform(coarse)
        scores.append((classes.filter("label = prediction").count() / coarse.count(), numbers.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).head()[0]))
    assert scores[0][0] == pytest.approx(scores[1][0], abs=0.02) and scores[0][1] == pytest.approx(scores[1][1], rel=0.05)
    assert packings == [1]
    assert not trees.grows(LinearRegression()) and not trees.grows(RandomForestRegressor(subsamplingRate=0.5))
    monkeypatch.setattr(T, "PACK_ROWS", 1 << 40)
    T.learner(coarse, ["y"])(RandomForestRegressor(featuresCol=T.FEATURES, labelCol="y", numTrees=1, maxDepth=1))
    assert packings == [1]


def test_cuts_come_from_all_rows(spark):
    """No bin holds far more than its share, whatever the parts, and a rare value has a bin of its own."""
    df = spark.range(0, 200_000, 1, 5).selectExpr("CAST(hash(id) AS DOUBLE) AS a", "CAST(id = 777 AS DOUBLE) AS b", "CAST(1 AS DOUBLE) AS y")
    data = trees.packed(VectorAssembler(inputCols=["a", "b"], outputCol=T.FEATURES).transform(df), ["y"])
    assert len(data.cuts[0]) == 31 and data.cuts[1].tolist() == [0.5]
    counts = np.zeros((2, 32), int)
    for r in data.blocks.collect():
        for i, bins in enumerate(np.frombuffer(r.bins, np.uint8).reshape(2, r.n)):
            counts[i] += np.bincount(bins, minlength=32)
    assert counts[1, :2].tolist() == [199_999, 1] and counts[0].sum() == 200_000 and 5_500 < counts[0].min() <= counts[0].max() < 7_000


def test_no_share_of_a_class_is_negative():
    """Sums of a class that lies on the left only, added up over the bins of two features, differ in the last digit."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        total = np.zeros((2, 1, 32, 2))
        share = rng.random(31) / 3
        total[0, 0, 1:, 0], total[0, 0, :, 1] = rng.permutation(share), 9.0 / 32
        total[1, 0, :31, 0], total[1, 0, 31, 1] = share, 9.0
        feature, cut, gain, whole, left, right = trees.best_splits(total, None, np.array([31, 31]), 2)
        assert (feature[0], cut[0]) == (1, 30) and gain[0] > 0 and right[0].tolist() == [0.0, 9.0]

"""Training with MLlib: split, weights, candidate race, search, refit, importance, scoring."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool
from threading import Lock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.models import trees
from skyledger.models.diagnostics import classification_metrics, regression_metrics
from skyledger.models.standin import STAND_IN, Scorer
from skyledger.operators import serving as V
from skyledger.operators.cleaning import numeric_columns
from skyledger.session import materialize, spread

FEATURES = "__features"
FILLED = "__filled_"
SEED = 42
# Last year of the training and of the validation rows.
TRAIN_UNTIL, VALIDATE_UNTIL = 2020, 2022
# Columns that belong to one of the two extreme-weather tasks only.
TASK_PREFIX = {"heatwave": "hw_", "extreme_rainfall": "er_"}
# Fits that run at the same time. A boosted model is hundreds of short jobs, one after the other, each far from
# filling a cluster; every fit holds its own copy of the points, in memory or on disk.
TOGETHER = 4
# Vectors that are fitted as packed blocks, see trees.py; fewer of them MLlib fits sooner, for a pass has its price.
PACK_ROWS = 250_000
R = TypeVar("R")


def together(spark: SparkSession, work: Sequence[Callable[[], R]]) -> list[R]:
    """Results of independent pieces of work, in their order, at most ``TOGETHER`` of them at a time."""
    if len(work) < 2:
        return [f() for f in work]
    run = inheritable_thread_target(spark)(lambda f: f())
    with ThreadPool(min(TOGETHER, len(work))) as pool:
        return pool.map(run, work, chunksize=1)


def chronological_split(
    df: DataFrame, train_until: int = TRAIN_UNTIL, validate_until: int = VALIDATE_UNTIL
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows by year."""
    year = F.col("year")
    return (
        df.filter(year <= train_until),
        df.filter((year > train_until) & (year <= validate_until)),
        df.filter(year > validate_until),
    )


def feature_columns(df: DataFrame, target: str, task: str | None = None) -> list[str]:
    """Numeric columns without targets; for one extreme-weather task, without the other task's columns."""
    others = [p for t, p in TASK_PREFIX.items() if task and t != task]
    banned = ("_category", "_ordinal", "_score", "target_")
    return [
        c
        for c in numeric_columns(df, exclude=[target])
        if not any(c.startswith(p) for p in others) and not any(b in c for b in banned)
    ]


def balanced_weights(df: DataFrame, label: str, classes: Sequence[str] = K.RISK_CLASSES) -> DataFrame:
    """Add ``weight`` = rows / (classes present * rows of the class). One line reaches the driver."""
    counts = df.agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes]).head().asDict()
    present = {c: n for c, n in counts.items() if n}
    total = sum(present.values())
    return df.withColumn("weight", X.encode(label, {c: total / (len(present) * n) for c, n in present.items()}))


def assembler(df: DataFrame, features: Sequence[str]) -> Pipeline:
    """Stages that fill missing values with the means of ``df`` and assemble the vector; no row is dropped.

    A feature without any value is 0. One line of means reaches the driver.
    """
    means = df.agg(*[F.coalesce(F.avg(X.finite(F.col(f).cast("double"))), F.lit(0.0)).alias(f"m{i}") for i, f in enumerate(features)]).head()
    filled = ", ".join(
        f"CASE WHEN isnan(CAST(`{f}` AS DOUBLE)) OR abs(CAST(`{f}` AS DOUBLE)) = double('infinity') THEN CAST({means[i]!r} AS DOUBLE)"
        f" ELSE coalesce(CAST(`{f}` AS DOUBLE), CAST({means[i]!r} AS DOUBLE)) END AS `{FILLED}{i}`"
        for i, f in enumerate(features)
    )
    fill = SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")
    vector = VectorAssembler(inputCols=[f"{FILLED}{i}" for i in range(len(features))], outputCol=FEATURES)
    return Pipeline(stages=[fill, vector])


def _helpers(df: DataFrame) -> list[str]:
    """Columns that the stages of :func:`assembler` add."""
    return [c for c in df.columns if c.startswith(FILLED)]


def classifiers(label: str = "label", weight: str | None = "weight") -> dict[str, Estimator]:
    """Candidate classifiers over an integer label."""
    common = {"featuresCol": FEATURES, "labelCol": label}
    weighted = common | ({"weightCol": weight} if weight else {})
    boosted = GBTClassifier(featuresCol=FEATURES, maxIter=20, maxDepth=5, seed=SEED)
    return {
        "RandomForest": RandomForestClassifier(numTrees=60, maxDepth=8, seed=SEED, **weighted),
        "LogisticRegression": LogisticRegression(maxIter=60, regParam=0.01, **weighted),
        "GradientBoosting": OneVsRest(classifier=boosted, parallelism=TOGETHER, **weighted),
    }


def regressors(label: str) -> dict[str, Estimator]:
    common = {"featuresCol": FEATURES, "labelCol": label}
    return {
        "RandomForest": RandomForestRegressor(numTrees=60, maxDepth=8, seed=SEED, **common),
        "GradientBoosting": GBTRegressor(maxIter=40, maxDepth=5, seed=SEED, **common),
        "LinearRegression": LinearRegression(maxIter=60, regParam=0.01, **common),
    }


@dataclass(frozen=True)
class Result:
    name: str
    model: PipelineModel | None
    metrics: Mapping[str, float]


def label_columns(estimator: Estimator) -> list[str]:
    """The columns that an estimator reads besides the vector: its label, and its weight if it has one."""
    weighted = estimator.hasParam("weightCol") and estimator.isDefined("weightCol")
    return [estimator.getOrDefault("labelCol"), *([estimator.getOrDefault("weightCol")] if weighted else [])]


def fit(df: DataFrame, features: Sequence[str], estimator: Estimator) -> PipelineModel:
    """The stages that assemble the vector and the fitted estimator, which reads the stored vectors in all its passes."""
    prepared = assembler(df, features).fit(df)
    columns = label_columns(estimator)
    return with_head(prepared, learner(vectors(prepared, df, columns), columns)(estimator))


def learner(rows: DataFrame, columns: Sequence[str]) -> Callable[[Estimator], Model]:
    """Fits candidates on stored vectors with the labels and weights ``columns``; beyond ``PACK_ROWS`` rows those of trees share one packed copy.

    MLlib's own trees hold the points of every fit as objects, some ten times their bytes; spilled, they are read again in each of hundreds of passes.
    """
    held: list[trees.Packed] = []
    lock = Lock()
    many = rows.count() >= PACK_ROWS

    def learn(estimator: Estimator) -> Model:
        if not (many and trees.grows(estimator)):
            return estimator.fit(rows)
        with lock:
            if not held:
                held.append(trees.packed(rows, columns, vector=FEATURES))
        return trees.fit(estimator, held[0])

    return learn


def transformed(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform``, with one-vs-rest in the engine: in Python it calls a function per row and class."""
    for stage in model.stages:
        inside = isinstance(stage, OneVsRestModel)
        df = DataFrame(stage._to_java().transform(df._jdf), df.sparkSession) if inside else stage.transform(df)
    return df


def score_classes(model: PipelineModel, df: DataFrame, classes: Sequence[str] = K.RISK_CLASSES) -> DataFrame:
    """Add ``pred`` (label) and ``probs`` (array over all classes)."""
    out = transformed(model, df)
    if "probability" in out.columns:
        probs = vector_to_array("probability")
    else:
        # One-vs-rest gives one margin per class: squash and share them out.
        squashed = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))
        total = F.aggregate(squashed, F.lit(0.0), lambda a, x: a + x)
        probs = F.transform(squashed, lambda x: x / total)
    padded = F.array(*[F.coalesce(F.get(probs, F.lit(i)), F.lit(0.0)) for i in range(len(classes))])
    drop = [c for c in (FEATURES, "rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumns({"pred": X.decode_class("prediction", classes), "probs": padded}).drop(*drop, *_helpers(out))


def score_numbers(model: PipelineModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, F.col("prediction")).drop(FEATURES, "prediction", *_helpers(scored))


def vectors(prepared: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The assembled vectors of ``df`` and the columns ``keep``, stored once for all candidates that read them.

    The rows are dealt out evenly, so every pass of every fit keeps all cores busy to its end.
    """
    return materialize(spread(prepared.transform(df).select(FEATURES, *keep)), "vectors")


def with_head(prepared: PipelineModel, head: Model) -> PipelineModel:
    """One model from the stages that assemble the vector and a fitted candidate."""
    return PipelineModel(stages=[*prepared.stages, head])


def coded_labels(df: DataFrame, label: str) -> DataFrame:
    """Add the integer ``label`` and the balanced ``weight``."""
    return balanced_weights(df, label).withColumn("label", X.encode(label, K.RISK_ORDINAL).cast("double"))


def race_classifiers(
    train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, names: Sequence[str] | None = None
) -> list[Result]:
    """Fit the candidates on balanced weights and rank them by macro F1 on the validation rows.

    Missing values take the means of the training rows. Both parts are assembled once; every candidate
    reads the stored vectors.
    """
    prepared = assembler(train, features).fit(train)
    rows = vectors(prepared, coded_labels(train, label), ["label", "weight", label])
    checked = vectors(prepared, validation, [label])
    learn = learner(rows, ["label", "weight"])

    def one(name: str, estimator: Estimator) -> Result:
        head = learn(estimator)
        scored = score_classes(PipelineModel(stages=[head]), checked).withColumn("true", F.col(label))
        return Result(name, with_head(prepared, head), classification_metrics(scored).head().asDict())

    results = together(train.sparkSession, [partial(one, n, e) for n, e in classifiers().items() if not names or n in names])
    return sorted(results, key=lambda r: -r.metrics["macro_f1"])


def race_regressors(
    train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, names: Sequence[str] | None = None
) -> list[Result]:
    """Fit the candidates and rank them by R2, then RMSE, then MAE; assembled like :func:`race_classifiers`."""
    prepared = assembler(train, features).fit(train)
    rows, checked = vectors(prepared, train, [label]), vectors(prepared, validation, [label])
    learn = learner(rows, [label])

    def one(name: str, estimator: Estimator) -> Result:
        head = learn(estimator)
        scored = score_numbers(PipelineModel(stages=[head]), checked).withColumn("actual", F.col(label))
        return Result(name, with_head(prepared, head), regression_metrics(scored).head().asDict())

    results = together(train.sparkSession, [partial(one, n, e) for n, e in regressors(label).items() if not names or n in names])
    return sorted(results, key=lambda r: (-r.metrics["r2"], r.metrics["rmse"], r.metrics["mae"]))


def comparison_table(spark: SparkSession, results: Sequence[Result]) -> DataFrame:
    """Candidates and their metrics as a small frame."""
    names = sorted(results[0].metrics)
    schema = "place int, name string, " + ", ".join(f"{n} double" for n in names)
    rows = [(i + 1, r.name, *[float(r.metrics[n]) for n in names]) for i, r in enumerate(results)]
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Search:
    """The drawn settings, the mean score of each over the folds, and a model with the best of them."""

    settings: list[Mapping[str, object]]
    avgMetrics: list[float]
    best: Mapping[str, object]
    model: PipelineModel


def random_search(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    space: Mapping[str, Sequence],
    draws: int = 12,
    folds: int = 3,
    metric: str = "f1",
) -> Search:
    """Cross-validate a random sample of the parameter grid; folds are blocks of whole years.

    Missing values take the means of the rows outside the held-out fold, so nothing of a fold reaches the
    model it tests. A fold is assembled and stored once for all settings.
    """
    keys = sorted(space)
    grid = [dict(zip(keys, values, strict=True)) for values in itertools.product(*[space[k] for k in keys])]
    picked = random.Random(SEED).sample(grid, min(draws, len(grid)))
    keep = label_columns(estimator)
    label = keep[0]
    smaller = metric in ("rmse", "mae")
    evaluator = (
        RegressionEvaluator(labelCol=label, metricName=metric)
        if smaller or metric == "r2"
        else MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    )
    fold = F.pmod(F.col("year"), F.lit(folds))
    totals = [0.0] * len(picked)
    for k in range(folds):
        outside, held = df.filter(fold != k), df.filter(fold == k)
        prepared = assembler(outside, features).fit(outside)
        rows, checked = vectors(prepared, outside, keep), vectors(prepared, held, keep)

        learn = learner(rows, keep)

        def one(setting: Mapping[str, object], learn: Callable[[Estimator], Model] = learn, checked: DataFrame = checked) -> float:
            model = learn(estimator.copy({estimator.getParam(n): v for n, v in setting.items()}))
            return evaluator.evaluate(model.transform(checked))

        for i, found in enumerate(together(df.sparkSession, [partial(one, s) for s in picked])):
            totals[i] += found / folds
    best = min(range(len(picked)), key=lambda i: totals[i] if smaller else -totals[i])
    chosen = estimator.copy({estimator.getParam(n): v for n, v in picked[best].items()})
    return Search(picked, totals, picked[best], fit(df, features, chosen))


def refit(train: DataFrame, validation: DataFrame, features: Sequence[str], estimator: Estimator) -> PipelineModel:
    """Fit the chosen estimator on training and validation rows together."""
    return fit(train.unionByName(validation), features, estimator)


BLOCK_ROWS = 50_000  # rows in a block whose values are exchanged


def feature_importance(model: PipelineModel, features: Sequence[str], df: DataFrame, label: str, key: str = "year") -> DataFrame:
    """How much worse a fitted model scores when one feature is exchanged between rows, largest first.

    Works for any model that :func:`fit` gives. For a classifier the loss is one minus the probability of the
    true class, for a regressor the squared error; ``importance`` is its mean rise. Every row takes the values of
    the next row of its block in a seeded order, one window for all features; a block is a year, cut into parts of about
    ``BLOCK_ROWS`` rows, so values stay within their year and no block grows with the data.
    """
    prepared, head = PipelineModel(stages=model.stages[:-1]), model.stages[-1]
    rows = vectors(prepared, df, [key, label])
    parts = 1 + rows.count() // BLOCK_ROWS
    number = F.xxhash64(F.lit(SEED), vector_to_array(FEATURES), label)
    rows = rows.withColumns({"__x": vector_to_array(FEATURES), "__part": F.pmod(number, F.lit(parts)), "__order": F.xxhash64(F.lit(SEED + 1), number)})
    block = Window.partitionBy(key, "__part").orderBy("__order")
    whole = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.coalesce(F.lead("__x").over(block), F.first("__x").over(whole))
    rows = rows.withColumn("__donor", donor).select("__x", "__donor", label)
    numbered = rows.withColumn("__f", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    exchanged = F.zip_with(
        F.transform("__x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), "__donor",
        lambda own, other: F.when(own["i"] == F.col("__f"), other).otherwise(own["x"]),
    )
    asked = numbered.select(array_to_vector(exchanged).alias(FEATURES), "__f", label)
    single = PipelineModel(stages=[head])
    if dict(df.dtypes)[label] == "string":
        scored = score_classes(single, asked)
        loss = F.lit(1.0) - F.coalesce(F.get("probs", X.encode(label, K.RISK_ORDINAL).cast("int")), F.lit(0.0))
    else:
        scored = score_numbers(single, asked)
        loss = F.pow(F.col("predicted") - F.col(label), 2)
    losses = scored.groupBy("__f").agg(F.avg(loss).alias("loss"))
    # One line per feature, so the window is as small as the list of names.
    base = F.max(F.when(F.col("__f") == -1, F.col("loss"))).over(Window.partitionBy(F.lit(0)))
    names = F.array(*[F.lit(f) for f in features])
    rises = losses.withColumn("importance", F.col("loss") - base).filter("__f >= 0")
    return rises.select(names[F.col("__f")].alias("feature"), "importance").orderBy(F.col("importance").desc(), "feature")


def with_features(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add what a model reads and a state row lacks: zone flags from the zone, NULL for the rest (filled by the model's means)."""
    flag = "climate_zone_"
    missing = [n for n in names if n not in df.columns]
    zones = [n.removeprefix(flag) for n in missing if n.startswith(flag)]
    flags = X.one_hot("climate_zone", zones, flag) if zones else {}
    return df.withColumns(flags | {n: F.lit(None).cast("double") for n in missing if n not in flags}) if missing else df


Fitted = tuple[PipelineModel, Sequence[str]]


def learned_scorer(
    temperature: Fitted | None = None,
    rainfall: Fitted | None = None,
    drought: Fitted | None = None,
    heatwave: HazardModel | None = None,
    extreme_rainfall: HazardModel | None = None,
) -> Scorer:
    """A scorer from trained models with the features they read; steps without a model keep the stand-in."""

    def only(df: DataFrame, scored: DataFrame, *added: str) -> DataFrame:
        return scored.select(*dict.fromkeys([*df.columns, *added]))

    def number(step, model: Fitted | None, prepare, out: str, non_negative: bool = False):
        if model is None:
            return step

        def run(df: DataFrame) -> DataFrame:
            scored = score_numbers(model[0], with_features(prepare(df), model[1]), out)
            value = X.floor_zero(out) if non_negative else F.col(out)
            return only(df, scored.withColumn(out, value), out)

        return run

    def run_drought(df: DataFrame) -> DataFrame:
        scored = score_classes(drought[0], with_features(df, drought[1])).withColumn("drought_probs", F.col("probs"))
        return only(df, scored, "drought_probs")

    def run_extreme(df: DataFrame) -> DataFrame:
        df = STAND_IN.extreme(df)
        for name, model in (("heatwave", heatwave), ("extreme_rainfall", extreme_rainfall)):
            if model is not None:
                plain = df.drop(f"{name}_probs", f"{name}_raw")
                scored = score_hazard(model, with_features(plain, model.features), f"{name}_probs", f"{name}_raw")
                df = only(plain, scored, f"{name}_probs", f"{name}_raw")
        return df

    return Scorer(
        temperature=number(STAND_IN.temperature, temperature, V.temperature_inputs, "predicted_temperature_c"),
        rainfall=number(STAND_IN.rainfall, rainfall, V.rainfall_inputs, "predicted_rainfall_mm", True),
        drought=STAND_IN.drought if drought is None else run_drought,
        extreme=run_extreme,
    )


# --- two-head hazard models -----------------------------------------------------------------------

# The class and the severity of each extreme-weather task.
HAZARD_TARGETS = {
    "heatwave": ("heatwave_category", "heatwave_severity_score"),
    "extreme_rainfall": ("extreme_rainfall_category", "extreme_rainfall_score"),
}


@dataclass(frozen=True)
class HazardModel:
    """A class head and a severity head over one vector of features that belong to one task."""

    task: str
    features: list[str]
    prepared: PipelineModel
    classifier: Model
    regressor: Model
    classes: list[Result]
    severities: list[Result]


def train_hazard(
    df: DataFrame,
    task: str,
    train_until: int = TRAIN_UNTIL,
    validate_until: int = VALIDATE_UNTIL,
    names: Sequence[str] | None = None,
) -> HazardModel:
    """Race candidates for both heads of ``task`` and refit the winners on training and validation rows.

    The features are the numeric columns without any target and without the other task's columns. Both
    heads read the same stored vectors, so a table is assembled twice, once for the race and once for the refit,
    whatever the number of candidates. ``names`` limits the candidates.
    """
    category, severity = HAZARD_TARGETS[task]
    features = feature_columns(df, category, task)
    coded = df.withColumn("label", X.encode(category, K.RISK_ORDINAL).cast("double"))
    train, validation, _ = chronological_split(coded, train_until, validate_until)
    keep = ["label", category, severity]
    prepared = assembler(train, features).fit(train)
    rows = balanced_weights(vectors(prepared, train, keep), category)
    checked = vectors(prepared, validation, keep)
    candidates = classifiers()
    numbers = regressors(severity)
    columns = ["label", "weight", severity]
    learn = learner(rows, columns)

    def one_class(name: str) -> Result:
        scored = score_classes(PipelineModel(stages=[learn(candidates[name])]), checked).withColumn("true", F.col(category))
        return Result(name, None, classification_metrics(scored).head().asDict())

    def one_number(name: str) -> Result:
        scored = score_numbers(PipelineModel(stages=[learn(numbers[name])]), checked).withColumn("actual", F.col(severity))
        return Result(name, None, regression_metrics(scored).head().asDict())

    class_names, number_names = ([n for n in known if not names or n in names] for known in (candidates, numbers))
    work = [partial(one_class, n) for n in class_names] + [partial(one_number, n) for n in number_names]
    raced = together(df.sparkSession, work)
    classes, severities = raced[: len(class_names)], raced[len(class_names) :]
    classes.sort(key=lambda r: -r.metrics["macro_f1"])
    severities.sort(key=lambda r: (-r.metrics["r2"], r.metrics["rmse"], r.metrics["mae"]))
    known = train.unionByName(validation)
    prepared = assembler(known, features).fit(known)
    weighted = balanced_weights(vectors(prepared, known, keep), category)
    winners = [candidates[classes[0].name], numbers[severities[0].name]]
    learn_again = learner(weighted, columns)
    heads = together(df.sparkSession, [partial(learn_again, w) for w in winners])
    return HazardModel(task, features, prepared, *heads, classes, severities)


def score_hazard(model: HazardModel, df: DataFrame, probs: str = "probs", severity: str = "severity") -> DataFrame:
    """Class probabilities and severity (0 to 1) of every row, in one pass over one vector."""
    out = model.prepared.transform(df)
    out = score_classes(PipelineModel(stages=[model.classifier]), out.withColumn("__vector", F.col(FEATURES)))
    out = out.withColumnRenamed("probs", "__probs").drop("pred").withColumnRenamed("__vector", FEATURES)
    out = score_numbers(PipelineModel(stages=[model.regressor]), out, "__severity")
    named = {probs: F.col("__probs"), severity: X.clip("__severity", 0.0, 1.0)}
    return out.withColumns(named).drop("__probs", "__severity", *_helpers(out))

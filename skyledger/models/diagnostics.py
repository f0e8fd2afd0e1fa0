"""Metrics and error reports over scored rows: (true, pred, probabilities) or (actual, predicted).

Everything is an aggregate or a top-n; no report needs the rows on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger import constants as K
from skyledger.functions import exprs as X
from skyledger.operators.baselines import global_stats
from skyledger.session import materialize


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE, R2 and MAPE (percent, over non-zero actuals)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    mean = global_stats(df, {"mean": F.avg(actual)})["mean"]
    staged = df.withColumn("__d", F.col(actual) - mean)
    return staged.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.sum(F.col("__d") * F.col("__d")))).alias("r2"),
        (F.avg(F.when(y != 0, F.abs(e / y))) * F.lit(100.0)).alias("mape"),
    )


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("rows"))


def top_confusions(df: DataFrame, n: int = 5, true: str = "true", pred: str = "pred") -> DataFrame:
    """Most frequent wrong pairs."""
    wrong = confusion(df, true, pred).filter(F.col("true") != F.col("pred"))
    return wrong.orderBy(F.desc("rows"), "true", "pred").limit(n)


def class_scores(df: DataFrame, classes: Sequence[str] = K.RISK_CLASSES, true: str = "true", pred: str = "pred") -> DataFrame:
    """Support, precision, recall and F1 per class, 0 where undefined, from one pass."""
    t, p = F.col(true), F.col(pred)
    wide = df.agg(
        *[F.count_if((t == c) & (p == c)).alias(f"h{i}") for i, c in enumerate(classes)],
        *[F.count_if(t == c).alias(f"t{i}") for i, c in enumerate(classes)],
        *[F.count_if(p == c).alias(f"p{i}") for i, c in enumerate(classes)],
        F.count("*").alias("total"),
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.col(f"h{i}").alias("hits"), F.col(f"t{i}").alias("support"),
                F.col(f"p{i}").alias("predicted"), F.col("total").alias("total"),
            )
            for i, c in enumerate(classes)
        ]
    )
    df = wide.select(F.explode(lines).alias("x")).select("x.*")
    precision = F.coalesce(F.try_divide("hits", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "support"), F.lit(0.0))
    df = df.withColumns({"precision": precision, "recall": recall})
    f1 = F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return df.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def classification_metrics(
    df: DataFrame, classes: Sequence[str] = K.RISK_CLASSES, true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and weighted F1.

    The macro average runs over the classes that occur as truth or prediction.
    """
    seen = class_scores(df, classes, true, pred).filter((F.col("support") > 0) | (F.col("predicted") > 0))
    return seen.agg(
        (F.sum("hits") / F.max("total")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def _share(condition: Column, among: Column | None = None) -> Column:
    value = F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(value if among is None else F.when(among, value))


def accuracy_by(df: DataFrame, key: str, true: str = "true", pred: str = "pred") -> DataFrame:
    """Accuracy, share of High and Extreme truths, and detection rate of Extreme per group."""
    t, p = F.col(true), F.col(pred)
    return df.groupBy(key).agg(
        F.count("*").alias("rows"),
        _share(t == p).alias("accuracy"),
        _share(t.isin("High", "Extreme")).alias("severe_share"),
        _share(t == p, t == "Extreme").alias("extreme_detection"),
    )


def extreme_recall(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Recall and false-negative rate of the Extreme class; both 0 when it never occurs."""
    recall = _share(F.col(pred) == "Extreme", F.col(true) == "Extreme")
    return df.agg(
        F.coalesce(recall, F.lit(0.0)).alias("extreme_recall"),
        F.coalesce(F.lit(1.0) - recall, F.lit(0.0)).alias("extreme_fn_rate"),
    )


def confident_errors(
    df: DataFrame, keep: Sequence[str], n: int = 10, true: str = "true", pred: str = "pred", probs: str = "probs"
) -> DataFrame:
    """The wrong rows with the largest margin p(predicted) - p(true)."""

    def p(label: str) -> Column:
        return F.get(F.col(probs), X.encode(label, K.RISK_ORDINAL))

    wrong = df.filter(F.col(true) != F.col(pred)).withColumns({"p_pred": p(pred), "p_true": p(true)})
    wrong = wrong.withColumn("margin", F.col("p_pred") - F.col("p_true"))
    return wrong.orderBy(F.desc("margin"), *keep).limit(n).select(*keep, true, pred, "p_pred", "p_true", "margin")


def residual_report(df: DataFrame, key: str, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean absolute error and rows per group, the best and the worst group flagged."""
    groups = df.groupBy(key).agg(
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mean_abs_error"), F.count("*").alias("rows")
    )
    groups = materialize(groups, "residual-groups")
    ends = global_stats(groups, {"low": F.min("mean_abs_error"), "high": F.max("mean_abs_error")})
    return groups.withColumns(
        {"easiest": F.col("mean_abs_error") == ends["low"], "hardest": F.col("mean_abs_error") == ends["high"]}
    )


def residual_summary(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Error in and outside the monsoon, and how often the model is too high or too low."""
    e = F.col(actual) - F.col(predicted)
    wet = X.season_flag("month", "is_monsoon") == 1
    return df.agg(
        F.avg(F.when(wet, F.abs(e))).alias("monsoon_mae"),
        F.avg(F.when(~wet, F.abs(e))).alias("non_monsoon_mae"),
        F.count_if(e < 0).alias("over_count"),
        F.count_if(e > 0).alias("under_count"),
    )


def evolution_by_prediction(df: DataFrame, pred: str = "pred") -> DataFrame:
    """Mean dry streak, recovery and momentum per predicted class."""
    return df.groupBy(F.col(pred).alias("category")).agg(
        F.avg("dry_month_streak").alias("mean_streak"),
        F.avg("drought_recovery").alias("mean_recovery"),
        F.avg("drought_momentum").alias("mean_momentum"),
    )

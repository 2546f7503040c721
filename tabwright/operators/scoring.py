"""Metrics on a (label, score) table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.order import running_sums
from tabwright.operators.recode import binarize


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _counts(df: DataFrame, by: list[str]) -> DataFrame:
    y, p = F.col("label") == 1, F.col("pred") == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def _basic() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def threshold_predictions(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("pred", binarize(F.col("score"), threshold))


def split_metric(df: DataFrame, metric: str = "recall") -> DataFrame:
    """(split, value) of one metric over (split, label, pred): accuracy, precision, recall or f1, or roc_auc over score."""
    if metric == "roc_auc":
        return roc_auc(df, ["split"]).withColumnRenamed("auc", "value")
    if metric not in ("accuracy", "recall", "f1", "precision"):
        raise ValueError(f"unknown metric '{metric}'")
    return _counts(df, ["split"]).select("split", _basic()[metric].alias("value"))


def metric_row(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, precision, recall, F1 at a threshold and the ROC AUC; zero division gives 0."""
    counts = _counts(threshold_predictions(df, threshold), []).select(
        *[e.alias(n) for n, e in _basic().items()])
    return counts.withColumn("roc_auc", roc_auc(df).scalar())


def confusion_matrix(df: DataFrame) -> DataFrame:
    """Dense 2 x 2 counts (label, pred, n)."""
    one = _counts(df, [])
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("pred"), F.col(c).alias("n"))
                     for y, p, c in cells])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and support-weighted averages."""
    flags = df.select(F.explode(F.array(
        F.struct(F.col("label").cast("string").alias("class"), (F.col("label") == F.col("pred")).cast("int").alias("hit"),
                 F.lit(0).alias("guess"), F.lit(1).alias("real")),
        F.struct(F.col("pred").cast("string").alias("class"), F.lit(0).alias("hit"),
                 F.lit(1).alias("guess"), F.lit(0).alias("real")))).alias("r")).select("r.*")
    per = flags.groupBy("class").agg(
        F.sum("hit").alias("tp"), F.sum("guess").alias("guess"), F.sum("real").alias("support")).select(
        "class", _ratio(F.col("tp"), F.col("guess")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("guess") + F.col("support")).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
                    F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                       F.sum("support").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def score_curve(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cumulative true and false positives by falling score, one row per distinct score.

    Scores are grouped before the running sum, so no task sorts raw rows.
    Columns: by..., score, pos, neg, tp, fp.
    """
    by = by or []
    grouped = df.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum((F.col("label") == 1).cast("bigint")).alias("pos"),
        F.sum((F.col("label") != 1).cast("bigint")).alias("neg")).withColumn("_down", -F.col("score"))
    return running_sums(grouped, ["_down"], {"tp": "pos", "fp": "neg"}, by).drop("_down")


def roc_points(df: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; the origin has a null threshold, the rate of an absent class is 0."""
    curve = score_curve(df)
    total = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    pos, neg = total.select("p").scalar(), total.select("n").scalar()
    points = curve.select(F.col("score").alias("threshold"), _ratio(F.col("fp"), neg).alias("fpr"),
                          _ratio(F.col("tp"), pos).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def _auc_parts(curve: DataFrame, by: list[str]) -> DataFrame:
    # each score group adds its negatives under the mean height of its step
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return curve.groupBy(*by).agg(
        F.sum(area).alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))


def roc_auc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 when a class is empty."""
    by = by or []
    return _auc_parts(score_curve(df, by), by).select(
        *by, _ratio(F.col("area"), F.col("p") * F.col("n")).alias("auc"))


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of recall steps times precision at each distinct score; 0 without positives."""
    by = by or []
    step = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return score_curve(df, by).groupBy(*by).agg(
        _ratio(F.sum(step), F.sum("pos")).alias("average_precision"))


def best_threshold(df: DataFrame) -> DataFrame:
    """First maximum of tpr - fpr down the scores: threshold, position on the curve, the gap."""
    points = roc_points(df).where("threshold is not null").withColumn("j", F.col("tpr") - F.col("fpr"))
    peak = points.agg(F.max("j").alias("j")).scalar()
    best = points.where(F.col("j") >= peak - F.lit(1e-12)).agg(F.max("threshold").alias("threshold"))
    cut = best.scalar()
    return points.where(F.col("threshold") >= cut).agg(
        F.min("threshold").alias("threshold"), F.count(F.lit(1)).alias("position"),
        F.min_by("j", "threshold").alias("youden_j"))


def separability(real: DataFrame, fake: DataFrame) -> DataFrame:
    """AUC and hit rate of discriminator scores; real hits above .5, fake below, exactly .5 misses."""
    both = real.select("score", F.lit(1).alias("label")).unionByName(fake.select("score", F.lit(0).alias("label")))
    hit = F.when(F.col("label") == 1, F.col("score") > 0.5).otherwise(F.col("score") < 0.5)
    return both.agg(F.avg(hit.cast("double")).alias("accuracy")).withColumn("auc", roc_auc(both).scalar())



"""Weighted and grouped evaluation metrics, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles, running_sum

CLASSIFICATION = ("TP", "FP", "FN", "TN", "Accuracy", "Recall", "Specificity", "Precision", "Balanced Accuracy", "GeomRS", "HarmRS", "F1 Score", "ROC AUC", "MCC", "PRC AUC", "Brier", "ECE")


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _weighted(df: DataFrame, y_true: str, other: str, weight: str | None, group: str | None, by: tuple[str, ...] = ()) -> DataFrame:
    cols = [F.col(y_true).cast("double").alias("y"), F.col(other).cast("double").alias("p"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *by]
    base = df.select(*cols, *([F.col(group).cast("string").alias("Group")] if group else []))
    overall = base.select("y", "p", "w", *by, F.lit("Overall").alias("Group"))
    return overall.union(base.select("y", "p", "w", *by, "Group")) if group else overall


def regression_metrics(df: DataFrame, y_true: str, y_pred: str, weight: str | None = None, group: str | None = None, digits: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, Group, Metric, Value): R2, MAE and RMSE, overall and by group, for each value of `by`, columns without nulls; rows
    with a null or NaN target are left out."""
    keys = [*by, "Group"]
    rows = _weighted(df, y_true, y_pred, weight, group, by).where("y is not null and not isnan(y) and p is not null")
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.abs(F.col("y") - F.col("p"))).alias("ae"), F.sum(F.col("w") * F.pow(F.col("y") - F.col("p"), 2)).alias("se"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy"))
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")
    wide = sums.select(*keys, F.bround(F.when(total > 0, 1 - F.col("se") / total), digits).alias("R2"), F.bround(F.col("ae") / F.col("sw"), digits).alias("MAE"), F.bround(F.sqrt(F.col("se") / F.col("sw")), digits).alias("RMSE"))
    return wide.unpivot(keys, ["R2", "MAE", "RMSE"], "Metric", "Value")


def expected_calibration_error(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, n_bins: int = 10) -> DataFrame:
    """One row, ece: over equal bins of the score, the weighted mean of |mean label - mean score|."""
    rows = _weighted(df, y_true, y_score, weight, None)
    bins = rows.groupBy(F.least(F.width_bucket("p", F.lit(0.0), F.lit(1.0), F.lit(n_bins)), F.lit(n_bins)).alias("b")).agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("my"), (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("mp"))
    return bins.agg((F.sum(F.col("sw") * F.abs(F.col("my") - F.col("mp"))) / F.sum("sw")).alias("ece"))


def _ranking(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, AUROC, AP) from the weights of both classes at each distinct score.

    Scores are combined first; the running sums go over one row a distinct score and value of the keys.
    """
    at = rows.groupBy(*keys, "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("neg"))
    run = running_sum(running_sum(at, [F.desc("s")], "pos", "tp", tuple(keys)), [F.desc("s")], "neg", "fp", tuple(keys))
    total = run.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))
    return total.select(*keys, _over(F.col("area"), F.col("P") * F.col("N")).alias("AUROC"), _over(F.col("ap"), F.col("P")).alias("AP"))


def classification_metrics(df: DataFrame, y_true: str, y_score: str, weight: str | None = None, group: str | None = None, cut: float = 0.5, n_bins: int = 10, digits: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, Group, Metric, Value): 17 metrics of a 0/1 label and a score, for each value of `by`, columns without nulls; the
    prediction is score >= cut.

    Quotients by zero are 0; groups with one class have no rows. The Brier score is unweighted.
    """
    keys = [*by, "Group"]
    rows = _weighted(df, y_true, y_score, weight, group, by).withColumnRenamed("p", "s").where("y is not null and s is not null")
    hit = F.col("s") >= cut
    cell = lambda y, p: F.sum(F.when((F.col("y") == y) & (hit if p else ~hit), F.col("w")).otherwise(0.0))
    c = rows.groupBy(*keys).agg(cell(1, True).alias("tp"), cell(0, True).alias("fp"), cell(1, False).alias("fn"), cell(0, False).alias("tn"), F.avg(F.pow(F.col("y") - F.col("s"), 2)).alias("Brier"), F.countDistinct("y").alias("classes")).where("classes = 2")
    bins = rows.groupBy(*keys, F.least(F.width_bucket("s", F.lit(0.0), F.lit(1.0), F.lit(n_bins)), F.lit(n_bins)).alias("b")).agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum(F.col("w") * F.col("s")).alias("ws"))
    ece = bins.groupBy(*keys).agg((F.sum(F.abs(F.col("wy") - F.col("ws"))) / F.sum("sw")).alias("ECE"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    recall, specificity = _over(tp, tp + fn), _over(tn, tn + fp)
    wide = c.join(ece, keys).join(_ranking(rows, keys), keys).select(
        *keys,
        *[
            F.bround(v, digits).alias(name)
            for name, v in {
                "TP": tp,
                "FP": fp,
                "FN": fn,
                "TN": tn,
                "Accuracy": (tp + tn) / n,
                "Recall": recall,
                "Specificity": specificity,
                "Precision": _over(tp, tp + fp),
                "Balanced Accuracy": (recall + specificity) / 2,
                "GeomRS": F.sqrt(recall * specificity),
                "HarmRS": _over(2 * recall * specificity, recall + specificity),
                "F1 Score": _over(2 * tp, 2 * tp + fp + fn),
                "ROC AUC": F.col("AUROC"),
                "MCC": _over(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
                "PRC AUC": F.col("AP"),
                "Brier": F.col("Brier"),
                "ECE": F.col("ECE"),
            }.items()
        ],
    )
    return wide.unpivot(keys, list(CLASSIFICATION), "Metric", "Value")


def average_metrics(metrics: DataFrame, keys: tuple[str, ...] = ("Set", "Metric", "Group"), digits: int = 5) -> DataFrame:
    """Mean, Median and sample StdDev of Value by the keys, in their order."""
    middle = quantiles(metrics, "Value", [0.5], keys, "__q").withColumnsRenamed({k: f"__{k}" for k in keys})
    around = metrics.groupBy(*keys).agg(F.bround(F.avg("Value"), digits).alias("Mean"), F.bround(F.stddev_samp("Value"), digits).alias("StdDev"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return around.join(middle, same, "left").select(*keys, "Mean", F.bround(F.col("__q")[0], digits).alias("Median"), "StdDev").orderBy(*keys)


def average_scores(scores: DataFrame, digits: int = 5) -> DataFrame:
    """(weighted, Metric, Mean, StdDev): population deviation; metrics whose name ends in _w are weighted ones."""
    weighted = F.col("Metric").endswith("_w")
    named = scores.select(weighted.alias("weighted"), F.regexp_replace("Metric", "_w$", "").alias("Metric"), "Value")
    return named.groupBy("weighted", "Metric").agg(F.bround(F.avg("Value"), digits).alias("Mean"), F.bround(F.stddev_pop("Value"), digits).alias("StdDev"))


def masked_loss(df: DataFrame, y_true: list[str], y_pred: list[str], weights: list[str] | None = None, tags: str | None = None) -> DataFrame:
    """(scope, name, loss, weight): sums of squared error times weight, and of weights, where the target is known.

    scope is total, task (a target column) or label (an element of the array column `tags`, each once a
    row; blank, "nan" and null labels are ignored, labels without weight are left out). A target is
    unknown if null or NaN. Sums of parts can be added (combine_losses).
    """
    tasks = []
    for i, (t, p) in enumerate(zip(y_true, y_pred, strict=True)):
        y, known = F.col(t).cast("double"), F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double"))
        w = F.when(known, F.col(weights[i]).cast("double") if weights else F.lit(1.0)).otherwise(0.0)
        tasks.append(F.struct(F.lit(t).alias("task"), F.when(known, F.pow(F.col(p).cast("double") - y, 2) * w).otherwise(0.0).alias("l"), w.alias("w")))
    rows = df.select(F.explode(F.array(*tasks)).alias("x"), *([F.col(tags).alias("tags")] if tags else [])).select("x.*", *(["tags"] if tags else []))
    sums = [F.sum("l").alias("loss"), F.sum("w").alias("weight")]
    out = [rows.agg(*sums).select(F.lit("total").alias("scope"), F.lit("total").alias("name"), "loss", "weight"), rows.groupBy("task").agg(*sums).select(F.lit("task").alias("scope"), F.col("task").alias("name"), "loss", "weight")]
    if tags:
        label = rows.select(F.explode(F.array_distinct("tags")).alias("name"), "l", "w").where("name is not null and trim(name) <> '' and lower(trim(name)) <> 'nan'")
        out.append(label.groupBy("name").agg(*sums).where("weight > 0").select(F.lit("label").alias("scope"), "name", "loss", "weight"))
    return reduce(DataFrame.union, out)


def combine_losses(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts).groupBy("scope", "name").agg(F.sum("loss").alias("loss"), F.sum("weight").alias("weight"))


def normalize_loss(losses: DataFrame, digits: int = 5) -> DataFrame:
    """(scope, name, loss): loss by weight; labels without weight have 0, other scopes null."""
    share = F.bround(F.try_divide("loss", "weight"), digits)
    return losses.select("scope", "name", F.when(F.col("scope") == "label", F.coalesce(share, F.lit(0.0))).otherwise(share).alias("loss"))


def task_metrics(df: DataFrame, y_true: str, y_pred: str, weights: str | None = None, score=None) -> DataFrame:
    """Metrics of a multi-task model over arrays of targets, predictions and weights: score's columns and Task.

    Task is Total for all cells and Task_0, Task_1, ... for each position; cells whose target is null or NaN do
    not count. score(frame, y_true, y_pred, weight column or None) is regression_metrics unless given.
    """
    score = score or regression_metrics
    arrays = [F.col(c).cast("array<double>").alias(n) for c, n in ((y_true, "y_true"), (y_pred, "y_pred"), (weights, "y_wgts")) if c]
    cells = df.select(F.posexplode(F.arrays_zip(*arrays)).alias("task", "c")).select("task", "c.*").where("y_true IS NOT NULL AND NOT isnan(y_true)")
    parts = score(cells.withColumn("__task", F.concat(F.lit("Task_"), F.col("task"))), "y_true", "y_pred", "y_wgts" if weights else None, "__task")
    return parts.withColumn("Task", F.when(F.col("Group") == "Overall", "Total").otherwise(F.col("Group"))).drop("Group")

"""The queries behind figures: distributions, residuals, quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.neighbours import k_neighbors_distance
from tessera.operators.ranking import running_sum


def ecdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, ecdf): the share of a group's values at or below each distinct value.

    Values are counted first; the running sum goes over distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col(group).alias("__g")).agg(F.sum("n").alias("__total"))
    run = running_sum(counts, [value], "n", "__upto", (group,)).join(total, F.col(group).eqNullSafe(F.col("__g")))
    return run.select(group, value, (F.col("__upto") / F.col("__total")).alias("ecdf"))


def k_neighbours_ecdf(train: DataFrame, test: DataFrame, metric: str, nearest_k: list[int], furthest_k: list[int], id_col: str = "id", features_col: str = "features") -> DataFrame:
    """(Aggregation, Distance, ecdf) of the neighbour distances of test rows to train rows."""
    wide = k_neighbors_distance(test, train, metric, nearest_k, furthest_k, id_col, features_col)
    names = [c for c in wide.columns if c != id_col]
    return ecdf(wide.unpivot([id_col], names, "Aggregation", "Distance"), "Distance", "Aggregation")


def histogram(df: DataFrame, value: str, group: str, n_bins: int = 25) -> DataFrame:
    """(group, bin, n, density) over equal bins between the least and greatest value of all groups."""
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A bin is told by the width that its density has; another order of the divisions puts values at an edge into the next one.
    width = (F.col("hi") - F.col("lo")) / n_bins
    place = F.floor((F.col("v") - F.col("lo")) / F.col("width")) + 1
    binned = rows.crossJoin(F.broadcast(ends)).where("hi > lo").withColumn("width", width).select(group, F.least(place, F.lit(n_bins)).cast("int").alias("bin"), "width")
    counts = binned.groupBy(group, "bin").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, "bin", "n", (F.col("n") / total / F.col("width")).alias("density"))


def percent_histogram(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, percent) of a discrete column."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counts.select(group, value, (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group))).alias("percent"))


def without_outliers(df: DataFrame, columns: list[str], sigmas: float = 3.0) -> DataFrame:
    """Rows within `sigmas` sample deviations of the mean, column after column, each on what is left."""
    for c in columns:
        s = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).first()
        if s["s"]:
            df = df.where(F.abs(F.col(c) - s["m"]) <= sigmas * s["s"])
    return df


def labelled(frames: dict[str, DataFrame], label: str = "Dataset") -> DataFrame:
    """Frames one below the other, with the name of each."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def residuals(df: DataFrame, y_true: str, y_pred: str, fold_col: str | None = None, test_fold: int | None = None) -> DataFrame:
    """Adds residual = y - prediction, and Set by fold if given."""
    out = df.withColumn("residual", F.col(y_true) - F.col(y_pred))
    return out if fold_col is None else out.withColumn("Set", F.when(F.col(fold_col) == test_fold, "Test").otherwise("Train"))


# Coefficients of Acklam's rational approximation of the inverse normal distribution (relative error
# 1.15e-9), from the highest power down, and where its tails begin.
CENTRE_TOP = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239)
CENTRE_BOTTOM = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0)
TAIL_TOP = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425


def normal_quantile(p: Column) -> Column:
    """The inverse of the normal distribution, as an expression."""
    horner = lambda coefficients, x: reduce(lambda a, c: a * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))
    q = p - 0.5
    centre = horner(CENTRE_TOP, q * q) * q / horner(CENTRE_BOTTOM, q * q)
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    out = horner(TAIL_TOP, tail) / horner(TAIL_BOTTOM, tail)
    return F.when(p < TAIL, out).when(p > 1 - TAIL, -out).otherwise(centre)


def qq_points(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, theoretical, observed): ordered values against normal quantiles at Filliben's positions."""
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("observed"))
    sizes = rows.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n"))
    ranked = running_sum(rows, ["observed"], F.lit(1), "i", (group,)).join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    last = F.pow(F.lit(0.5), 1 / F.col("n"))
    p = F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1 - last).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return ranked.select(group, normal_quantile(p).alias("theoretical"), "observed")


def residual_vs_distance(train: DataFrame, test: DataFrame, y_true: str, y_pred: str, metric: str = "jaccard", k: int = 1, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """(id, residual, distance): each test row's residual beside its mean distance to its k nearest train rows.

    Rows without a vector, or tests where there is no train row, have no distance.
    """
    near = k_neighbors_distance(test, train, metric, [k], [], id_col, features_col).select(F.col(id_col).alias("__id"), F.col(f"nearest_{k}").alias("distance"))
    out = residuals(test, y_true, y_pred).select(id_col, "residual")
    return out.join(near, F.col(id_col) == F.col("__id"), "left").drop("__id")


def line(spark, lo: float, hi: float, slope: float = 1.0, intercept: float = 0.0, points: int = 100) -> DataFrame:
    x = F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))
    return spark.range(points).select(x.alias("x"), (x * slope + intercept).alias("y"))


def normal_curve(df: DataFrame, value: str, points: int = 100) -> DataFrame:
    """The normal density of a column's mean and deviation over its range."""
    s = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    grid = line(df.sparkSession, s["lo"], s["hi"], points=points).select("x")
    return grid.withColumn("y", F.exp(-F.pow((F.col("x") - s["m"]) / s["s"], 2) / 2) / (s["s"] * 2.5066282746310002))

"""Expressions on array columns: extreme values, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def k_smallest(values: Column, k: int) -> Column:
    """The k least values without nulls and NaN, in order; all where there are fewer."""
    return F.slice(F.array_sort(_known(values)), 1, k)


def k_largest(values: Column, k: int) -> Column:
    """The k greatest values without nulls and NaN, from the greatest; all where there are fewer."""
    return F.slice(F.sort_array(_known(values), asc=False), 1, k)


def k_smallest_by_position(df: DataFrame, col: str, k: int) -> DataFrame:
    """(position, values): the k least of each position over all rows, by partial top-k of each task.

    Values are ranked within 64 parts first, so that no position is gathered whole.
    """
    return _by_position(df, col, k, True)


def k_largest_by_position(df: DataFrame, col: str, k: int) -> DataFrame:
    """(position, values): the k greatest of each position over all rows."""
    return _by_position(df, col, k, False)


def _by_position(df: DataFrame, col: str, k: int, least: bool) -> DataFrame:
    from pyspark.sql import Window

    long = df.select(F.posexplode(F.col(col).cast("array<double>")).alias("position", "x")).where("x is not null and not isnan(x)")
    order = F.col("x") if least else F.desc("x")
    part = F.row_number().over(Window.partitionBy("position", "part").orderBy(order))
    top = long.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(64))).withColumn("rn", part).where(F.col("rn") <= k)
    ends = top.groupBy("position").agg(F.collect_list("x").alias("x"))  # at most 64 k values a position
    return ends.select("position", (k_smallest if least else k_largest)(F.col("x"), k).alias("values"))


def validate_features(df: DataFrame, col: str) -> int:
    """The common length of the vectors; ValueError if they differ or the column is no array."""
    if not dict(df.dtypes)[col].startswith("array"):
        raise ValueError(f"{col} is not an array column")
    r = df.agg(F.min(F.size(col)).alias("lo"), F.max(F.size(col)).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vectors of {r['lo']} to {r['hi']} components")
    return r["hi"] or 0


def validate_targets(df: DataFrame, col: str) -> None:
    """ValueError unless the column is numeric."""
    if dict(df.dtypes)[col].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"):
        raise ValueError(f"{col} is not numeric")

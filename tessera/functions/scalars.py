"""Scalar expressions: bins, rounding, bit strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles


def bin_column(df: DataFrame, col: str, n_bins: int = 5, out: str = "bin") -> DataFrame:
    """Adds 1 + the number of interior quantiles (linear interpolation) at or below the value; null for null."""
    if n_bins < 2:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(1)))
    # One row of n_bins - 1 numbers.
    cuts = quantiles(df, col, [i / n_bins for i in range(1, n_bins)], out="__cuts")
    return df.join(F.broadcast(cuts), how="left").withColumn(out, F.when(F.col(col).isNotNull(), F.size(F.filter("__cuts", lambda q: q <= F.col(col))) + 1)).drop("__cuts")


def round_to_significant(x: Column, digits: int) -> Column:
    """The value rounded to that many significant digits; 0 stays 0."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    scale = F.pow(F.lit(10.0), places.cast("double"))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def is_binary(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isin(0, 1))


def to_bit_string(vector: Column) -> Column:
    """The 0/1 components as text; an error for empty or other vectors."""
    text = F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), "")
    return F.when(F.assert_true((F.size(vector) > 0) & is_binary(vector), "a 0/1 vector is needed").isNull(), text)


def pack_bits(vector: Column) -> Column:
    """Up to 63 bits as one number, the first component highest."""
    return F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(x.cast("long")))

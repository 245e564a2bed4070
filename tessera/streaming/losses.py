"""Masked losses over a stream: the sums of each batch are added to what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_loss(stream: DataFrame, time_col: str, y_true: str, y_pred: str, weight: str, group: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, group, loss, weight): sums of squared error times weight where the target is known.

    Rows may come late by `late`; with append output a window is given once it can no longer change. The
    state is one pair of sums per open window and group.
    """
    known = F.col(y_true).isNotNull() & ~F.isnan(F.col(y_true).cast("double"))
    w = F.when(known, F.col(weight)).otherwise(0.0)
    loss = F.when(known, F.pow(F.col(y_true) - F.col(y_pred), 2) * w).otherwise(0.0)
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), group).agg(F.sum(loss).alias("loss"), F.sum(w).alias("weight"))

"""Repeated measurements of a key: screens and robust resolution."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import quantiles
from tessera.session import materialize


def duplicated_mask(df: DataFrame, keys: list[str], out: str = "duplicated") -> DataFrame:
    """Adds whether another row has the same keys; null keys equal each other."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    counts, _ = materialize(counts, "dup-keys")
    for k in keys:
        counts = counts.withColumnRenamed(k, f"__k_{k}")
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        same = c if same is None else same & c
    return df.join(counts, same, "left").withColumn(out, F.col("__n").isNotNull()).drop("__n", *[f"__k_{k}" for k in keys])


def drop_all_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur once; every copy of a repeated key goes."""
    return duplicated_mask(df, keys, "__dup").where(~F.col("__dup")).drop("__dup")


def value_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, n, m, low, high, mean, nan) of each key: its rows, its values, their bounds and mean, and whether any is NaN.

    Null and NaN values are only in n. Null keys are one key.
    """
    v = F.col(value).cast("double")
    number = F.when(~F.isnan(v), v)
    return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.count(number).alias("m"), F.min(number).alias("low"), F.max(number).alias("high"), F.avg(number).alias("mean"), F.bool_or(F.isnan(v)).alias("nan"))


def check_unit_error(df: DataFrame, key: str, value: str, tolerance: float = 0.0, stats: DataFrame | None = None) -> DataFrame:
    """(key, unit_error): whether two of a key's values differ by 3, 6 or 9, the trace of a mistaken unit.

    Values are compared through an equi-join on shifted values, exact by default; with a tolerance on
    values rounded to it. Only keys whose bounds (`stats`, the written value_stats of df) are that far apart
    are joined: sums and roundings keep the order, so no other key has such a pair.
    """
    step = (lambda c: F.round(c / abs(tolerance)).cast("long")) if tolerance else (lambda c: c)
    if stats is None:
        stats, _ = materialize(value_stats(df, key, value), "unit-stats")
    wide = stats.where(F.col("nan") | (step(F.col("low") + 3.0) <= step(F.col("high")))).select("k")
    if wide.isEmpty():
        return stats.select(F.col("k").alias(key), F.lit(False).alias("unit_error"))
    vals = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).distinct().join(wide, "k", "left_semi")
    shifted = vals.select("k", F.explode(F.array(*[F.col("v") + d for d in (3.0, 6.0, 9.0)])).alias("w"))
    hits = vals.select("k", step(F.col("v")).alias("s")).join(shifted.select("k", step(F.col("w")).alias("s")), ["k", "s"], "left_semi").select("k").distinct()
    hits, _ = materialize(hits, "unit-errors")
    return stats.select("k").join(hits.withColumn("hit", F.lit(True)), "k", "left").select(F.col("k").alias(key), F.coalesce("hit", F.lit(False)).alias("unit_error"))


#: Rescales the median absolute deviation to a normal distribution's deviation.
MAD_SCALE = 0.6745


#: Keys of up to this many values are trimmed each in a task's memory; larger ones by rounds over the whole table.
WHOLE = 1 << 20


def _settle(values: np.ndarray, range_threshold: float, z_threshold: float, how: str) -> float | None:
    """What the ordered values of a key come to after trimming (see _trimmed)."""
    middle = lambda x: 0.5 * x[(len(x) - 1) // 2] + 0.5 * x[len(x) // 2]
    while True:
        if values[-1] - values[0] <= range_threshold:
            return float({"mean": np.mean, "median": middle, "min": np.min, "max": np.max}[how](values))
        away = np.abs(values - middle(values))
        mad = middle(np.sort(away))
        kept = values[away * MAD_SCALE <= z_threshold * mad] if mad else values
        if len(kept) == len(values):
            return None
        values = kept


def _trimmed(values: DataFrame, range_threshold: float, z_threshold: float, how: str, large: DataFrame | None = None) -> DataFrame:
    """(k, r): the value of each key after trimming, null where it cannot be resolved.

    Per round a key is settled if its values span at most range_threshold, by their mean, median, least
    or greatest; else values whose |0.6745 (x - median) / MAD| exceeds z_threshold go. A key that loses
    none is settled as null, as is one whose MAD is 0. Keys of up to WHOLE values, which is all of most
    tables, take one shuffle; for larger ones (`large`, if they are known) each round is a pass over the table.
    """
    if large is None:
        large, _ = materialize(values.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("k"), "mad-large")
    some = not large.isEmpty()
    small = values.join(F.broadcast(large), "k", "left_anti") if some else values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys, numbers = batch.column(0), batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()] if len(keys) else []
            out = []
            for start, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                now = keys[start].as_py()
                if held and now != key:
                    out.append((key, _settle(np.concatenate(held), range_threshold, z_threshold, how)))
                    held = []
                key = now
                held.append(numbers[start:stop])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], keys.type), pa.array([r[1] for r in out], pa.float64())], ["k", "r"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key], keys.type), pa.array([_settle(np.concatenate(held), range_threshold, z_threshold, how)], pa.float64())], ["k", "r"])

    kind = dict(values.dtypes)["k"]
    # Dealt by a hash of the key: above a join on the key itself the planner drops the exchange, and when that join turns into a
    # broadcast at run time nothing keeps a key's rows together.
    settled = small.select("k", "v").repartition(F.xxhash64("k")).sortWithinPartitions("k", "v").mapInArrow(work, f"k {kind}, r double")
    if not some:
        return settled
    return settled.union(_trimmed_by_rounds(values.join(F.broadcast(large), "k", "left_semi"), range_threshold, z_threshold, how))


def _trimmed_by_rounds(values: DataFrame, range_threshold: float, z_threshold: float, how: str) -> DataFrame:
    """As _trimmed, for keys of any size: medians by ranks, all keys advance together, tables of a round written."""
    settle = {"mean": F.avg("v"), "median": F.lit(None).cast("double"), "min": F.min("v"), "max": F.max("v")}[how]
    rows, done = values, []
    while True:
        wide = rows.groupBy("k").agg((F.max("v") - F.min("v")).alias("span"), settle.alias("r"), F.count("*").alias("n"))
        middle = quantiles(rows, "v", [0.5], ("k",)).select("k", F.col("q")[0].alias("mid"))
        stats, _ = materialize(wide.join(middle, "k"), "mad-stats")
        done.append(stats.where(F.col("span") <= range_threshold).select("k", F.col("mid").alias("r") if how == "median" else "r"))
        away, _ = materialize(rows.join(stats.where(F.col("span") > range_threshold).select("k", "mid", "n"), "k").select("k", "v", "n", F.abs(F.col("v") - F.col("mid")).alias("d")), "mad-away")
        mads = quantiles(away, "d", [0.5], ("k",)).select("k", F.col("q")[0].alias("mad"))
        # Of every key some values are kept, so an empty table means that all keys are settled.
        kept, _ = materialize(away.join(mads, "k").where((F.col("mad") == 0) | (F.col("d") * MAD_SCALE <= z_threshold * F.col("mad"))).select("k", "v", "n"), "mad-kept")
        if kept.isEmpty():
            break
        left = kept.groupBy("k").agg(F.count("*").alias("m"), F.max("n").alias("n"))
        done.append(left.where("m = n").select("k", F.lit(None).cast("double").alias("r")))
        rows = kept.join(left.where("m < n").select("k"), "k", "left_semi").select("k", "v")
    return reduce(DataFrame.union, done)


def mad_duplicates(df: DataFrame, key: str = "dd_key", value: str = "pIC50", range_threshold: float = 1.0, z_threshold: float = 3.5, stats: DataFrame | None = None) -> DataFrame:
    """df with the value of every row of a repeated key replaced by the key's resolved value, or null.

    Rows stay. Keys seen once keep their value; a null key is no key and its rows get null, as do null
    and NaN values take no part in the resolution of their key. Keys whose values span range_threshold at most
    have their mean from the sums by key (`stats`, the written value_stats of df); only the values of others are dealt out.
    """
    column = F.col(value).cast("double")
    if stats is None:
        stats, _ = materialize(value_stats(df, key, value), "mad-stats")
    repeated = stats.where("k IS NOT NULL AND n > 1")
    # Without values there is no span, and no mean.
    near = F.coalesce(F.col("high") - F.col("low") <= range_threshold, F.lit(True))
    answer, wide = repeated.where(near).select("k", F.col("mean").alias("r")), repeated.where(~near)
    if not wide.isEmpty():
        values = df.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(column)).select(F.col(key).alias("k"), column.alias("v")).join(wide.select("k"), "k", "left_semi")
        resolved, _ = materialize(_trimmed(values, range_threshold, z_threshold, "mean", wide.where(F.col("m") > WHOLE).select("k")), "mad-resolved")
        answer = answer.union(wide.select("k").join(resolved, "k", "left"))
    answer, _ = materialize(answer.select(F.col("k").alias("__k"), F.col("r").alias("__r"), F.lit(True).alias("__rep")), "mad-answer")
    return df.join(answer, F.col(key) == F.col("__k"), "left").withColumn(value, F.when(F.col("__rep") | F.col(key).isNull(), F.col("__r")).otherwise(column)).drop("__k", "__r", "__rep")


def mad_censored_duplicates(df: DataFrame, key: str = "dd_key", value: str = "p_value", relation: str = "standard_relation", range_threshold: float = 1.0, z_threshold: float = 3.5) -> DataFrame:
    """mad_duplicates for exact and censored values: value and relation of repeated keys are resolved.

    Exact values (=) reduce to a median, lower bounds (>) to the greatest, upper bounds (<) to the
    least, each by its own trimming; a side that cannot be resolved counts as absent. One side alone
    stands. An exact value stands beside bounds that admit it or miss it by range_threshold at most,
    else the key has null. Two bounds alone meet in their mean as an exact value if the lower is below
    the upper by range_threshold at most, or above it by less than half of it; else the key has null.
    """
    column = F.col(value).cast("double")
    keyed = df.where(F.col(key).isNotNull())
    repeated, _ = materialize(keyed.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"), "censored-keys")
    sides = None
    for rel, how in (("=", "median"), (">", "max"), ("<", "min")):
        vals = keyed.where((F.col(relation) == rel) & F.col(value).isNotNull() & ~F.isnan(column)).select(F.col(key).alias("k"), column.alias("v")).join(repeated, "k", "left_semi")
        part = _trimmed(vals, range_threshold, z_threshold, how).select("k", F.lit(rel).alias("rel"), "r")
        sides = part if sides is None else sides.union(part)
    eq, lo, hi = (F.col(c) for c in ("eq", "lo", "hi"))
    wide = sides.groupBy("k").agg(*[F.max(F.when(F.col("rel") == r, F.col("r"))).alias(n) for r, n in (("=", "eq"), (">", "lo"), ("<", "hi"))])
    above = F.coalesce((eq >= lo) | (lo - eq <= range_threshold), F.lit(True))
    below = F.coalesce((eq <= hi) | (eq - hi <= range_threshold), F.lit(True))
    meet = ((lo < hi) & (hi - lo <= range_threshold)) | (lo - hi < 0.5 * range_threshold) & (lo >= hi)
    out_value = F.when(eq.isNotNull(), F.when(above & below, eq)).when(lo.isNotNull() & hi.isNotNull(), F.when(meet, (lo + hi) / 2)).otherwise(F.coalesce(lo, hi))
    out_rel = F.when(eq.isNotNull() | (lo.isNotNull() & hi.isNotNull()), "=").when(lo.isNotNull(), ">").otherwise("<")
    resolved = wide.select("k", out_value.alias("r"), F.when(out_value.isNotNull(), out_rel).alias("rel"))
    answer, _ = materialize(repeated.join(resolved, "k", "left").select(F.col("k").alias("__k"), F.col("r").alias("__r"), F.col("rel").alias("__rel"), F.lit(True).alias("__rep")), "censored-answer")
    redo = F.coalesce(F.col("__rep"), F.lit(False)) | F.col(key).isNull()
    return df.join(answer, F.col(key) == F.col("__k"), "left").withColumn(value, F.when(redo, F.col("__r")).otherwise(column)).withColumn(relation, F.when(redo, F.col("__rel")).otherwise(F.col(relation))).drop("__k", "__r", "__rel", "__rep")


def trimmed_group_mean(df: DataFrame, key: str, value: str, width: float = 0.7) -> DataFrame:
    """(key, value): per key the mean of the values within median +- width * sample deviation."""
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    middle = quantiles(rows, "v", [0.5], ("k",)).select(F.col("k").alias("m"), F.col("q")[0].alias("mid"))
    stats = rows.groupBy("k").agg(F.stddev_samp("v").alias("dev")).join(middle, F.col("k").eqNullSafe(F.col("m"))).drop("m")
    stats, _ = materialize(stats, "trim-stats")
    near = df.join(stats, F.col(key) == F.col("k")).where(F.abs(F.col(value) - F.col("mid")) <= F.coalesce("dev", F.lit(0.0)) * width)
    return near.groupBy(key).agg(F.avg(value).alias(value))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")

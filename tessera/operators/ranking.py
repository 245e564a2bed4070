"""Running sums and numbers over a whole table's order, without one task for the table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Bits of a digit of the 64-bit numbers that stand for doubles in order, and the digits of one.
DIGIT = 16
PASSES = 64 // DIGIT


def running_sum(df: DataFrame, order: list[str | Column], value: str | Column, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`: the sum of value over the rows up to this one in the order, within each value of `by`.

    Rows are dealt into ranges of (by, order) and written with their range's number. A row's sum is
    that within its range plus those of the ranges before, which are one row a range and group. Rows
    equal in the order are summed one after the other.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id())
    dealt, _ = materialize(dealt.withColumn("__value", F.col(value) if isinstance(value, str) else value), "running")
    starts = dealt.groupBy(*by, "__range").agg(F.sum("__value").alias("__sum"))
    # As many rows as there are ranges and groups.
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    summed = dealt.withColumn("__within", F.sum("__value").over(within))
    return summed.join(starts, same).withColumn(out, F.col("__before") + F.col("__within")).drop("__range", "__at", "__before", "__within", "__value", *[f"__by_{c}" for c in by])


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double_of(bits: int) -> float:
    raw = bits ^ (1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def vector_quantiles(df: DataFrame, col: str, probabilities: list[float]) -> dict[int, list[float]]:
    """By position of the arrays in col the quantiles of its values by linear interpolation between ranks.

    Values become 64-bit numbers of the same order, read digit by digit: a pass counts the digits of the values that begin
    like the one looked for, tells by a running sum which digit holds each rank, and only that is refined. Four passes
    over the table, with counts shuffled and never values; the driver gets two ranks a position and probability. Nulls
    and NaN take no part; a position without other values is left out. Arrays have fewer than 65,536 values.
    """
    rows = df.where(F.col(col).isNotNull()).select(F.col(col).cast("array<double>").alias("v"))
    at = Window.partitionBy("slot").orderBy("digit")
    ranks = F.array(*[x for k, p in enumerate(probabilities) for place in [F.lit(float(p)) * (F.col("total") - 1)] for x in (F.struct(F.lit(2 * k).alias("k"), F.floor(place).alias("rank")), F.struct(F.lit(2 * k + 1).alias("k"), F.ceil(place).alias("rank")))])
    found: dict[tuple[int, int], tuple[int, int]] = {}
    totals: dict[int, int] = {}
    for step in range(PASSES):
        # Beginnings looked for, with their positions in the leading bits.
        slots = np.array(sorted({position << 48 | begin for (position, _), (begin, _) in found.items()}), np.uint64)

        def count(batches: Iterator[pa.RecordBatch], step: int = step, slots: np.ndarray = slots) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(0)
                ends = column.offsets.to_numpy()
                position = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(x)
                bits, slot = _ordered_bits(x[known]), position[known].astype(np.uint64)
                if step:
                    name = slot << np.uint64(48) | bits >> np.uint64(64 - DIGIT * step)
                    slot = np.minimum(np.searchsorted(slots, name), len(slots) - 1).astype(np.uint64)
                    own = slots[slot.astype(np.int64)] == name
                    bits, slot = bits[own], slot[own]
                digit = bits >> np.uint64(64 - DIGIT * (step + 1)) & np.uint64((1 << DIGIT) - 1)
                cells, n = np.unique(slot << np.uint64(DIGIT) | digit, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((cells >> np.uint64(DIGIT)).astype(np.int64)), pa.array((cells & np.uint64((1 << DIGIT) - 1)).astype(np.int64)), pa.array(n.astype(np.int64))], ["slot", "digit", "n"])

        counts = rows.mapInArrow(count, "slot long, digit long, n long").groupBy("slot", "digit").agg(F.sum("n").alias("n"))
        # At most 65,536 digits a slot.
        summed = counts.withColumn("upto", F.sum("n").over(at.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(Window.partitionBy("slot")))
        if step == 0:
            asked = summed.select("*", F.explode(ranks).alias("r")).select("slot", "digit", "n", "upto", "total", "r.k", "r.rank")
        else:
            places = {int(name): i for i, name in enumerate(slots)}
            wanted = [(places[position << 48 | begin], position, k, rank) for (position, k), (begin, rank) in found.items()]
            if not wanted:
                break
            asked = summed.join(F.broadcast(df.sparkSession.createDataFrame(wanted, "slot long, position int, k int, rank long")), "slot")
        for r in asked.where("rank < upto AND rank >= upto - n").collect():
            position = r["slot"] if step == 0 else r["position"]
            begin = found[position, r["k"]][0] if step else 0
            totals.setdefault(position, r["total"])
            found[position, r["k"]] = (begin << DIGIT | r["digit"], r["rank"] - (r["upto"] - r["n"]))
    out = {}
    for position, n in sorted(totals.items()):
        ends = [_double_of(found[position, k][0]) for k in range(2 * len(probabilities))]
        share = [p * (n - 1) - np.floor(p * (n - 1)) for p in probabilities]
        out[position] = [float(lo + (hi - lo) * s) if hi != lo else lo for lo, hi, s in zip(ends[::2], ends[1::2], share, strict=True)]
    return out


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    """(by, out): the quantiles of value by linear interpolation between ranks, as an array; a row for each group.

    Within groups values are counted first, and a running sum of the counts tells which value has a rank, so no group's
    values are ever together in one task; without groups ranks are found digit by digit (vector_quantiles). Nulls and NaN
    take no part; without other values there is no row.
    """
    if not by:
        found = vector_quantiles(df.select(F.array(F.col(value).cast("double")).alias("v")), "v", probabilities)
        return df.sparkSession.createDataFrame([(q,) for q in found.values()], f"{out} array<double>")
    known = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = running_sum(known.groupBy(*by, "__v").agg(F.count("*").alias("__c")), ["__v"], "__c", "__upto", by)
    counts, _ = materialize(counts, "quantile-ranks")
    totals = counts.groupBy(*[F.col(c).alias(f"__g_{c}") for c in by]).agg(F.max("__upto").alias("__n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by])
    ranked = counts.join(totals, same)
    ends = []
    for i, p in enumerate(probabilities):
        place = F.lit(p) * (F.col("__n") - 1)
        for name, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("__v"))).alias(f"__{name}{i}"))
    found = ranked.groupBy(*by).agg(F.max("__n").alias("__n"), *ends).where("__n IS NOT NULL")
    mixed = [F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (F.lit(p) * (F.col("__n") - 1) - F.floor(F.lit(p) * (F.col("__n") - 1))) for i, p in enumerate(probabilities)]
    return found.select(*by, F.array(*mixed).alias(out))

"""Joins that move only the rows with a partner, and scratch tables that go."""

import pytest
import os

from pyspark.sql import functions as F

from tessera import session
from tessera.operators.filters import join_few, possibly_in


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_no_partner_is_missed(spark, bits):
    rows = spark.createDataFrame([(i % 700, f"t{i}") for i in range(2000)] + [(None, "null")], "id long, __chunkless string")
    keys = spark.createDataFrame([(i,) for i in range(0, 4000, 7)] + [(None,)], "k long")
    marked = possibly_in(rows, [F.col("id")], keys, bits).collect()
    assert len(marked) == 2001 and all(r["__maybe"] for r in marked if r["id"] is None or r["id"] % 7 == 0)
    assert not all(r["__maybe"] for r in marked)
    left = join_few(rows, [F.col("id")], keys, lambda few: few.join(keys, F.col("id").eqNullSafe(F.col("k")), "left_anti"), bits)
    assert left.columns == rows.columns
    assert sorted(r[1] for r in left.collect()) == sorted(f"t{i}" for i in range(2000) if i % 700 % 7)
    assert join_few(rows, [F.col("id")], keys.limit(0), lambda few: few, bits).count() == 2001
    assert join_few(rows.limit(0), [F.col("id")], keys, lambda few: few, bits).count() == 0


def test_scratch_scope_removes_all_but_the_kept(spark):
    kept, old = session.materialize(spark.range(3), "old")
    with session.scratch_scope(spark) as keep:
        session.materialize(spark.range(5), "dropped-table")
        frame, path = session.materialize(spark.range(4), "kept")
        keep.append(path)
    assert frame.count() == 4 and kept.count() == 3
    assert os.path.isdir(old) and os.path.isdir(path) and not any("dropped-table" in p for p in os.listdir(os.path.dirname(path)))


def test_bits_are_read_without_strings(spark):
    """Every place of a word of the bitmap is told apart, and rows are tested by shifts, not by numbers parsed for each."""
    keys = spark.range(0, 4000, 3).select(F.col("id").alias("k"))
    out = possibly_in(spark.range(4000), [F.col("id")], keys)
    assert {r["id"] for r in out.where("__maybe").collect()} >= set(range(0, 4000, 3)) and out.where("NOT __maybe").count() > 2500
    told = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "__maybe" in x]
    assert told and not any("conv(" in x for x in told)

"""Repeated measurements from one pass of sums by key: rows read, odd values, and what the screen admits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import duplicates
from tessera.sources import tables


def test_rows_of_a_binding_table_are_parsed_twice_at_most(spark):
    """Once for the sums by key and once for the result; before, each screen and each resolution parsed them anew."""
    seen = spark.sparkContext.accumulator(0)

    def text(i):
        seen.add(1)
        return str(200 + i % 400)

    shown = F.udf(text, "string").asNondeterministic()("id")
    rows = spark.range(4_000).select(shown.alias("IC50 (nM)"), F.concat(F.lit("m"), F.col("id") % 50).alias("Ligand InChI Key"), F.lit("t").alias("Target Name"))
    got = {r["dd_key"]: r["pIC50"] for r in tables.preprocess_binding(rows).collect()}
    assert len(got) == 50
    assert got["m7|t"] == pytest.approx(np.mean([9 - math.log10(200 + i % 400) for i in range(7, 4_000, 50)]), abs=1e-9)
    assert seen.value <= 2 * 4_000


def test_odd_values_of_keys(spark):
    inf, nan = float("inf"), float("nan")
    data = [("a", 5.0), ("a", 5.5), ("a", nan), ("b", None), ("b", nan), ("d", inf), ("e", nan), (None, 2.0), (None, 5.0), ("f", None), ("", 1.0), ("", 1.5), ("g", 1.0), ("g", 1.1), ("g", 1.2), ("g", 7.0)]
    df = spark.createDataFrame(data, "dd_key string, pIC50 double")
    got = {}
    for r in duplicates.mad_duplicates(df).collect():
        got.setdefault(r[0], []).append(r[1])
    alike = lambda x: ["nan" if v is not None and math.isnan(v) else None if v is None else round(v, 9) for v in x]
    assert {k: alike(v) for k, v in got.items()} == {"a": [5.25] * 3, "b": [None] * 2, "d": [inf], "e": ["nan"], None: [None] * 2, "f": [None], "": [1.25] * 2, "g": [1.1] * 4}


def test_the_screen_finds_what_a_join_of_all_values_finds(spark):
    inf, nan = float("inf"), float("nan")
    data = [("three", 5.0), ("three", 8.0), ("six", -0.0), ("six", 6.0), ("nine", 0.5), ("nine", 9.5), ("far", 1.0), ("far", 5.5), ("near", 1.0), ("near", 3.9), ("nan", nan), ("large", 1e17), ("large", None), ("inf", inf), ("none", None), (None, 1.0), (None, 4.0), ("third", 0.1), ("third", 3.1), ("digits", 0.3), ("digits", 3.2999999)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r["unit_error"] for r in duplicates.check_unit_error(df, "k", "v").collect()}
    wrong = {"three", "six", "nine", "nan", "large", "inf"} | ({"third"} if 0.1 + 3.0 == 3.1 else set())
    assert got == {k: k in wrong for k, _ in data}
    rounded = {r["k"]: r["unit_error"] for r in duplicates.check_unit_error(df.where("k IN ('digits', 'far', 'three', 'near')"), "k", "v", 0.01).collect()}
    assert rounded == {"digits": True, "far": False, "three": True, "near": False}

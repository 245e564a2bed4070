"""Blocks of whose rows only the best leave, and what the steps leave on disk."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions.distances import pairwise
from tessera.operators import neighbours


@pytest.mark.parametrize("k", [0, 1, 5, 40])
def test_k_best_over_pieces(k):
    r = np.random.default_rng(0)
    d = np.round(r.random((30, 100)), 2)  # many ties
    d[3, 10:] = np.inf
    best = np.full((30, k), np.inf)
    for j in range(0, 100, 13):
        neighbours._k_best(best, d[:, j : j + 13])
    assert (best == np.sort(d, axis=1)[:, :k]).all()


def _vectors(spark, n, groups):
    r = np.random.default_rng(1)
    x = r.normal(size=(n, 5))
    x[n // 2 : n // 2 + n // 10] = x[: n // 10]  # copies
    rows = [(i, v.tolist(), groups(i)) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, (n, None, groups(0))], f"id long, x array<double>, g {'array<string>' if isinstance(groups(0), list) else 'int'}")


def test_group_statistics_in_pieces_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 7)
    monkeypatch.setattr(neighbours, "BROAD", 11)
    held = lambda i: [c for c in "abc" if (i + ord(c)) % 3 or i % 5 == 0]
    x, df = _vectors(spark, 90, held)
    d = pairwise("cosine", x, x)
    got = {(r["scope"], r["grp"], r["id"]): r for r in neighbours.group_k_neighbors_distance(df, "x", "g", "cosine", [1, 5], [3]).collect()}
    seen = 0
    for i in range(90):
        for g in held(i):
            inside = np.array([g in held(j) for j in range(90)])
            for scope, row in (("Intra", d[i][inside & (np.arange(90) != i)]), ("Inter", d[i][~inside])):
                if len(row):
                    own, row, seen = got[scope, g, i], np.sort(row), seen + 1
                    want = [row[0], row.mean(), row[-1], row[:1].mean(), row[:5].mean(), row[-3:].mean()]
                    assert [own[c] for c in ("min", "mean", "max", "nearest_1", "nearest_5", "furthest_3")] == pytest.approx(want, abs=1e-12)
    assert seen == len(got)


def test_of_equal_rows_the_first_is_nearest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 16)
    monkeypatch.setattr(neighbours, "BROAD", 37)
    r = np.random.default_rng(2)
    base = r.normal(size=(20, 64))
    x = base[np.arange(400) % 20]
    x[::20] += 1e-3 * r.normal(size=(20, 64))  # near all copies of row 0, equally far from none
    df = spark.createDataFrame([(i, v.tolist(), i % 20) for i, v in enumerate(x)], "id long, x array<double>, g int")
    got = {r["id"]: r["nearest_id"] for r in neighbours.nearest_label(df, "g", "cosine", "id", "x").collect()}
    for i in range(400):
        if i % 20:
            assert got[i] == (i % 20 if i >= 20 else i + 20)


def test_copies_of_a_row_do_not_grow_with_the_table(spark):
    cores = spark.sparkContext.defaultParallelism
    one = lambda a, b: pa.table({"n": [a.num_rows]})
    for n in (30_000, 60_000):
        rows = spark.range(n).select("id", F.array(F.col("id").cast("float")).alias("vec"))
        assert neighbours.by_blocks(rows, rows, one, "n long").count() <= (1 + (8 * cores) ** 0.5) ** 2


def test_a_written_table_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses
    before = set(manager().keys().toList().mkString(",").split(","))
    df, _ = session.materialize(spark.range(1000).repartition(4, F.col("id") % 7), "shuffled")
    for _ in range(50):
        left = set(manager().keys().toList().mkString(",").split(",")) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and df.count() == 1000

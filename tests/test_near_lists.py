"""Lists of near rows: how often a row is sent, what lists hold, and blocks where no pivot leaves a row out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.distances import pairwise
from tessera.operators import clusters, neighbours


def _frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, features array<double>")


def test_copies_of_a_row_do_not_grow_with_the_rows(spark, monkeypatch):
    """Every two rows are near, so an id has a list for each block it was sent to: as many as cores ask for; before, 63 at 500 rows."""
    monkeypatch.setattr(neighbours, "LIST_BLOCK", 8)
    most = []
    for n in (250, 500):
        x = np.random.default_rng(1).normal(size=(n, 6))
        rows, fitted = neighbours.copies_of(_frame(spark, x), 2.5, "cosine")
        lists = neighbours.near_lists(rows, 2.5, "cosine", fitted)
        assert lists.agg(F.sum(F.size("near"))).first()[0] == n * (n - 1)
        most.append(lists.groupBy("id").count().agg(F.max("count")).first()[0])
    assert max(most) <= np.ceil((8 * spark.sparkContext.defaultParallelism) ** 0.5)


@pytest.mark.parametrize("held", [5, 1 << 18])
@pytest.mark.parametrize("metric, threshold", [("cosine", 0.6), ("cosine", 0.05), ("euclidean", 1.1), ("cityblock", 2.0), ("jaccard", 0.4)])
def test_lists_hold_what_is_near(spark, monkeypatch, held, metric, threshold):
    monkeypatch.setattr(neighbours, "LIST_BLOCK", 16)
    monkeypatch.setattr(neighbours, "PIECE", 7)
    monkeypatch.setattr(neighbours, "HELD", held)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, size=(90, 9)).astype(float) if metric == "jaccard" else np.repeat(rng.normal(size=(9, 4)) * 3, 10, axis=0) + rng.normal(size=(90, 4)) * 0.3
    x[20:25], x[70] = x[3], 0
    df = _frame(spark, x, [i * 7 - 50 for i in range(90)]).union(spark.createDataFrame([(9_999, None)], "id long, features array<double>"))
    rows, fitted = neighbours.copies_of(df, threshold, metric)
    kept = {r["id"]: (np.array(r["vec"]), r["others"]) for r in rows.collect()}
    got = {}
    for r in neighbours.near_lists(rows, threshold, metric, fitted).collect():
        assert r["own"] == kept[r["id"]][1] and r["links"] == len(r["near"]) == len(r["weight"]) and r["rows"] == sum(r["weight"])
        for near, weight in zip(r["near"], r["weight"], strict=True):
            assert (r["id"], near) not in got
            got[r["id"], near] = weight
    ids = sorted(kept)
    d = pairwise(metric, np.array([kept[i][0] for i in ids]), np.array([kept[i][0] for i in ids]))
    assert got == {(i, j): kept[j][1] + 1 for a, i in enumerate(ids) for b, j in enumerate(ids) if i != j and d[a, b] <= threshold} and got


def test_blocks_are_even_where_pivots_leave_no_row_out(spark):
    x = np.random.default_rng(3).normal(size=(300, 32))
    rows = _frame(spark, x).withColumnRenamed("features", "vec")
    assert neighbours._by_pivots(rows, "cosine", 0.65, 6, 50) is None
    assert neighbours._by_pivots(rows, "cosine", 0.05, 6, 50) is not None
    blocks = neighbours._dealt(rows, "cosine", 0.65, 6, 50, 300).groupBy("own").count().collect()
    assert len(blocks) == 6


def test_ids_that_come_twice_and_few_rows(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.01, 1.0]])
    leaders = lambda df: sorted(tuple(r) for r in clusters.butina_cluster(df, metric="cosine", threshold=0.3).distinct().collect())
    assert leaders(_frame(spark, x, [1, 2, 5, 7])) == [(1, 1), (2, 1), (5, 5), (7, 5)]
    assert leaders(_frame(spark, x, [1, 1, 5, 7])) == [(1, 1), (5, 5), (7, 5)]
    assert leaders(_frame(spark, x[:1], [4])) == [(4, 4)]
    assert leaders(_frame(spark, x[:1], [4]).limit(0)) == []

"""Statistics of distances to rows with a larger id, without a row for each pair."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distances
from tessera.functions.distances import BINARY, METRICS, pairwise
from tessera.operators import clusters, neighbours, transforms


@pytest.mark.parametrize("metric", ["canberra", "jensenshannon", "seuclidean", "sqeuclid", "hamming", "braycurtis", "yule"])
def test_equal_to_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "PIECE", 5)
    r = np.random.default_rng(0)
    x = np.abs(r.normal(size=(60, 8))) if metric != "yule" else (r.random((60, 8)) > 0.5).astype(float)
    x[7] = x[3]
    ids = [i % 50 for i in range(60)]  # ten ids twice
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(99, None)], "id long, features array<double>")
    d = pairwise(metric, x, x, x.var(axis=0, ddof=1))
    got = {row["query_id"]: row for row in neighbours.larger_id_statistics(df, metric, block=13).collect()}
    assert set(got) == set(range(49))
    for i in got:
        own = np.concatenate([d[a][np.array(ids) > i] for a in range(60) if ids[a] == i])
        assert got[i]["n"] == len(own)
        assert [got[i][c] for c in ("least", "mean", "most")] == pytest.approx([own.min(), own.mean(), own.max()], abs=1e-9)


@pytest.mark.parametrize("metric", [m for m in METRICS if m not in (*BINARY, "mahalanobis")])
def test_products_and_pieces_equal_differences(metric):
    r = np.random.default_rng(1)
    a, b = np.abs(r.normal(size=(70, 6))), np.abs(r.normal(size=(530, 6)))
    b[:9], a[20], b[30], a[21, 2], b[31, 2] = a[:9], 0, 0, 0, 0
    b[9] = a[9] * (1 + 1e-9)
    slow = {
        "braycurtis": lambda x, y: abs(x - y).sum() / (abs(x + y).sum() or 1), "canberra": lambda x, y: sum(abs(p - q) / (abs(p) + abs(q) or 1) for p, q in zip(x, y, strict=True)),
        "chebychev": lambda x, y: abs(x - y).max(), "cityblock": lambda x, y: abs(x - y).sum(), "hamming": lambda x, y: (x != y).mean(),
        "euclidean": lambda x, y: np.sqrt(((x - y) ** 2).sum()), "sqeuclid": lambda x, y: ((x - y) ** 2).sum(),
    }
    got = pairwise(metric, a, b, b.var(axis=0), products=True)
    if metric in slow:
        assert got == pytest.approx(np.array([[slow[metric](x, y) for y in b] for x in a]), rel=1e-8, abs=1e-12)
    assert got == pytest.approx(pairwise(metric, a, b, b.var(axis=0)), rel=1e-8, abs=1e-12)


def test_steps_upon_steps(spark):
    """Within a lambda, inner steps were computed for every position of the outer: here 150 ** 4 times a row."""
    df = spark.range(40).select(F.array(*[F.lit(float(i)) + F.col("id") for i in range(150)]).alias("e"))
    for _ in range(4):
        df = df.withColumn("e", transforms.pick("e", list(range(149, -1, -1))))
    group = "nested picks"
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    timer = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        assert [r["e"] for r in df.collect()] == [[float(i + k) for i in range(150)] for k in range(40)]
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("metric", ["euclidean", "seuclidean", "cityblock", "cosine", "sqeuclid"])
def test_nearest_by_quick_distances_equal_sorted_ones(metric):
    from tessera.plans.nearest import _nearest

    r = np.random.default_rng(2)
    x, y = r.normal(size=(40, 5)) + 100, r.normal(size=(300, 5)) + 100
    y[200:] = y[:100]  # equal distances
    y[5] = x[3]
    fitted = y.var(axis=0)
    rows, at, d = _nearest(metric, x, y, 5, fitted)
    whole = pairwise(metric, x, y, fitted)
    best = np.argsort(whole, axis=1, kind="stable")[:, :5]
    assert rows.tolist() == np.repeat(np.arange(40), 5).tolist()
    assert d.reshape(40, 5) == pytest.approx(np.take_along_axis(whole, best, axis=1), rel=1e-12)
    if metric not in ("cosine",):
        assert at.reshape(40, 5).tolist() == best.tolist()
    assert len(_nearest(metric, x, y[:3], 5, fitted)[0]) == 120


@pytest.mark.parametrize("limits", [(40, 65_536, 1_000), (200, 3, 1_000), (40, 65_536, 0)])
def test_butina_steps_equal_the_sequential_rule(spark, monkeypatch, limits):
    """Copies, bounded steps and leaders sought everywhere give what one leader at a time gives."""
    for name, value in zip(("LINKS", "CANDIDATES", "APART"), limits, strict=True):
        monkeypatch.setattr(clusters, name, value)
    rng = np.random.default_rng(5)
    x = rng.random((90, 2))
    x[60:75], x[80:83] = x[7], x[11]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(rng.permutation(90), x, strict=True)] + [(500, None)], "id long, features array<double>")
    at = {r["id"]: r["features"] for r in df.collect() if r["features"]}
    left, want = set(at), {500: 500}
    near = {i: {j for j in at if np.hypot(*np.subtract(at[i], at[j])) <= 0.12} for i in at}
    while left:
        lead = min(left, key=lambda i: (-len(near[i] & left), i))
        for j in near[lead] & left:
            want[j] = lead
        left -= near[lead]
    assert {r["id"]: r["Leader"] for r in clusters.butina_cluster(df, metric="euclidean", threshold=0.12).collect()} == want


def test_butina_copies_that_are_not_near_themselves_stay_apart(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(3)] + [(8, [1.0, 0.0]), (9, [1.0, 0.0])], "id long, features array<double>")
    assert {r["id"]: r["Leader"] for r in clusters.butina_cluster(df, metric="cosine", threshold=0.5).collect()} == {0: 0, 1: 1, 2: 2, 8: 8, 9: 8}


def test_butina_takes_many_leaders_in_a_step(spark, monkeypatch):
    """Rows all within two links of each other had one leader a round; now their steps are few."""
    written = []
    keep = clusters.materialize
    monkeypatch.setattr(clusters, "materialize", lambda df, name: written.append(name) or keep(df, name))
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))], "id long, features array<double>")
    assert clusters.butina_cluster(df, metric="cosine", threshold=0.65).select("Leader").distinct().count() > 20
    assert written.count("butina-taken") == 1


@pytest.mark.parametrize("metric", [*BINARY, "hamming"])
def test_distances_of_words_are_those_of_counts(metric):
    """Looked-up distances of up to 64 bits equal the formula that longer vectors use."""
    r = np.random.default_rng(8)
    for n in (1, 7, 64):
        a, b = ((r.random((m, n)) > 0.4).astype(float) for m in (30, 20))
        a[0], a[1], b[0], b[1] = 0, 1, 0, 1
        counts = distances._of_counts(metric, n, a @ b.T, a.sum(1)[:, None], b.sum(1)[None, :])
        assert (pairwise(metric, a, b) == counts).all()
        assert len(distances._looked_up(metric, n)) == (n + 1) ** 3


def test_cityblock_from_minima_keeps_its_digits(monkeypatch):
    r = np.random.default_rng(9)
    a = r.normal(size=(40, 8)) * 1e6
    b = np.concatenate([a[:10], a[10:20] + 1e-7, r.normal(size=(5, 8))])
    b[3, 2] = np.nan
    want = np.abs(a[:, None] - b[None]).sum(-1)
    assert np.allclose(distances._cityblock(a, b), want, rtol=1e-9, atol=0, equal_nan=True)

"""Quantiles by ranks, trimming of large keys, half block pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.distances import pairwise
from tessera.operators import components, duplicates, neighbours
from tessera.operators.ranking import quantiles, vector_quantiles
from tessera.plans import evaluation, plot_data


def test_quantiles_equal_numpy(spark):
    r = random.Random(1)
    rows = [(k, round(r.gauss(0, 5), r.choice((0, 3)))) for k in ("a", "b", None) for _ in range(200)] + [("a", None), ("b", float("nan")), ("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x["k"]: x["q"] for x in quantiles(df, "v", [0.05, 0.5, 0.9], ("k",)).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for k, q in got.items():
        assert q == pytest.approx(np.quantile([v for key, v in rows if key == k and v is not None and v == v], [0.05, 0.5, 0.9]))
    whole = quantiles(df, "v", [0.25]).collect()
    assert whole[0]["q"] == pytest.approx([np.quantile([v for _, v in rows if v is not None and v == v], 0.25)])
    assert quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_large_keys_are_trimmed_alike(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, r.gauss(k, 0.2) + (r.choice((0, 0, 0, 9)) if k % 2 else 0)) for k in range(12) for _ in range(5 + 3 * k)] + [(50, 1.0), (50, 1.0), (50, 8.0)]
    df = spark.createDataFrame(rows, "dd_key int, pIC50 double")
    show = lambda: sorted((x["dd_key"], None if x["pIC50"] is None else round(x["pIC50"], 9)) for x in duplicates.mad_duplicates(df).distinct().collect())
    whole = show()
    assert len({k for k, _ in whole}) == 13
    monkeypatch.setattr(duplicates, "WHOLE", 10)
    assert show() == whole


def test_near_pairs_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, features array<double>")
    got = sorted((r["src"], r["dst"]) for r in neighbours.near_pairs(df, 1.5, "euclidean").collect())
    assert got == [(i, j) for i in range(40) for j in range(i + 1, 40) if np.linalg.norm(x[i] - x[j]) <= 1.5] and got


def test_normal_quantile(spark):
    import statistics

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.98, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(plot_data.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([statistics.NormalDist().inv_cdf(p) for p in ps], abs=1e-7)


def test_digits_find_the_quantiles(spark):
    r = random.Random(4)
    rows = [[r.gauss(0, 1e-3), r.choice((-0.0, 0.0, -1.5)), None if i % 3 else r.uniform(-1e300, 1e300), float("nan"), float(i), 5e-324 * (i % 4)] for i in range(500)] + [None, []]
    df = spark.createDataFrame([(v,) for v in rows], "v array<double>").repartition(3)
    ps = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    got = vector_quantiles(df, "v", ps)
    assert sorted(got) == [0, 1, 2, 4, 5]
    for i in got:
        assert got[i] == pytest.approx(np.quantile([v[i] for v in rows if v and v[i] is not None], ps), rel=1e-12, abs=1e-320)
    assert vector_quantiles(df.where("size(v) = 0"), "v", ps) == {}
    assert vector_quantiles(spark.createDataFrame([([7.5],)], "v array<double>"), "v", [0.25]) == {0: [7.5]}


def test_forests_link_what_all_pairs_link(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 9)
    monkeypatch.setattr(evaluation, "BLOCK", 9)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(60, 2)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    every = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(60) for j in range(i + 1, 60))
    every = [e for e in every if e[0] <= 0.6]

    def kruskal(edges):
        root, kept = list(range(60)), []
        for w, i, j in edges:
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append((w, i, j))
        return kept

    pairs = neighbours.near_pairs(df, 0.6, "euclidean", spanning=True)
    forest = components.minimum_spanning_forest(pairs)
    want = kruskal(every)
    assert sorted((r["src"], r["dst"]) for r in forest.collect()) == sorted((i, j) for _, i, j in want)
    assert pairs.count() <= len(every)
    whole = components.minimum_spanning_forest(spark.createDataFrame(every, "distance double, src long, dst long"))
    assert sorted(r["distance"] for r in whole.collect()) == pytest.approx([w for w, _, _ in want])
    assert components.minimum_spanning_forest(spark.createDataFrame([], "distance double, src long, dst long")).count() == 0
    for t, clusters in evaluation.threshold_clusters(df, [0.3, 0.6, 0.15], "euclidean"):
        sizes = 60 - len([w for w, _, _ in want if w <= t])
        got = [r["Cluster"] for r in clusters.collect()]
        assert len(got) == 60 and len(set(got)) == sizes and max(got) == sizes - 1


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "jaccard", "dice", "cityblock"])
def test_bounds_lose_no_near_pair(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 12)
    monkeypatch.setattr(neighbours, "PIVOTS", 10)
    rng = np.random.default_rng(6)
    if metric in ("jaccard", "dice"):
        sizes = np.repeat([2, 6, 15, 28], 30)
        x = np.array([np.isin(np.arange(40), rng.permutation(32)[:s]) for s in sizes], float)
        x[::7] = x[(np.arange(0, 120, 7) + 3) % 120]
        x[5] = 0
    else:
        x = np.repeat(rng.normal(size=(10, 6)) * 9, 12, axis=0) + rng.normal(size=(120, 6)) * 0.4
        x[7] = 0
    df = spark.createDataFrame([(int(i * 31 - 60), v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "id long, features array<double>")
    threshold = {"euclidean": 1.0, "cosine": 0.01, "jaccard": 0.45, "dice": 0.3, "cityblock": 2.0}[metric]
    d = pairwise(metric, x, x)
    want = sorted((i * 31 - 60, j * 31 - 60) for i in range(120) for j in range(i + 1, 120) if d[i, j] <= threshold)
    report = {}
    got = sorted((r["src"], r["dst"]) for r in neighbours.near_pairs(df, threshold, metric, report=report).collect())
    assert got == want and want and report["all"] == 120 * 119 // 2
    assert report["visited"] == report["all"] if metric == "cityblock" else report["visited"] < report["all"] * 0.7


def test_a_key_stays_whole_above_a_join_that_turns_into_a_broadcast(spark, tmp_path):
    from tessera.sources import tables

    r = random.Random(3)
    rows = [(f"key {r.randrange(40)}", str(r.randint(200, 700)), "t") for _ in range(20_000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "`Ligand InChI Key` string, `IC50 (nM)` string, `Target Name` string").repartition(8).write.parquet(path)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {x["dd_key"]: x["pIC50"] for x in tables.preprocess_binding(spark.read.parquet(path)).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == 40
    assert all(v == pytest.approx(np.mean([-np.log10(float(x) / 1e9) for key, x, _ in rows if f"{key}|t" == k]), abs=1e-9) for k, v in got.items())


def test_values_at_the_edge_of_a_bin(spark):
    # 25 bins from 0 to 400.25, edges as multiples of the width that the density is divided by.
    width = 400.25 / 25
    values = [0.0, 400.25, *[k * width for k in range(1, 25)], *[round(k * width, 2) for k in range(1, 25)]]
    got = {x["bin"]: x["n"] for x in plot_data.histogram(spark.createDataFrame([("a", float(v)) for v in values], "g string, v double"), "v", "g").collect()}
    bins = [min(int(np.floor(v / width)) + 1, 25) for v in values]
    assert got == {b: bins.count(b) for b in set(bins)}

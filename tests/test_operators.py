import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import distributions, scalars, smiles, text, vectors
from tessera.functions.distances import METRICS, pairwise
from tessera.operators import batches, clusters, components, duplicates, metrics, neighbours, ranking, splits, stats, topics, transforms
from tessera.plans import evaluation, plot_data
from tessera.sources import tables
from tessera.streaming import losses

BASE = [("CCO", 0.1, 0, 1), ("CCN", 0.2, 0, 2), ("CCC", 0.1, 1, 3), ("CCCl", 0.2, 1, 4), ("CCBr", 0.1, 2, 5), ("CCF", 0.2, 2, 6)]


@pytest.fixture
def base(spark):
    return spark.createDataFrame(BASE, "SMILES string, Y double, Cluster int, Time int")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 5)]
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "src long, dst long")), "id"))
    assert {got[i] for i in range(1, 31)} == {1} and {got[100 + i] for i in range(40)} == {100} and 200 not in got
    empty = components.connected_components(spark.createDataFrame([], "src long, dst long"))
    assert empty.count() == 0


@pytest.mark.parametrize("metric", METRICS)
def test_metric_identity_and_symmetry(metric):
    rng = np.random.default_rng(1)
    x = (rng.random((6, 8)) > 0.5).astype(float) if metric not in ("jensenshannon",) else rng.random((6, 8))
    x[:, 0] = 1
    fitted = np.ones(8) if metric == "seuclidean" else np.eye(8)
    d = pairwise(metric, x, x, fitted)
    assert np.allclose(d, d.T)
    if metric not in ("kulczynski1", "russellrao"):
        assert np.allclose(np.diag(d), 0, atol=1e-7)


def test_distance_values():
    a, b = np.array([[0.0, 1], [1, 0]]), np.array([[0.0, 1]])
    assert pairwise("euclidean", a, b).tolist() == [[0.0], [math.sqrt(2)]]
    assert pairwise("jaccard", np.array([[1, 0, 1]]), np.array([[1, 1, 0]]))[0, 0] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        pairwise("jaccard", np.array([[2.0]]), np.array([[1.0]]))
    with pytest.raises(ValueError):
        pairwise("nope", a, b)


def test_k_neighbors_self_and_short_tables(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0, 0.0]), (1, [1.0, 0.0, 1.0]), (2, [0.0, 0.0, 1.0]), (3, None)], "id long, features array<double>")
    got = {r["id"]: r for r in neighbours.k_neighbors_distance(v, None, "hamming", [1, 9], [1]).collect()}
    assert got[0]["min"] == pytest.approx(2 / 3) and got[0]["max"] == 1.0 and got[1]["nearest_1"] == pytest.approx(1 / 3)
    assert got[0]["nearest_9"] == pytest.approx(got[0]["mean"]) and 3 not in got


def test_group_neighbours_with_lists(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0], ["a"]), (1, [1.0, 0.0], ["a", "b"]), (2, [1.0, 1.0], ["b"])], "id long, x array<double>, g array<string>")
    got = {(r["scope"], r["grp"], r["id"]): r["min"] for r in neighbours.group_k_neighbors_distance(v, "x", "g", "hamming", [1]).collect()}
    assert got[("Intra", "a", 0)] == 1.0 and got[("Intra", "b", 1)] == 0.5 and got[("Inter", "a", 1)] == 0.5
    assert ("Inter", "b", 2) in got


def test_butina_equals_sequential_rule(spark):
    rng = np.random.default_rng(3)
    x = rng.random((80, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = dict(rows(clusters.butina_cluster(df, metric="euclidean", threshold=0.15), "id"))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.15
    left, want = set(range(80)), {}
    while left:
        lead = min(left, key=lambda i: (-sum(near[i, j] for j in left if j != i), i))
        for j in [j for j in left if near[lead, j]]:
            want[j] = lead
            left.discard(j)
    assert got == want


def test_splits(base):
    assert sorted(r["Time"] for r in splits.temporal_split(base, "Time", 0.33).where("Set = 'Test'").collect()) == [4, 5, 6]
    assert splits.minimal_train_test_split(base, 0.33, 0.05).where("Set = 'Test'").count() == 2
    with pytest.raises(splits.InfeasibleSplit):
        splits.minimal_train_test_split(base.withColumn("Cluster", F.lit(1)), 0.33)
    assert splits.random_train_test_split(base, 0.34, "SMILES").where("Set = 'Test'").count() == 2
    folds = splits.group_kfold_split(base, "Cluster", 3)
    assert folds.groupBy("Cluster").agg(F.countDistinct("Fold").alias("n")).where("n > 1").count() == 0
    strat = splits.stratified_group_kfold_split(base, "Y", "Cluster", 3)
    assert strat.count() == 6 and strat.groupBy("Cluster").agg(F.countDistinct("Fold").alias("n")).where("n > 1").count() == 0
    assert splits.are_folds_balanced(folds)
    out = splits.clustered_kfold_split(base.drop("Cluster"), base, "SMILES", n_folds=3)
    assert out.count() == 6
    manager = splits.FoldManager(folds, "Fold", 0)
    assert manager.train(1).count() + manager.evaluation(1).count() == manager.non_test().count()
    with pytest.raises(ValueError):
        manager.train(0)
    with pytest.raises(KeyError):
        splits.validate_frame(base, "nope")
    assert splits.SetManager(splits.temporal_split(base, "Time")).test().count() >= 1


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)] + [(None,)], "x double")
    assert [r["bin"] for r in scalars.bin_column(df, "x", 3).orderBy("x").collect()] == [None, 1, 1, 2, 3, 3]
    v = spark.createDataFrame([([1, 0, 1, 0],)], "v array<int>")
    assert v.select(scalars.to_bit_string(F.col("v")), scalars.pack_bits(F.col("v"))).first()[:] == ("1010", 10)
    with pytest.raises(Exception, match="0/1"):
        spark.createDataFrame([([1, 2, 0],)], "v array<int>").select(scalars.to_bit_string(F.col("v"))).collect()
    r = spark.createDataFrame([(1234.567,), (0.0,), (-0.00123456,)], "x double").select(scalars.round_to_significant(F.col("x"), 3))
    assert [x[0] for x in r.collect()] == pytest.approx([1230.0, 0.0, -0.00123])


def test_mad_golden(spark):
    data = [("a", 5.0), ("a", 5.4), ("b", 5.0), ("b", 5.1), ("b", 5.2), ("b", 9.0), ("c", 5.0), ("c", 5.0), ("c", 5.0), ("c", 9.0), ("d", 7.0), (None, 1.0), ("e", None), ("e", 4.0)]
    got = rows(duplicates.mad_duplicates(spark.createDataFrame(data, "dd_key string, pIC50 double")), "dd_key")
    want = {"a": 5.2, "b": 5.1, "c": None, "d": 7.0, None: None, "e": 4.0}
    assert len(got) == len(data)
    for k, v in got:
        assert v == (None if want[k] is None else pytest.approx(want[k]))


def test_censored_golden(spark):
    data = [("x", 5.0, "="), ("x", 7.0, ">"), ("y", 5.0, ">"), ("y", 5.5, "<"), ("z", 6.0, ">"), ("z", 6.4, ">"), ("w", 1.0, "<"), ("v", 5.0, "="), ("v", 4.0, ">"), ("u", 8.0, ">"), ("u", 5.0, "<")]
    df = duplicates.mad_censored_duplicates(spark.createDataFrame(data, "dd_key string, p_value double, standard_relation string"))
    got = {r[0]: (r[1], r[2]) for r in df.collect()}
    assert got == {"x": (None, None), "y": (5.25, "="), "z": (6.4, ">"), "w": (1.0, "<"), "v": (5.0, "="), "u": (None, None)}


def test_unit_error_and_copies(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 8.0), ("b", 5.0), ("b", 7.0), ("c", None)], "k string, v double")
    assert rows(duplicates.check_unit_error(df, "k", "v"), "k") == [("a", True), ("b", False), ("c", False)]
    assert duplicates.drop_all_copies(df, ["k"]).count() == 1
    assert duplicates.duplicated_mask(spark.createDataFrame([(None,), (None,), ("x",)], "k string"), ["k"]).where("duplicated").count() == 2


def test_masked_loss_golden(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, nan, 0.0, 2.0, 1.0, 2.0, ["A"]), (nan, 3.0, 1.0, 1.0, 0.5, 1.0, ["A", "B", "nan", "A"])], "t1 double, t2 double, p1 double, p2 double, w1 double, w2 double, tags array<string>")
    loss = metrics.masked_loss(df, ["t1", "t2"], ["p1", "p2"], ["w1", "w2"], "tags")
    got = {(r[0], r[1]): (r[2], r[3]) for r in loss.collect()}
    assert got[("total", "total")] == (4.0, 2.0) and got[("label", "B")] == (4.0, 1.0) and ("label", "nan") not in got
    twice = {(r[0], r[1]): r[2] for r in metrics.combine_losses(loss, loss).collect()}
    assert twice[("total", "total")] == 8.0
    assert {(r[0], r[1]): r[2] for r in metrics.normalize_loss(loss).collect()}[("total", "total")] == 2.0


def test_mann_whitney_small_sample(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    r = stats.mann_whitney(df, "v", "g", "a", "b").first()
    assert r["u"] is None and r["low_n"]
    big = spark.createDataFrame([("a", float(i + 20)) for i in range(20)] + [("b", float(i)) for i in range(20)], "g string, v double")
    r = stats.mann_whitney(big, "v", "g", "a", "b").first()
    assert r["u"] == 400.0 and r["outcome"] == "a > b" and r["effect"] == "Large" and r["p"] < 1e-5


def test_u_is_counted_without_ties(spark):
    from itertools import combinations

    for n1 in range(1, 9):
        for n2 in range(1, 6):
            every = [sum(r - k for k, r in enumerate(pick)) for pick in combinations(range(n1 + n2), n1)]
            for u in range(n1 * n2 + 1):
                assert stats.u_tail(u, n1, n2) == pytest.approx(sum(x >= u for x in every) / len(every), abs=1e-12)
    assert stats.u_tail(8 * 5000 * 0.9, 8, 5000) == pytest.approx(stats.u_tail(8 * 5000 * 0.9, 5000, 8)) and 0 < stats.u_tail(8 * 5000, 8, 5000) < 1e-20
    a, b = [1.1, 2.2, 3.3, 9.0], [4.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    u = sum(x > y for x in a for y in b)
    every = [sum(r - k for k, r in enumerate(pick)) for pick in combinations(range(9), 4)]
    low = sum(x <= u for x in every) / len(every)
    assert stats.mann_whitney(df, "v", "g", "a", "b").first()["p"] == pytest.approx(2 * low)
    assert stats.mann_whitney(df, "v", "g", "a", "b", alternative="less").first()["p"] == pytest.approx(low)
    assert stats.mann_whitney(df, "v", "g", "a", "b", alternative="greater").first()["p"] == pytest.approx(sum(x >= u for x in every) / len(every))


def test_normal_tail(spark):
    from statistics import NormalDist

    zs = [-9.0, -3.1, -3.0, -1.2, -1e-9, 0.0, 0.5, 1.0, 2.9, 2.999, 3.0, 3.001, 5.0, 8.0, 20.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(distributions.normal_tail(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) / 2 for z in zs], rel=1e-11) and NormalDist().cdf(-1.0) == pytest.approx(got[7])


def test_random_intercept_recovers(spark):
    rng = np.random.default_rng(0)
    data = [(g, float(x), float(2 + 0.5 * x + b + rng.normal(0, 0.5))) for g, b in enumerate(rng.normal(0, 1.0, 60)) for x in rng.random(20) * 4]
    df = spark.createDataFrame(data, "g long, x double, y double")
    fit = stats.random_intercept(df, "y", ["x"], "g")
    assert fit["coefficients"]["x"] == pytest.approx(0.5, abs=0.05) and fit["icc"] == pytest.approx(0.8, abs=0.1)
    assert stats.mixed_formula(df.withColumn("one", F.lit(1)), "y", ["x", "one"], ["g"]) == ("y ~ x + (1 | g)", ["one"])


def test_transformer_golden(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 0.0, 1.0],), ([2.0, 0.0, nan],), ([3.0, 0.0, 2.0],), ([4.0, 0.0, 3.0],)], "X array<double>")
    assert transforms.fit_masks(df, "X") == [0]
    assert transforms.fit_imputer(df, "X") == [2.5, 0.0, 2.0]
    two = spark.createDataFrame([([float(i), float(i * 2), float(i % 3)],) for i in range(12)], "X array<double>")
    assert transforms.fit_corr(two, "X") == [1, 2]
    t = transforms.FeatureTransformer(corr=True, imputer=True, selector=True, scaler=True)
    assert t.fit_transform(two, "X").count() == 12
    again = transforms.FeatureTransformer.from_json(t.to_json()).transform(two, "X").first()
    assert again == t.transform(two, "X").first()
    with pytest.raises(KeyError):
        transforms.preset("nope")
    assert two.select(transforms.apply_clipper("X", [1.0, 1.0, 1.0]).alias("c")).agg(F.max(F.col("c")[0])).first()[0] == 1.0


def test_text(spark):
    df = spark.createDataFrame([(1, "The cat and THE dog42 ran"), (2, None)], "id long, t string")
    assert [r[0] for r in df.orderBy("id").select(text.tokenize(F.col("t"))).collect()] == [["cat", "ran"], []]
    mol = spark.createDataFrame([(1, "CCl"), (2, "CBr")], "id long, s string")
    vocab = {r["token"]: r["id"] for r in text.vocabulary(mol, "s", "id").collect()}
    assert vocab == {"<pad>": 0, "C": 1, "Cl": 2, "Br": 3, "<unk>": 4}
    enc = text.encode(mol, "s", vocab, 4).orderBy("id").collect()
    assert enc[0]["tokens"] == [1, 2, 0, 0] and enc[0]["length"] == 2
    assert text.encode(mol, "s", vocab, 4).select(text.decode(F.col("tokens"), vocab)).orderBy("id").first()[0] == "CCl"
    with pytest.raises(Exception, match="max_length"):
        text.encode(mol, "s", vocab, 1).collect()
    words = spark.createDataFrame([("abc",), ("zzz",), ("abd",)], "w string")
    got = text.similar_strings(words.limit(1), words, "w", "w", "fuzzy", 0.6)
    assert {(r["target"], r["similarity"]) for r in got.collect()} == {("abc", 1.0), ("abd", 0.667)}
    assert text.indel_ratio("kitten", "sitting") == pytest.approx(8 / 13)


def test_smiles(spark):
    df = spark.createDataFrame([("CCO",), ("c1ccccc1",), ("not-a-smiles",), ("[Na+].[Cl-]",), ("C[Fe]",), (None,), ("",), ("CCO",)], "SMILES string")
    got = {r[0]: r[1] for r in smiles.validate(df).collect()}
    assert got["CCO"] == "" and got["not-a-smiles"] == "Invalid SMILES" and got[None] is None and got[""] == "Empty string"
    assert {r[0]: r["Filtered"] for r in smiles.filter_inorganic(df).collect()}["[Na+].[Cl-]"] is None
    assert {r[0]: r["Organometallics"] for r in smiles.flag_organometallics(df).collect()}["C[Fe]"] == "Fe"
    assert {r[0]: r["Uncommon"] for r in smiles.flag_uncommon(df).collect()}["[Na+].[Cl-]"] == "Na"
    assert smiles.largest_fragment("[Na+].CC(=O)[O-]") == "CC(=O)[O-]"
    assert smiles.parse("C1CC1")[1][-1][:2] == (0, 2) and smiles.parse("C1CC") is None and smiles.parse("C(") is None
    g = {r[0]: r["graph"] for r in smiles.molecule_graph(df).collect()}
    assert g["CCO"]["src"][:4] == [0, 1, 1, 2] and g["not-a-smiles"] is None and len(g["CCO"]["x"]) == 4
    assert g["c1ccccc1"]["ring"] == [1] * 6 + [0] and set(g["c1ccccc1"]["kind"]) == {4, 0} and g["CCO"]["degree"] == [1, 2, 1, 0]
    with pytest.raises(smiles.MissingToolkit):
        smiles.key_transform(df, "ecfp")
    smiles.register_key_transform("length_of", len, "int")
    assert smiles.key_transform(df, "length_of").where("SMILES = 'CCO'").count() == 2
    kept, note = smiles.within_bounds({"MolWt": "w"}, {"MolWt": smiles.EXTREME_BOUNDS["MolWt"]})
    assert spark.createDataFrame([(10.0,)], "w double").select(kept, note).first()[:] == (False, "MolWt: 10.00 < 32")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, s string")
    for kind in ("csv", "tsv", "parquet", "json", "orc"):
        path = f"{tmp_path}/t.{kind}"
        assert tables.write_table(df, path)
        assert tables.read_table(spark, path).count() == 2
    assert not tables.write_table(df.where("k > 5"), f"{tmp_path}/empty.csv")
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.unknown")
    (tmp_path / "m.sdf").write_text("mol\n  x\n\nM  END\n> <A>\n1\n\n> <B>\ntwo\n\n$$$$\nmol2\n\nM  END\n> <A>\n3\n\n$$$$\n")
    got = {r["title"]: r["properties"] for r in tables.read_sdf(spark, str(tmp_path / "m.sdf")).collect()}
    assert got == {"mol": {"A": "1", "B": "two"}, "mol2": {"A": "3"}}
    a = spark.createDataFrame([(">1500",), ("20",), ("x",)], "v string").select(tables.parse_affinity(F.col("v")).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in a] == [(1.5, "uM", ">"), (0.02, "uM", "="), (None, "uM", "=")]
    xml = "<article><article-meta><title-group><article-title>T</article-title></title-group></article-meta><abstract><p>One</p><p>two</p></abstract><kwd>b</kwd><kwd>a</kwd><kwd>b</kwd></article>"
    r = tables.article_fields(spark.createDataFrame([(xml,)], "xml string")).first()
    assert r["title"] == "T" and r["doi"] == "" and r["abstract"] == "One two" and r["keywords"] == ["a", "b"]
    assert spark.createDataFrame([('{"records":[{"pmid":"7"}]}',)], "j string").select(tables.id_conversion(F.col("j"))["pmid"]).first()[0] == "7"
    with pytest.raises(RuntimeError):
        tables.resolve(df, "s", lambda n: {})
    assert tables.resolve(df, "s", lambda n: {x: x.upper() for x in n}, enabled=True).where("resolved = 'A'").count() == 1


def test_ingest(spark):
    binding = spark.createDataFrame([("100", "k1", "t"), ("110", "k1", "t"), (">50", "k2", "t"), ("100", "k3", "t"), ("100000", "k3", "t"), ("", "k4", "t")], "`IC50 (nM)` string, `Ligand InChI Key` string, `Target Name` string")
    out = tables.preprocess_binding(binding).collect()
    assert [r["Ligand InChI Key"] for r in out] == ["k1"] and out[0]["pIC50"] == pytest.approx(6.98, abs=0.01)
    names = "`Smiles` string, `Standard Type` string, `Standard Relation` string, `Standard Value` string, `Standard Units` string, `pChEMBL Value` string, `Data Validity Comment` string, `Target Type` string, `Assay Organism` string, `Assay Description` string, `Target ChEMBL ID` string"
    good = ("CCO", "IC50", "'='", "100", "nM", "7.0", "", "SINGLE PROTEIN", "Homo sapiens", "assay", "T1")
    mutant = (*good[:9], "A Mutant assay", "T2")
    out = tables.preprocess_chembl(spark.createDataFrame([good, mutant], names))
    assert [r["pChEMBL_Value"] for r in out.collect()] == [7.0]
    assert "dd_key" in tables.preprocess_chembl(spark.createDataFrame([], names)).columns


def test_plans(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(a), float(b)], float(3 * a + b), int(a > 0.5)) for i, (a, b) in enumerate(rng.random((90, 2)))]
    df = splits.random_kfold_split(spark.createDataFrame(data, "id long, x array<double>, y double, c int"), "id", 3)
    make = lambda **p: evaluation.Unit("LinearRegression", "x", "y", **p)
    ensemble, _, mean = evaluation.kf_evaluate(make, df)
    r2 = mean.where("Set = 'Testing' and Metric = 'R2'").first()["Mean"]
    assert r2 > 0.99
    assert ensemble.predict(df).count() == 90
    assert evaluation.search(make, df, evaluation.grid_parameters({"regParam": [0.0, 5.0]}), "RMSE")[0] == {"regParam": 0.0}
    unit = evaluation.Unit("LogisticRegression", "x", "c")
    out = evaluation.tt_evaluate(unit, splits.random_train_test_split(df, 0.3, "id"))
    assert out.where("Metric = 'ROC AUC' and Set = 'Testing'").first()["Value"] > 0.9
    assert 0 in evaluation.sequential_selection(make, df, "x", 1, "RMSE")
    assert evaluation.random_parameters(evaluation.SPACES["LinearSVC"], 1)["regParam"] <= 1
    with pytest.raises(KeyError):
        evaluation.get_model("nope")
    sweep = evaluation.threshold_sweep(df, [0.01, 0.9], 0.2, 0.05, "euclidean", "id", "x").orderBy("threshold").collect()
    assert sweep[0]["feasible"] and not sweep[1]["feasible"]


def test_plot_data(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)], "g string, v double")
    assert plot_data.ecdf(df, "v", "g").where("v = 4").first()["ecdf"] == 0.5
    assert plot_data.histogram(df, "v", "g", 3).agg(F.sum("n")).first()[0] == 10
    q = plot_data.qq_points(df, "v", "g").orderBy("observed").collect()
    assert q[0]["theoretical"] == pytest.approx(-q[-1]["theoretical"])
    assert plot_data.without_outliers(df.union(spark.createDataFrame([("a", 1e6)], "g string, v double")), ["v"], 2.0).count() == 10
    assert plot_data.normal_curve(df, "v").count() == 100
    assert plot_data.labelled({"x": df, "y": df}).where("Dataset = 'y'").count() == 10
    assert plot_data.residuals(df.withColumn("p", F.lit(1.0)), "v", "p").where("residual = 8").count() == 1
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, features array<double>")
    assert plot_data.k_neighbours_ecdf(v.where("id < 3"), v.where("id >= 3"), "euclidean", [1], []).where("Aggregation = 'min'").count() == 3


def test_batches(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1), float(i)) for i in range(3)], "id long, tokens array<int>, t double")
    ready = batches.validate_modalities(df, {"id": "group", "tokens": "tokens", "t": "target"})
    assert ready.where("y_wgts = 1").count() == 3
    with pytest.raises(ValueError):
        batches.validate_modalities(df, {"tokens": "tokens"})
    one = batches.numbered_batches(df, "id", 2).withColumn("batch", F.lit(0))
    masks = sorted(sum(r["mask"]) for r in batches.collate_tokens(one).collect())
    assert masks == [1, 2, 3] and {len(r["padded"]) for r in batches.collate_tokens(one).collect()} == {3}
    graphs = smiles.molecule_graph(spark.createDataFrame([("CC", 0, 0), ("CCO", 0, 1)], "SMILES string, batch int, place int"))
    got = batches.collate_graphs(graphs).orderBy("place").collect()
    assert got[1]["offset"] == 3 and min(got[1]["src"]) == 3


def test_topics(spark):
    docs = [(i, ["sun", "sky", "day"] if i % 2 else ["code", "bug", "test"]) for i in range(20)]
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    words, best = topics.lda_topics(df, "tokens", "id", 2, 0.9, 2, 5, 3)
    assert words.count() == 6 and best.count() == 20
    assert topics.coherence(df, "tokens", words).count() == 2


def test_streaming_loss_equals_batch(spark, tmp_path):
    rows_ = spark.range(200).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("y"), F.lit(1.0).alias("p"), F.lit(2.0).alias("w"), (F.col("id") % 2).alias("g"))
    rows_.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows_.schema).parquet(f"{tmp_path}/in")
    q = losses.windowed_loss(stream, "ts", "y", "p", "w", "g").writeStream.outputMode("complete").format("memory").queryName("loss_out").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("loss_out").agg(F.sum("loss"), F.sum("weight")).first()
    want = metrics.masked_loss(rows_, ["y"], ["p"], ["w"]).where("scope = 'total'").first()
    assert got[0] == pytest.approx(want["loss"]) and got[1] == want["weight"]


def test_vectors_and_logs(spark, tmp_path):
    df = spark.createDataFrame([([0.2, 0.5, 0.1],), ([0.4, 0.3, 0.9],)], "v array<double>")
    r = df.select(vectors.k_smallest(F.col("v"), 2), vectors.k_largest(F.col("v"), 9)).collect()
    assert r[0][0] == [0.1, 0.2] and r[1][1] == [0.9, 0.4, 0.3]
    assert [x["values"] for x in vectors.k_smallest_by_position(df, "v", 1).orderBy("position").collect()] == [[0.2], [0.3], [0.1]]
    assert [x["values"] for x in vectors.k_largest_by_position(df, "v", 1).orderBy("position").collect()] == [[0.4], [0.5], [0.9]]
    assert vectors.validate_features(df, "v") == 3
    with pytest.raises(ValueError):
        vectors.validate_features(df.union(spark.createDataFrame([([1.0],)], "v array<double>")), "v")
    with pytest.raises(ValueError):
        vectors.validate_targets(df, "v")
    (tmp_path / "a.log").write_text("< protein_path > : < p.pdb >\nx Affinity: -7.5 (kcal/mol)\nAffinity:  -8.25 (kcal/mol)\n")
    r = tables.read_dock_logs(spark, str(tmp_path / "a.log")).first()
    assert r["score"] == -8.25 and r["parameters"] == {"protein_path": "p.pdb"}
    art = spark.createDataFrame([("The quick Foxes", ["b", "a", "b"])], "abstract string, keywords array<string>")
    assert tables.article_tokens(art).first()["tokens"] == ["quick", "foxes"]


def test_running_sum(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i, 1) for i in range(50)], "g string, k long, v int")
    got = {r["k"]: r["s"] for r in ranking.running_sum(df.repartition(5), ["k"], "v", "s", ("g",)).collect()}
    assert got[0] == 1 and got[48] == 17 and got[49] == 33
    assert ranking.running_sum(df.limit(0), ["k"], "v", "s").count() == 0


def test_vocabulary_is_numbered_over_ranges(spark):
    rows = [(i, [f"t{i * k % 211}" for k in range(9)]) for i in range(300)]
    got = text.vocabulary(spark.createDataFrame(rows, "id long, s array<string>"), "s", "id", None)
    # A row number over the whole table would be one task.
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    seen = {}
    for i, words in rows:
        for k, w in enumerate(words):
            n, first = seen.get(w, (0, (i, k)))
            seen[w] = (n + 1, first)
    order = sorted(seen, key=lambda w: (-seen[w][0], seen[w][1]))
    want = {"<pad>": 0, "<unk>": len(order) + 1} | {w: k for k, w in enumerate(order, 1)}
    assert {r["token"]: r["id"] for r in got.collect()} == want


def test_nearest_neighbour_models(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = (x[:, 0] > 0).astype(float)
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (1000, None, 1.0)], "id long, x array<double>, y double").coalesce(1)
    train, test = df.where("id % 3 <> 0 AND x IS NOT NULL"), df.where("id % 3 = 0 AND id < 90")
    known = [i for i in range(90) if i % 3]
    for weights in ("uniform", "distance"):
        unit = evaluation.Unit("KNeighborsRegressor", "x", "y", k=4, weights=weights).fit(train)
        for r in unit.predict(test).collect():
            d = np.linalg.norm(x[known] - x[r["id"]], axis=1)
            best = np.lexsort((known, d))[:4]
            w = np.ones(4) if weights == "uniform" else (d[best] == 0).astype(float) if (d[best] == 0).any() else 1 / d[best]
            assert r["y_pred"] == pytest.approx((w * y[known][best]).sum() / w.sum())
    chosen = evaluation.Unit("KNeighborsClassifier", "x", "y", k=3).fit(train)
    scored = {r["id"]: r for r in chosen.predict(test).collect()}
    assert len(scored) == 30 and all(r["y_pred"] == float(r["y_score"] > 0.5) for r in scored.values())
    accuracy = chosen.score(test).where("Metric = 'Accuracy' AND `Group` = 'Overall'").first()["Value"]
    assert accuracy == pytest.approx(np.mean([scored[i]["y_pred"] == y[i] for i in scored]), abs=1e-5) and accuracy > 0.7
    with pytest.raises(ValueError, match="uniform"):
        evaluation.get_model("KNeighborsClassifier", weights="other")

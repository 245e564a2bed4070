"""Evaluation over folds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.transforms import FeatureTransformer
from tessera.plans import evaluation


def test_folds_are_dealt_once(spark):
    """Fits, scalers and scores of all folds read one written deal; before, each job computed it anew."""
    seen = spark.sparkContext.accumulator(0)

    def fold(i):
        seen.add(1)
        return i % 2

    rows = spark.range(40).select(F.array(F.col("id").cast("double"), (F.col("id") * 7 % 5).cast("double")).alias("x"), (F.col("id") * 2.0 + 1).alias("y"), F.udf(fold, "int")("id").alias("Fold"))
    _, metrics, mean = evaluation.kf_evaluate(lambda: evaluation.Unit("LinearRegression", "x", "y", FeatureTransformer(scaler=True)), rows)
    assert seen.value == 40
    assert metrics.count() == 12 and all(r["Mean"] > 0.999 for r in mean.where("Metric = 'R2'").collect())


def _scan_counts(monkeypatch) -> dict:
    """By the name of each table that kf_evaluate writes, the scans of files in its plan."""
    scans, write = {}, evaluation.materialize

    def counted(df, name):
        scans[name] = df._jdf.queryExecution().executedPlan().toString().count("FileScan")
        return write(df, name)

    monkeypatch.setattr(evaluation, "materialize", counted)
    return scans


def _apart(units, folds, df, groups, digits=5):
    """Each unit scored alone on its two sets."""
    out = {}
    for unit, fold in zip(units, folds, strict=True):
        for name, part in (("Training", df.where(F.col("Fold") != fold)), ("Testing", df.where(F.col("Fold") == fold))):
            out |= {(fold, name, r["Group"], r["Metric"]): r["Value"] for r in unit.score(part, groups, digits).collect()}
    return out


@pytest.mark.parametrize("model", ["LinearRegression", "LogisticRegression"])
def test_all_units_are_scored_in_one_pass(spark, monkeypatch, model):
    """Before, the written folds were scanned for each set of each unit; null targets and groups, weights and folds of text stay."""
    draw = random.Random(6)
    data = [(["a", "b"][draw.randrange(2)], [draw.gauss(0, 1), draw.gauss(5, 2), 1.0], float(draw.random() < 0.5), draw.random() + 0.1, draw.choice(["u", "v", None])) for _ in range(160)]
    df = spark.createDataFrame([(f, x, y if model == "LogisticRegression" else y + 2 * x[0] - x[1], w, g) for f, x, y, w, g in data], "Fold string, x array<double>, y double, w double, g string")
    scans = _scan_counts(monkeypatch)
    make = lambda: evaluation.Unit(model, "x", "y", FeatureTransformer(), "w")
    ensemble, metrics, mean = evaluation.kf_evaluate(make, df)
    assert scans["kf-metrics"] == 1 or model != "LinearRegression"
    assert metrics.columns == ["Group", "Metric", "Value", "Set", "Unit"] and mean.count() > 0
    got = {(r["Unit"], r["Set"], r["Group"], r["Metric"]): r["Value"] for r in metrics.collect()}
    assert got == pytest.approx(_apart(ensemble.units, ["a", "b"], df, None), abs=2e-5)
    ensemble, metrics, _ = evaluation.kf_evaluate(make, df, groups="g")
    got = {(r["Unit"], r["Set"], r["Group"], r["Metric"]): r["Value"] for r in metrics.collect()}
    assert got == pytest.approx(_apart(ensemble.units, ["a", "b"], df, "g"), abs=2e-5)


def test_odd_targets_in_the_folds(spark, monkeypatch):
    """A fold whose targets are all equal has no R2; rows that come twice count twice."""
    rows = [(i % 2, [float(i)], 4.0 if i % 2 else 3.0 * i + i % 3) for i in range(30)] * 2
    df = spark.createDataFrame(rows, "Fold int, x array<double>, y double")
    ensemble, metrics, _ = evaluation.kf_evaluate(lambda: evaluation.Unit("LinearRegression", "x", "y"), df)
    got = {(r["Unit"], r["Set"], r["Group"], r["Metric"]): r["Value"] for r in metrics.collect()}
    assert len(got) == 12 and got[1, "Testing", "Overall", "R2"] is None
    want = _apart(ensemble.units, [0, 1], df, None)
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None}, abs=2e-5) and set(got) == set(want)

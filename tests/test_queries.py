"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FAST = ["knn_cross_euclidean", "pairs_jaccard", "random_split", "temporal_split", "minimal_split", "bin_quantile", "collate_strat", "duplicated_mask", "unit_error_screen", "mwu_by_type", "ece", "regression_by_priority", "masked_loss_total_task_group", "robust_scaler", "stop_words", "token_encode_pad", "html_fields", "percent_hist", "metric_canberra", "metric_yule", "fold_manager", "clipped_vectors", "multi_task_metrics", "property_bounds", "article_table", "molecule_flags", "collated_graphs", "term_tests", "mwu_small_samples", "molecule_properties", "logistic_score_equations", "whole_group_folds"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def show(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return [str(x) for x in v]
        if v is None or v != v:
            return "null"
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    got, want = core.queries()[name](spark, SF).toPandas(), duck.sql(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[0] == "vec_id" and out.count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_only_needed_columns_are_read(spark):
    plan = core.queries()["stop_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" in plan.split("ReadSchema")[1][:120] and "n_chars" not in plan.split("ReadSchema")[1][:120]

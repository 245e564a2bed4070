"""Rows of several modalities as training batches: checks, masks, and batched graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODALITIES = ("tabular", "tokens", "graph", "target", "weight", "group")


def validate_modalities(df: DataFrame, config: dict[str, str]) -> DataFrame:
    """df restricted to the configured columns, with y_true, y_wgts and group under these names.

    config maps a column to its modality; exactly one target and at least one feature are needed.
    Missing weights are 1.
    """
    if missing := [c for c in config if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    if unknown := [m for m in config.values() if m not in MODALITIES]:
        raise ValueError(f"unknown modalities: {unknown}")
    by = by_modality(config)
    if len(by.get("target", [])) != 1 or not any(by.get(m) for m in ("tabular", "tokens", "graph")):
        raise ValueError("one target and at least one feature are needed")
    names = {by["target"][0]: "y_true"} | {c: n for m, n in (("weight", "y_wgts"), ("group", "group")) for c in by.get(m, [])[:1]}
    out = df.select(*config).withColumnsRenamed(names)
    ones = F.transform("y_true", lambda _: F.lit(1.0)) if dict(out.dtypes)["y_true"].startswith("array") else F.lit(1.0)
    return out if "y_wgts" in out.columns else out.withColumn("y_wgts", ones)


def by_modality(config: dict[str, str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for column, modality in config.items():
        out.setdefault(modality, []).append(column)
    return out


def numbered_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Adds batch and place: rows in hash order, batch_size a batch, within parts of the hash's range."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(64))
    at = F.row_number().over(Window.partitionBy("__part").orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col)) - 1
    dealt = df.withColumn("__part", part).withColumn("__at", at)
    return dealt.withColumn("batch", F.floor(F.col("__at") / batch_size) * 64 + F.col("__part")).withColumn("place", F.pmod("__at", F.lit(batch_size))).drop("__part", "__at")


def collate_tokens(df: DataFrame, tokens_col: str = "tokens", pad: int = 0) -> DataFrame:
    """Adds padded (to the longest of the batch) and mask. Needs the column batch."""
    longest = df.groupBy("batch").agg(F.max(F.size(tokens_col)).alias("__long"))
    joined = df.join(longest, "batch")
    tokens = F.col(tokens_col)
    return joined.withColumn("padded", F.concat(tokens, F.array_repeat(F.lit(pad), F.col("__long") - F.size(tokens)))).withColumn("mask", F.transform(F.sequence(F.lit(1), F.col("__long")), lambda i: i <= F.size(tokens))).drop("__long")


def collate_graphs(df: DataFrame, graph_col: str = "graph") -> DataFrame:
    """Adds offset and shifted edges, so that the graphs of a batch are one block-diagonal graph.

    Needs the columns batch and place; a batch is bounded by its size.
    """
    before = Window.partitionBy("batch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shifted = df.withColumn("offset", F.coalesce(F.sum(F.size(F.col(graph_col)["x"])).over(before), F.lit(0)).cast("int"))
    move: Column = F.col("offset")
    return shifted.withColumn("src", F.transform(F.col(graph_col)["src"], lambda i: i + move)).withColumn("dst", F.transform(F.col(graph_col)["dst"], lambda i: i + move))

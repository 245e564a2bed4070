"""Nearest-neighbour models with the fit and transform of MLlib's estimators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.distances import pairwise
from tessera.operators.neighbours import PIECE, WIDE_BLOCK, _fitted, by_blocks, grid
from tessera.session import materialize


#: Metrics whose distances a matrix product gives to about nine digits.
BY_PRODUCT = ("euclidean", "minkowski", "pnorm", "seuclidean", "sqeuclid", "sqeuclidean")


def _nearest(metric: str, x: np.ndarray, y: np.ndarray, k: int, fitted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest of each row of x, of equal distances the earlier rows of y.

    All that come within a margin of the k-th by quick distances are candidates; their distances from differences decide.
    """
    quick = pairwise(metric, x, y, fitted, products=metric in BY_PRODUCT)
    if not np.isfinite(quick).all():
        d = pairwise(metric, x, y, fitted)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(d)), best.shape[1])
        return rows, best.ravel(), d[rows, best.ravel()]
    reach = np.partition(quick, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
    rows, at = np.nonzero(quick <= (reach + MARGIN * np.abs(reach) + 1e-300)[:, None])
    d = quick[rows, at]
    if metric in BY_PRODUCT:
        scale = 1 / np.sqrt(fitted) if metric == "seuclidean" else 1.0
        for i in range(0, len(rows), 16_384):
            own = slice(i, i + 16_384)
            d[own] = ((x[rows[own]] * scale - y[at[own]] * scale) ** 2).sum(axis=1)
        d = d if metric in ("sqeuclid", "sqeuclidean") else np.sqrt(d)
    order = np.lexsort((at, d, rows))
    rows, at, d = rows[order], at[order], d[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], at[place < k], d[place < k]


#: Share of a distance that quick ones may be off by, with room to spare.
MARGIN = 1e-6


class KNeighborsModel:
    """A table of known vectors and labels."""

    def __init__(self, known: DataFrame, params: dict) -> None:
        self.known, self.params = known, params

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """(id, near) for queries (id, vec): the nearest known rows as an array of (distance, id, label), ascending; of equal
        distances the smaller id. Blocks give their k best, merged within parts of the references first."""
        k, metric = self.params["k"], self.params["metric"]
        fitted = _fitted(self.known, metric)

        def work(a: pa.Table, b: pa.Table) -> pa.Table:
            if not (a.num_rows and b.num_rows):
                return pa.table({"id": pa.array([], pa.int64()), "part": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "known": pa.array([], pa.int64()), "label": pa.array([], pa.float64())})
            b = b.take(np.argsort(b.column("id").to_numpy(), kind="stable"))
            ids, known, x, y = a.column("id").to_numpy(), b.column("id").to_numpy(), grid(a), grid(b)
            rows, at, d = [], [], []
            for i in range(0, len(x), PIECE):
                r, c, near = _nearest(metric, x[i : i + PIECE], y, k, fitted)
                rows.append(r + i)
                at.append(c)
                d.append(near)
            rows, at, d = (np.concatenate(v) for v in (rows, at, d))
            part = np.full(len(rows), int(b.column("id")[0].as_py()) % 64)
            return pa.table({"id": ids[rows], "part": part, "distance": d, "known": known[at], "label": b.column("label").to_numpy()[at]})

        found = by_blocks(queries, self.known, work, "id long, part long, distance double, known long, label double", self._block(queries))
        # Ranked within parts, then among what these leave: at most 64 k rows of a query come together.
        order = [F.col("distance"), F.col("known")]
        some = found.withColumn("rn", F.row_number().over(Window.partitionBy("id", "part").orderBy(*order))).where(F.col("rn") <= k)
        best = some.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rn") <= k)
        return best.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "known", "label"))).alias("near"))

    def _block(self, queries: DataFrame) -> int:
        """Rows of a block: wide ones are sent less often, but all cores should have pairs of blocks."""
        cells = self.known.count() * queries.count()
        return int(min(WIDE_BLOCK, max(PIECE, (cells / (4 * queries.sparkSession.sparkContext.defaultParallelism)) ** 0.5)))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction: the mean of the neighbours' labels, weighted by 1 / distance if asked (a distance of 0 outweighs all
        others); for classes the most frequent of 0 and 1, with `probability` and `rawPrediction`. Rows without a vector get null."""
        p = self.params
        numbered, _ = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "knn-rows")
        queries = numbered.where(F.col(p["featuresCol"]).isNotNull()).select(F.col("__row").alias("id"), vector_to_array(p["featuresCol"]).alias("vec"))
        near = F.col("near")
        total = lambda of: F.aggregate(F.transform(near, of), F.lit(0.0), lambda a, x: a + x)
        if p["weights"] == "distance":
            exact = F.exists(near, lambda x: x["distance"] == 0)
            weight = lambda x: F.when(exact, (x["distance"] == 0).cast("double")).otherwise(F.lit(1.0) / x["distance"])
        else:
            weight = lambda x: F.lit(1.0)
        mean = total(lambda x: weight(x) * x["label"]) / total(weight)
        scored = self.neighbours(queries).select(F.col("id").alias("__row"), mean.alias("__mean"))
        out = numbered.join(scored, "__row", "left").drop("__row")
        if not p["classes"]:
            return out.withColumn(p["predictionCol"], F.col("__mean")).drop("__mean")
        both = F.when(F.col("__mean").isNotNull(), array_to_vector(F.array(1 - F.col("__mean"), F.col("__mean"))))
        return out.withColumns({"rawPrediction": both, "probability": both, p["predictionCol"]: (F.col("__mean") > 0.5).cast("double")}).drop("__mean")


class KNeighbors:
    """k nearest neighbours by any metric of tessera.functions.distances: fit keeps the vectors, transform joins blocks."""

    classes = False

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", k: int = 5, metric: str = "euclidean", weights: str = "uniform") -> None:  # noqa: N803 (MLlib's names)
        if weights not in ("uniform", "distance"):
            raise ValueError("weights are uniform or distance")
        self.params = {"featuresCol": featuresCol, "labelCol": labelCol, "predictionCol": predictionCol, "k": k, "metric": metric, "weights": weights, "classes": self.classes}

    def hasParam(self, name: str) -> bool:  # noqa: N802
        return name in self.params

    def fit(self, df: DataFrame) -> KNeighborsModel:
        p = self.params
        rows = df.where(F.col(p["featuresCol"]).isNotNull() & F.col(p["labelCol"]).isNotNull())
        known = rows.select(F.monotonically_increasing_id().alias("id"), vector_to_array(p["featuresCol"]).alias("vec"), F.col(p["labelCol"]).cast("double").alias("label"))
        return KNeighborsModel(materialize(known, "knn-known")[0], p)


class KNeighborsClassifier(KNeighbors):
    classes = True


class KNeighborsRegressor(KNeighbors):
    classes = False

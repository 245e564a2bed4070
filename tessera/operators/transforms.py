"""Feature transforms on an array column: masks, correlation, imputation, selection, scaling, clipping."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import vector_quantiles

#: Largest magnitude of a usable column.
EXTREME = 1e12
#: The range of the 5th to 95th percentile of a unit normal distribution.
UNIT_RANGE = 3.2897072539

# The steps that a feature family takes, and the family of each feature.
CONTINUOUS = {"masks": True, "corr": True, "imputer": True, "selector": True, "scaler": True}
BINARY = {"masks": True, "corr": True, "imputer": True, "selector": True, "scaler": False}
INTEGER = {"masks": True, "corr": True, "imputer": False, "selector": True, "scaler": False}
PRESETS = {
    "AtomPair": BINARY, "Daylight": BINARY, "ECFP": BINARY, "MACCS": BINARY, "Klek": BINARY, "Mordred": BINARY,
    "CDDD": CONTINUOUS, "ChemBERTa": CONTINUOUS, "RDKit": CONTINUOUS, "CDDD_internal": CONTINUOUS, "MiniMol": CONTINUOUS,
    "MAP": INTEGER, "MAPC": INTEGER, "AtomPairCount": INTEGER, "DaylightCount": INTEGER, "ECFPCount": INTEGER,
}


def preset(features: str) -> dict[str, bool]:
    """The steps for a feature name; KeyError for an unknown one."""
    return dict(PRESETS[features])


def _long(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.posexplode(F.col(col).cast("array<double>")).alias("i", "x"))


def _known(x: str = "x") -> Column:
    return F.when(F.col(x).isNotNull() & ~F.isnan(x), F.col(x))


def pick(col: str, kept: list[int]) -> Column:
    """The components at these positions. The array is bound to a name once: steps upon steps are merged into one expression,
    and within the inner lambda each would be computed for every position of the next."""
    places = F.array(*[F.lit(i) for i in kept])
    return F.get(F.transform(F.array(col), lambda v: F.transform(places, lambda i: F.get(v, i))), F.lit(0)) if kept else F.array().cast("array<double>")


def fit_masks(df: DataFrame, col: str) -> list[int]:
    """Positions without null, NaN, infinite or extreme values and with a population variance above 0."""
    x = F.col("x")
    stats = _long(df, col).groupBy("i").agg(F.max((x.isNull() | F.isnan(x) | (F.abs(x) > EXTREME)).cast("int")).alias("bad"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return sorted(r["i"] for r in stats.where("bad = 0 and lo < hi").select("i").collect())


def correlations(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """(i, j, r) with i < j of the position pairs whose absolute Pearson correlation reaches the threshold.

    Moments are sums of one matrix a task: width squared numbers, whatever the rows.
    """
    import numpy as np
    import pyarrow as pa

    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["i", "j", "s"])

    m = df.select(F.col(col).cast("array<double>").alias("v")).mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    last = m.agg(F.max("i")).first()[0]
    if last is None:
        return df.sparkSession.createDataFrame([], "i int, j int, r double")
    n = m.where((F.col("i") == last) & (F.col("j") == last)).first()["s"]
    # One row for each position.
    one = m.where((F.col("j") == last) & (F.col("i") < last)).select("i", (F.col("s") / n).alias("mean")).join(m.where("i = j").select("i", F.col("s").alias("ss")), "i").select("i", "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / n - F.col("mean") * F.col("mean"))).alias("dev"))
    left, right = (one.select(F.col("i").alias(k), F.col("mean").alias("m" + k), F.col("dev").alias("d" + k)) for k in ("i", "j"))
    r = F.try_divide(F.col("s") / n - F.col("mi") * F.col("mj"), F.col("di") * F.col("dj"))
    pairs = m.where(f"i < j and j < {last}").join(left, "i").join(right, "j").select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.least(F.lit(1.0), F.abs(r)).alias("r"))
    return pairs.where(F.col("r") >= threshold)


def fit_corr(df: DataFrame, col: str, threshold: float = 0.9, frac: float = 1.0, seed: int = 42) -> list[int]:
    """Positions left when, over and over, the one in most correlated pairs goes: of equal counts the one of
    the greater mean correlation (to 5 digits), then the smaller position. The pair table is bounded by the
    vectors' width squared."""
    sample = df.sample(fraction=frac, seed=seed) if frac < 1 else df
    pairs = [(r["i"], r["j"], r["r"]) for r in correlations(sample, col, threshold).collect()]
    width = df.select(F.max(F.size(col))).first()[0] or 0
    gone: set[int] = set()
    while pairs:
        counts: dict[int, list[float]] = {}
        for i, j, r in pairs:
            counts.setdefault(i, []).append(r)
            counts.setdefault(j, []).append(r)
        worst = min(counts, key=lambda k: (-len(counts[k]), -round(sum(counts[k]) / len(counts[k]), 5), k))
        gone.add(worst)
        pairs = [p for p in pairs if worst not in p[:2]]
    return [i for i in range(width) if i not in gone]


def fit_imputer(df: DataFrame, col: str) -> list[float]:
    """Column means without nulls and NaN; 0 for a column that has nothing else."""
    rows = _long(df, col).groupBy("i").agg(F.avg(_known()).alias("m")).orderBy("i").collect()
    return [r["m"] if r["m"] is not None else 0.0 for r in rows]


def apply_imputer(col: str, means: list[float]) -> Column:
    fill = F.array(*[F.lit(float(m)) for m in means])
    return F.transform(F.col(col).cast("array<double>"), lambda x, i: F.when(x.isNull() | F.isnan(x), F.get(fill, i)).otherwise(x))


def fit_selector(df: DataFrame, col: str, threshold: float = 1e-3) -> list[int]:
    """Positions whose population variance exceeds the threshold."""
    return sorted(r["i"] for r in _long(df, col).groupBy("i").agg(F.var_pop("x").alias("v")).where(F.col("v") > threshold).select("i").collect())


def fit_scaler(df: DataFrame, col: str) -> tuple[list[float], list[float]]:
    """Medians, and the range of the 5th to 95th percentile over that of a unit normal; ranges of 0 count as 1."""
    rows = vector_quantiles(df, col, [0.05, 0.5, 0.95]).values()
    return [mid for _, mid, _ in rows], [(high - low) / UNIT_RANGE or 1.0 for low, _, high in rows]


def apply_scaler(col: str, medians: list[float], scales: list[float]) -> Column:
    mid, scale = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (medians, scales))
    return F.transform(F.col(col).cast("array<double>"), lambda x, i: (x - F.get(mid, i)) / F.get(scale, i))


def fit_clipper(df: DataFrame, col: str, sigmas: float = 6.0) -> list[float]:
    return [r["s"] for r in _long(df, col).groupBy("i").agg((F.stddev_pop("x") * sigmas).alias("s")).orderBy("i").collect()]


def apply_clipper(col: str, bounds: list[float]) -> Column:
    limit = F.array(*[F.lit(float(b)) for b in bounds])
    return F.transform(F.col(col).cast("array<double>"), lambda x, i: F.greatest(-F.get(limit, i), F.least(F.get(limit, i), x)))


@dataclass
class FeatureTransformer:
    """Masks, correlation pruning, imputation, selection and scaling in this order, each optional.

    fit() measures each step on the output of the step before; transform() is one projection.
    """

    masks: bool = True
    corr: bool = False
    imputer: bool = False
    selector: bool = False
    scaler: bool = False
    corr_threshold: float = 0.9
    selector_threshold: float = 1e-3
    fitted: dict = field(default_factory=dict)

    def _steps(self):
        for name, fit in (("masks", fit_masks), ("corr", lambda d, c: fit_corr(d, c, self.corr_threshold)), ("imputer", fit_imputer), ("selector", lambda d, c: fit_selector(d, c, self.selector_threshold)), ("scaler", fit_scaler)):
            if getattr(self, name):
                yield name, fit

    def fit(self, df: DataFrame, col: str, update: bool = False) -> FeatureTransformer:
        if self.fitted and not update:
            return self
        now = df
        for name, fit in self._steps():
            self.fitted[name] = fit(now, col)
            now = now.withColumn(col, self._apply(name, col))
        return self

    def _apply(self, name: str, col: str) -> Column:
        got = self.fitted[name]
        if name == "imputer":
            return apply_imputer(col, got)
        return apply_scaler(col, *got) if name == "scaler" else pick(col, got)

    def transform(self, df: DataFrame, col: str) -> DataFrame:
        for name, _ in self._steps():
            if name not in self.fitted:
                raise ValueError(f"not fitted: {name}")
            df = df.withColumn(col, self._apply(name, col))
        return df

    def fit_transform(self, df: DataFrame, col: str) -> DataFrame:
        return self.fit(df, col).transform(df, col)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> FeatureTransformer:
        return FeatureTransformer(**json.loads(text))

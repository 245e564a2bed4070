"""Model evaluation over splits and folds, ensembles, searches and threshold sweeps, on MLlib."""

from __future__ import annotations

import itertools
import random
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components, minimum_spanning_forest
from tessera.operators.metrics import average_metrics, classification_metrics, regression_metrics
from tessera.operators.neighbours import BLOCK, near_pairs
from tessera.operators.ranking import running_sum
from tessera.operators.splits import InfeasibleSplit, are_folds_balanced, group_kfold_split, minimal_train_test_split
from tessera.operators.transforms import FeatureTransformer, pick, preset
from tessera.plans.nearest import KNeighborsClassifier, KNeighborsRegressor
from tessera.session import materialize, remove

MODELS = {"RandomForestClassifier": RandomForestClassifier, "GradientBoostingClassifier": GBTClassifier, "LogisticRegression": LogisticRegression, "LinearSVC": LinearSVC, "RandomForestRegressor": RandomForestRegressor, "GradientBoostingRegressor": GBTRegressor, "LinearRegression": LinearRegression, "KNeighborsClassifier": KNeighborsClassifier, "KNeighborsRegressor": KNeighborsRegressor}
#: Metrics of which less is better.
MINIMIZED = ("MAE", "RMSE", "Brier", "ECE")
#: Search spaces by model: lists are choices, pairs of numbers are ranges.
SPACES = {"RandomForestClassifier": {"numTrees": [20, 50, 100], "maxDepth": (3, 12)}, "RandomForestRegressor": {"numTrees": [20, 50, 100], "maxDepth": (3, 12)}, "GradientBoostingClassifier": {"maxIter": [10, 20, 40], "maxDepth": (2, 6)}, "GradientBoostingRegressor": {"maxIter": [10, 20, 40], "maxDepth": (2, 6)}, "LogisticRegression": {"regParam": (0.0, 1.0)}, "LinearSVC": {"regParam": (0.0, 1.0)}, "LinearRegression": {"regParam": (0.0, 1.0)}, "KNeighborsClassifier": {"k": (1, 15)}, "KNeighborsRegressor": {"k": (1, 15)}}


def get_model(name: str, **params):
    if name not in MODELS:
        raise KeyError(f"unknown model: {name}")
    return MODELS[name](**params)


class Unit:
    """A feature transformer and a model of one target."""

    def __init__(self, model_name: str, features_col: str, target_col: str, transformer: FeatureTransformer | None = None, weights_col: str | None = None, **params) -> None:
        self.name, self.features, self.target, self.weights = model_name, features_col, target_col, weights_col
        self.transformer, self.params, self.model = transformer, params, None
        self.classifies = "Classifier" in model_name or model_name in ("LogisticRegression", "LinearSVC")

    def _vectors(self, df: DataFrame) -> DataFrame:
        ready = self.transformer.transform(df, self.features) if self.transformer else df
        return ready.withColumn("__x", array_to_vector(F.col(self.features).cast("array<double>")))

    def fit(self, df: DataFrame) -> Unit:
        if self.transformer:
            self.transformer.fit(df, self.features)
        estimator = get_model(self.name, featuresCol="__x", labelCol="__y", predictionCol="y_pred", **self.params)
        if self.weights and estimator.hasParam("weightCol"):
            estimator.setWeightCol(self.weights)
        self.model = estimator.fit(self._vectors(df).withColumn("__y", F.col(self.target).cast("double")))
        return self

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """Adds the prediction, and y_score for a classifier: the probability of class 1, or the logistic
        function of its margin."""
        scored = self.model.transform(self._vectors(df))
        if self.classifies:
            margin = vector_to_array("rawPrediction")[1]
            scored = scored.withColumn("y_score", vector_to_array("probability")[1] if "probability" in scored.columns else 1 / (1 + F.exp(-margin)))
        return scored.select(*df.columns, F.col("y_pred").alias(out), *(["y_score"] if self.classifies else []))

    def metrics(self, scored: DataFrame, groups: str | None = None, digits: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
        """Of rows with a prediction or score, for each value of `by`."""
        if self.classifies:
            return classification_metrics(scored, self.target, "y_score", self.weights, groups, digits=digits, by=by)
        return regression_metrics(scored, self.target, "y_pred", self.weights, groups, digits=digits, by=by)

    def score(self, df: DataFrame, groups: str | None = None, digits: int = 5) -> DataFrame:
        return self.metrics(self.predict(df), groups, digits)


class Ensemble:
    """Units that vote: soft is the (weighted) mean of scores or predictions, hard the mode or median."""

    def __init__(self, units: list[Unit], voting: str = "soft", weights: list[float] | None = None) -> None:
        if len({u.classifies for u in units}) > 1:
            raise TypeError("units of one kind are needed")
        self.units, self.voting = units, voting
        total = sum(weights) if weights else None
        self.weights = [w / total for w in weights] if weights else [1 / len(units)] * len(units)

    def predict(self, df: DataFrame) -> DataFrame:
        now, names = df, []
        for i, unit in enumerate(self.units):
            now = unit.predict(now, f"__p{i}")
            if unit.classifies:
                now = now.withColumnRenamed("y_score", f"__s{i}")
            names.append(i)
        mean = lambda mark: sum((F.col(f"__{mark}{i}") * w for i, w in zip(names, self.weights, strict=True)), F.lit(0.0))
        each = F.array_sort(F.array(*[F.col(f"__p{i}") for i in names]))
        if self.units[0].classifies:
            ones = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
            hard = F.when(ones > len(names) / 2, 1.0).otherwise(0.0)
            out = now.withColumn("y_score", mean("s")).withColumn("y_pred", hard if self.voting == "hard" else F.when(F.col("y_score") >= 0.5, 1.0).otherwise(0.0))
        else:
            n = len(names)
            out = now.withColumn("y_pred", (F.get(each, F.lit((n - 1) // 2)) + F.get(each, F.lit(n // 2))) / 2 if self.voting == "hard" else mean("p"))
        return out.drop(*[f"__{m}{i}" for m in "ps" for i in names])

    def score(self, df: DataFrame, groups: str | None = None) -> DataFrame:
        first, scored = self.units[0], self.predict(df)
        if first.classifies:
            return classification_metrics(scored, first.target, "y_score", first.weights, groups)
        return regression_metrics(scored, first.target, "y_pred", first.weights, groups)


def prepare_unit(model_name: str, features: str, features_col: str, target_col: str, **params) -> Unit:
    return Unit(model_name, features_col, target_col, FeatureTransformer(**preset(features)), **params)


def tt_evaluate(unit: Unit, df: DataFrame, set_col: str = "Set", groups: str | None = None) -> DataFrame:
    """Fit on Train; metrics of Training and Testing."""
    train, test = df.where(F.col(set_col) == "Train"), df.where(F.col(set_col) == "Test")
    unit.fit(train)
    return unit.score(train, groups).withColumn("Set", F.lit("Training")).union(unit.score(test, groups).withColumn("Set", F.lit("Testing")))


def _predicted_by_each(units: list[Unit], folds: list, df: DataFrame, fold_col: str, *kept: str) -> DataFrame:
    """The rows of df once for each unit, with its fold as Unit, their Set for it and its prediction or score, in one pass over df."""
    features, told = units[0].features, "y_score" if units[0].classifies else "y_pred"
    now = df.withColumn("__features", F.col(features))
    for i, unit in enumerate(units):
        # A transformer puts its output in place of the features.
        now = unit.predict(now.withColumn(features, F.col("__features")), f"__p{i}")
        if unit.classifies:
            now = now.withColumnRenamed("y_score", f"__s{i}")
    mark = "s" if units[0].classifies else "p"
    part = lambda fold: F.when(F.col(fold_col) == fold, "Testing").otherwise("Training")
    each = [F.struct(F.lit(fold).alias("Unit"), part(fold).alias("Set"), F.col(f"__{mark}{i}").alias(told)) for i, fold in enumerate(folds)]
    return now.select(*kept, F.explode(F.array(*each)).alias("of")).select(*kept, "of.*")


def kf_evaluate(make_unit, df: DataFrame, fold_col: str = "Fold", groups: str | None = None, digits: int = 5) -> tuple[Ensemble, DataFrame, DataFrame]:
    """For each fold fit on the others: (ensemble, metrics by fold, averaged metrics).

    The folds are written once: every fit and scaler reads them, and none deals the rows anew. All units are scored on
    both of their sets in one pass.
    """
    spark = df.sparkSession
    df, path = materialize(df, "kf-folds")
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    units = [make_unit().fit(df.where(F.col(fold_col) != fold)) for fold in folds]
    kept = dict.fromkeys(c for c in (units[0].target, units[0].weights, groups) if c)
    found = units[0].metrics(_predicted_by_each(units, folds, df, fold_col, *kept), groups, digits, ("Set", "Unit"))
    metrics, _ = materialize(found.select("Group", "Metric", "Value", "Set", "Unit"), "kf-metrics")
    remove(spark, path)
    return Ensemble(units), metrics, average_metrics(metrics)


def grid_parameters(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def random_parameters(space: dict, seed: int | None = None) -> dict:
    draw = random.Random(seed)
    pick_one = lambda v: draw.choice(v) if isinstance(v, list) else (draw.randint(*v) if all(isinstance(x, int) for x in v) else draw.uniform(*v))
    return {k: pick_one(v) for k, v in space.items()}


def search(make_unit, df: DataFrame, trials: list[dict], metric: str = "RMSE", fold_col: str = "Fold") -> tuple[dict, float]:
    """The parameters of the best mean test metric over the folds, and that value."""
    best = None
    for params in trials:
        _, _, mean = kf_evaluate(lambda params=params: make_unit(**params), df, fold_col)
        row = mean.where((F.col("Set") == "Testing") & (F.col("Metric") == metric) & (F.col("Group") == "Overall")).first()
        if row is None:
            continue
        value = row["Mean"]
        if best is None or (value < best[1] if metric in MINIMIZED else value > best[1]):
            best = (params, value)
    return best


def sequential_selection(make_unit, df: DataFrame, features_col: str, n_features: int, metric: str = "RMSE", fold_col: str = "Fold", patience: int = 5) -> list[int]:
    """Greedy forward choice of positions; stops after `patience` additions without a better metric."""
    width = df.select(F.max(F.size(features_col))).first()[0]
    chosen: list[int] = []
    best, best_set, idle = None, [], 0
    better = lambda a, b: b is None or (a < b if metric in MINIMIZED else a > b)
    while len(chosen) < min(n_features, width) and idle < patience:
        step = None
        for i in (i for i in range(width) if i not in chosen):
            part = df.withColumn(features_col, pick(features_col, [*chosen, i]))
            got = search(make_unit, part, [{}], metric, fold_col)
            if got and better(got[1], step and step[1]):
                step = (i, got[1])
        if step is None:
            break
        chosen.append(step[0])
        if better(step[1], best):
            best, best_set, idle = step[1], list(chosen), 0
        else:
            idle += 1
    return best_set


def threshold_clusters(df: DataFrame, thresholds: list[float], metric: str = "jaccard", id_col: str = "id", features_col: str = "features"):
    """(threshold, clusters) in rising order, all from one spanning forest.

    The forest of the largest threshold has fewer edges than there are rows, and its edges up to a threshold link the
    clusters of that. Components of all thresholds are found at once, on rows named by threshold and id.
    """
    levels = sorted(thresholds)
    pairs, _ = materialize(near_pairs(df, levels[-1], metric, id_col, features_col, spanning=True), "sweep-pairs")
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    if ids.count() > BLOCK:
        pairs, _ = materialize(minimum_spanning_forest(pairs), "sweep-forest")
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(levels)])).alias("level")
    edges = pairs.select("*", level).where("distance <= level.t").select(F.struct("level.k", F.col("src").alias("id")).alias("src"), F.struct("level.k", F.col("dst").alias("id")).alias("dst"))
    parts = connected_components(edges).select(F.col("id.k").alias("k"), F.col("id.id").alias("id"), F.col("component.id").alias("root"))
    members = ids.select("id", F.explode(F.array(*[F.lit(k) for k in range(len(levels))])).alias("k")).join(parts, ["k", "id"], "left").select("k", "id", F.coalesce("root", "id").alias("root"))
    members, _ = materialize(members, "sweep-members")
    numbers = running_sum(members.select("k", "root").distinct(), ["root"], F.lit(1), "__n", ("k",)).select("k", "root", (F.col("__n") - 1).cast("int").alias("Cluster"))
    numbered, _ = materialize(members.join(numbers, ["k", "root"]), "sweep-clusters")
    for k, t in enumerate(levels):
        yield t, numbered.where(F.col("k") == k).select(F.col("id").alias(id_col), "Cluster")


def threshold_sweep(df: DataFrame, thresholds: list[float], fraction: float = 0.2, tolerance: float = 0.05, metric: str = "jaccard", id_col: str = "id", features_col: str = "features", evaluate=None, n_folds: int | None = None) -> DataFrame:
    """(threshold, n_clusters, largest, n_test, feasible), up to the first threshold without a feasible split.

    With n_folds the clusters are dealt into folds, feasible if balanced; else the smallest are the test
    set. evaluate(frame) may give metrics, which are then joined in as Metric, Group, Set and Value.
    """
    spark, out, extra = df.sparkSession, [], []
    for t, clusters in threshold_clusters(df, thresholds, metric, id_col, features_col):
        joined, _ = materialize(df.join(clusters, id_col), "sweep")
        sizes = joined.groupBy("Cluster").count().agg(F.count("*"), F.max("count")).first()
        try:
            if n_folds:
                split = group_kfold_split(joined, "Cluster", n_folds)
                if not are_folds_balanced(split):
                    raise InfeasibleSplit("unbalanced")
                n_test = None
            else:
                split = minimal_train_test_split(joined, fraction, tolerance)
                n_test = split.where("Set = 'Test'").count()
            out.append((t, sizes[0], sizes[1], n_test, True))
            if evaluate:
                extra.append(evaluate(split).withColumn("threshold", F.lit(t)))
        except InfeasibleSplit:
            out.append((t, sizes[0], sizes[1], None, False))
            break
    table = spark.createDataFrame(out, "threshold double, n_clusters long, largest long, n_test long, feasible boolean")
    return table.join(reduce(DataFrame.union, extra), "threshold", "left") if extra else table


def ensemble_spread(predictions: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and deviation of stacked predictions of a key."""
    return predictions.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("dev"))


def top_by(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("rank") <= k)

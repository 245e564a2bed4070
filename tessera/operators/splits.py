"""Train/test and k-fold partitions, and access to their rows.

Membership is decided by counts and a hash order of a key, so a split of any size is a window or an
aggregate. Row positions have no meaning; every frame has a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import bin_column
from tessera.operators.ranking import running_sum


class InfeasibleSplit(ValueError):
    """No split meets the demanded fraction or balance."""


def validate_frame(df: DataFrame, *columns: str | None) -> None:
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")


#: Ranges of the hash in which rows are ranked, a power of two: a task ranks the rows of some of these.
PARTS = 1024


def _order(id_col: str, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)]


def _ranked(df: DataFrame, id_col: str, seed: int, *by: str) -> DataFrame:
    """Adds __rn, the place of a row in hash order within `by`, without one task for the whole table.

    Rows are dealt into PARTS parts by ranges of the hash; a row's place is its place in the part plus the
    rows of the parts before, which are one row a part.
    """

    h = F.xxhash64(F.lit(seed), F.col(id_col))
    dealt = df.withColumn("__part", F.shiftright(h, 64 - PARTS.bit_length() + 1).cast("int"))
    groups = [F.col(c) for c in by]
    n = dealt.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    starts = n.select(*groups, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__total"))
    within = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*_order(id_col, seed)))
    numbered = dealt.withColumn("__in", within)
    same = (F.col("__part") == F.col("__p2"))
    right = starts.withColumnRenamed("__part", "__p2")
    for c in by:
        right = right.withColumnRenamed(c, f"__g_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return numbered.join(right, same).withColumn("__rn", F.col("__before") + F.col("__in")).drop("__part", "__p2", "__in", "__before", *[f"__g_{c}" for c in by])


def random_train_test_split(df: DataFrame, fraction: float, id_col: str, seed: int = 42) -> DataFrame:
    """Adds Set: floor(n * fraction) rows are Test, the rest Train."""
    return _ranked(df, id_col, seed).withColumn("Set", F.when(F.col("__rn") <= F.floor(F.col("__total") * fraction), "Test").otherwise("Train")).drop("__rn", "__total")


def stratified_train_test_split(df: DataFrame, fraction: float, strat_col: str | list[str], id_col: str, seed: int = 42) -> DataFrame:
    """Adds Bin and Set: of each bin floor(n * fraction) rows are Test."""
    binned = collate_strat(df, strat_col)
    return _ranked(binned, id_col, seed, "Bin").withColumn("Set", F.when(F.col("__rn") <= F.floor(F.col("__total") * fraction), "Test").otherwise("Train")).drop("__rn", "__total")


def minimal_train_test_split(df: DataFrame, fraction: float, tolerance: float = 0.05, cluster_col: str = "Cluster") -> DataFrame:
    """Adds Set: the smallest clusters, ties by cluster, are Test until they hold ceil(n * fraction) rows.

    InfeasibleSplit if that takes more than ceil(n * (fraction + tolerance)) rows.
    """
    sizes = df.groupBy(cluster_col).agg(F.count("*").alias("__n"))
    n = df.count()
    wanted, most = math.ceil(n * fraction), math.ceil(n * (fraction + tolerance))
    # Sums of equal sizes first: one row for each size of a cluster decides where the boundary is.
    by_size = [(r["__n"], r["k"]) for r in sizes.groupBy("__n").agg(F.count("*").alias("k")).orderBy("__n").collect()]
    held, last, partial = 0, 0, 0
    for size, k in by_size:
        if held >= wanted:
            break
        need = -(-(wanted - held) // size)
        last, partial = size, min(k, need)
        held += size * partial
    if held > most:
        raise InfeasibleSplit(f"the smallest clusters reach {held} rows, at most {most} are allowed")
    # Clusters of the last size may be many: they are numbered over ranges.
    at = running_sum(sizes.where(F.col("__n") == last).select(cluster_col), [cluster_col], F.lit(1), "__k").where(F.col("__k") <= partial)
    test = sizes.where(F.col("__n") < last).select(cluster_col).union(at.select(cluster_col)).withColumn("__t", F.lit(1))
    return df.join(test, cluster_col, "left").withColumn("Set", F.when(F.col("__t") == 1, "Test").otherwise("Train")).drop("__t")


def temporal_split(df: DataFrame, time_col: str, fraction: float = 0.2) -> DataFrame:
    """Adds Set: rows before the boundary are Train, rows at or behind it Test.

    The boundary is the value at 0-based place round-half-even(n * fraction) of the descending order, found
    from counts per value.
    """
    place = round(df.where(F.col(time_col).isNotNull()).count() * fraction)
    counts = df.where(F.col(time_col).isNotNull()).groupBy(time_col).agg(F.count("*").alias("__n"))
    day = running_sum(counts.select(F.col(time_col).alias("t"), "__n"), [F.desc("t")], "__n", "upto")
    boundary = day.where(F.col("upto") > place).agg(F.max("t").alias("__b"))
    return df.crossJoin(F.broadcast(boundary)).withColumn("Set", F.when(F.col(time_col) < F.col("__b"), "Train").otherwise("Test")).drop("__b")


def random_kfold_split(df: DataFrame, id_col: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds Fold, 0-based; sizes differ by one at most."""
    return _ranked(df, id_col, seed).withColumn("Fold", F.pmod(F.col("__rn") - 1, F.lit(n_folds)).cast("int")).drop("__rn", "__total")


def stratified_kfold_split(df: DataFrame, strat_col: str | list[str], id_col: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds Bin and Fold; each bin is spread evenly, and bins begin at different folds."""
    ranked = _ranked(collate_strat(df, strat_col), id_col, seed, "Bin")
    offset = F.pmod(F.xxhash64(F.lit(seed), "Bin"), F.lit(n_folds))
    return ranked.withColumn("Fold", F.pmod(F.col("__rn") - 1 + offset, F.lit(n_folds)).cast("int")).drop("__rn", "__total")


def group_kfold_split(df: DataFrame, cluster_col: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds Fold; clusters stay whole, and the numbers of clusters in the folds differ by one at most."""
    groups = _ranked(df.select(cluster_col).distinct(), cluster_col, seed)
    folds = groups.select(F.col(cluster_col).alias("__c"), F.pmod(F.col("__rn") - 1, F.lit(n_folds)).cast("int").alias("Fold"))
    return df.join(folds, F.col(cluster_col).eqNullSafe(F.col("__c"))).drop("__c")


def stratified_group_kfold_split(df: DataFrame, strat_col: str | list[str], cluster_col: str, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds Bin and Fold; clusters stay whole, and the bins are balanced over the folds.

    Clusters are grouped by their largest bin and size; within a bin they are dealt in descending
    order of size back and forth over the folds, which keeps the folds' row counts level.
    """
    binned = collate_strat(df, strat_col)
    cells = binned.groupBy(cluster_col, "Bin").agg(F.count("*").alias("n"))
    main = cells.groupBy(cluster_col).agg(F.max(F.struct("n", "Bin")).alias("m"), F.sum("n").alias("size")).select(F.col(cluster_col).alias("__c"), F.col("m.Bin").alias("__bin"), "size")
    turn = F.row_number().over(Window.partitionBy("__bin").orderBy(F.desc("size"), F.xxhash64(F.lit(seed), "__c"), "__c")) - 1
    lap = F.pmod(turn, F.lit(2 * n_folds))
    start = F.pmod(F.xxhash64("__bin"), F.lit(n_folds))
    folds = main.select("__c", F.pmod(F.when(lap < n_folds, lap).otherwise(2 * n_folds - 1 - lap) + start, F.lit(n_folds)).cast("int").alias("Fold"))
    return binned.join(folds, F.col(cluster_col).eqNullSafe(F.col("__c"))).drop("__c")


def collate_strat(df: DataFrame, strat_col: str | list[str], n_bins: int = 5) -> DataFrame:
    """Adds Bin: the columns joined by ":", floating ones as quantile bins; null if any is null."""
    columns = [strat_col] if isinstance(strat_col, str) else list(strat_col)
    validate_frame(df, *columns)
    kinds, parts, temp = dict(df.dtypes), [], []
    for c in columns:
        if kinds[c] in ("double", "float"):
            df = bin_column(df, c, n_bins, f"__bin_{c}")
            temp.append(f"__bin_{c}")
            parts.append(F.col(f"__bin_{c}").cast("string"))
        else:
            parts.append(F.col(c).cast("string"))
    joined = parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.lit(":"), p)][1:])
    return df.withColumn("Bin", joined).drop(*temp)


def are_folds_balanced(df: DataFrame, fold_col: str = "Fold", tolerance: float = 0.3) -> bool:
    """Whether the sample deviation of the fold sizes is at most `tolerance` of their mean."""
    r = df.groupBy(fold_col).agg(F.count("*").alias("n")).agg(F.stddev_samp("n").alias("s"), F.avg("n").alias("m")).first()
    if not r["m"]:
        raise ValueError("no rows")
    return (r["s"] or 0.0) / r["m"] <= tolerance


def clustered_kfold_split(df: DataFrame, clusters: DataFrame, id_col: str, cluster_col: str = "Cluster", strat_col: str | list[str] | None = None, n_folds: int = 5, tolerance: float = 0.3) -> DataFrame:
    """Adds the cluster and a Fold that keeps it whole; InfeasibleSplit where the folds are not balanced."""
    joined = df.join(clusters.select(id_col, cluster_col).dropDuplicates([id_col]), id_col)
    out = group_kfold_split(joined, cluster_col, n_folds) if strat_col is None else stratified_group_kfold_split(joined, strat_col, cluster_col, n_folds)
    if not are_folds_balanced(out, "Fold", tolerance):
        raise InfeasibleSplit("fold sizes differ by more than the tolerance")
    return out


class FoldManager:
    """The rows of a cross-validation with one fold set aside: predicates on the fold column."""

    def __init__(self, df: DataFrame, fold_col: str, test_fold: int) -> None:
        validate_frame(df, fold_col)
        self.df, self.fold_col, self.test_fold = df, fold_col, test_fold
        self.folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
        if test_fold not in self.folds:
            raise ValueError(f"no such fold: {test_fold}")

    def _of(self, fold: int) -> Column:
        if fold == self.test_fold or fold not in self.folds:
            raise ValueError(f"not a fold of the cross-validation: {fold}")
        return F.col(self.fold_col) == fold

    def train(self, fold: int) -> DataFrame:
        return self.df.where(~self._of(fold) & (F.col(self.fold_col) != self.test_fold))

    def evaluation(self, fold: int) -> DataFrame:
        return self.df.where(self._of(fold))

    def test(self) -> DataFrame:
        return self.df.where(F.col(self.fold_col) == self.test_fold)

    def non_test(self) -> DataFrame:
        return self.df.where(F.col(self.fold_col) != self.test_fold)


class SetManager:
    """The rows of a split with a column Set of Train and Test."""

    def __init__(self, df: DataFrame, set_col: str = "Set") -> None:
        validate_frame(df, set_col)
        self.df, self.set_col = df, set_col

    def train(self) -> DataFrame:
        return self.df.where(F.col(self.set_col) == "Train")

    def test(self) -> DataFrame:
        return self.df.where(F.col(self.set_col) == "Test")

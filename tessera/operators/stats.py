"""Rank statistics and random-intercept models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distributions import normal_tail
from tessera.operators.ranking import quantiles, running_sum
from tessera.session import materialize


def rank_biserial(u: Column, n1: Column, n2: Column) -> Column:
    return 2 * u / (n1 * n2) - 1


def effect_label(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size <= 0.1, "Negligible").when(size <= 0.3, "Small").when(size <= 0.5, "Medium").otherwise("Large")


#: Cells n1 * n2 up to which the distribution of U is counted where it can be.
COUNTED = 10_000_000


def u_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) under the null hypothesis, without ties.

    The arrangements with statistic u are counted by a recurrence in the size of the smaller sample: those of i values
    are those of i - 1, less what would need more than n2 others, plus those of i with i less. Half of the symmetric
    distribution is enough.
    """
    least, most = sorted((n1, n2))
    top = least * most
    if u <= top / 2:
        return 1.0 - u_tail(top - math.ceil(u) + 1, n1, n2) if u > 0 else 1.0
    want = top - math.ceil(u)  # by symmetry P(U <= want)
    if want < 0:
        return 0.0
    ways = np.zeros(want + 1)
    ways[0] = 1.0
    for i in range(1, least + 1):
        reach = most + i
        if reach <= want:
            ways[reach:] -= ways[:-reach].copy()
        for begin in range(min(i, want + 1)):
            ways[begin::i] = np.cumsum(ways[begin::i])
    return float(math.exp(math.log(ways.sum()) - math.lgamma(least + most + 1) + math.lgamma(least + 1) + math.lgamma(most + 1)))


def mann_whitney(df: DataFrame, value: str, label: str, label_1: str, label_2: str, min_n: int = 3, alpha: float = 0.05, alternative: str = "two-sided") -> DataFrame:
    """One row comparing the values of two labels: sizes, means, medians, U, p, rank-biserial r, effect, outcome.

    Values are counted first, so ranks are running sums over distinct values. With at most 8 values on a side and no ties
    p is that of the counted distribution of U (up to 10 million cells n1 * n2), else the tie-corrected normal
    approximation with continuity correction. With fewer than min_n values on a side U, p and what follows from them
    are null.
    """
    rows = df.where(F.col(label).isin(label_1, label_2) & F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), (F.col(label) == label_1).cast("long").alias("one")).where(~F.isnan("v"))
    counts = rows.groupBy("v").agg(F.sum("one").alias("a"), F.sum(1 - F.col("one")).alias("b"))
    t = F.col("a") + F.col("b")
    below = F.col("upto") - F.col("b")
    ranked = running_sum(counts, ["v"], "b", "upto")
    sums = ranked.select("a", "b", t.alias("t"), (F.col("a") * (below + F.col("b") / 2)).alias("u")).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum("u").alias("u"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    half = lambda one, n: quantiles(rows.where(f"one = {one}"), "v", [0.5]).agg(F.max(F.col("q")[0]).alias(f"median_{n}"))
    side = lambda one, n: rows.where(f"one = {one}").agg(F.avg("v").alias(f"mean_{n}")).crossJoin(half(one, n))  # noqa: E731 (one row each)
    wide = sums.crossJoin(side(1, 1)).crossJoin(side(0, 2)).select(F.coalesce("n1", F.lit(0)).alias("n1"), F.coalesce("n2", F.lit(0)).alias("n2"), "u", "ties", "mean_1", "mean_2", "median_1", "median_2")
    wide, _ = materialize(wide, "rank-test")  # one row
    one = wide.first()
    enough = (F.col("n1") >= min_n) & (F.col("n2") >= min_n)
    n = (F.col("n1") + F.col("n2")).cast("double")
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    mid = F.col("n1") * F.col("n2") / 2.0
    shift = {"two-sided": F.abs(F.col("u") - mid), "greater": F.col("u") - mid, "less": mid - F.col("u")}[alternative]
    z = F.try_divide(shift - 0.5, sd)
    p = F.least(F.lit(1.0), (2.0 if alternative == "two-sided" else 1.0) * normal_tail(z))
    n1, n2, u = one["n1"], one["n2"], one["u"]
    if 0 < min(n1, n2) <= 8 and not one["ties"] and n1 * n2 <= COUNTED:
        tail = u_tail({"two-sided": max(u, n1 * n2 - u), "greater": u, "less": n1 * n2 - u}[alternative], n1, n2)
        p = F.lit(min(1.0, 2 * tail) if alternative == "two-sided" else tail)
    r = rank_biserial(F.col("u"), F.col("n1"), F.col("n2"))
    done = wide.select(F.lit(label_1).alias("label_1"), F.lit(label_2).alias("label_2"), "n1", "n2", "mean_1", "mean_2", "median_1", "median_2", F.when(enough, F.col("u")).alias("u"), F.when(enough, p).alias("p"), F.when(enough, r).alias("rbc"), F.when(enough, effect_label(r)).alias("effect"))
    outcome = F.when(F.col("p").isNull(), None).when((F.col("p") >= alpha) | (F.col("rbc") == 0), f"{label_1} ~ {label_2}").when(F.col("rbc") > 0, f"{label_1} > {label_2}").otherwise(f"{label_1} < {label_2}")
    return done.withColumn("alpha", F.lit(alpha)).withColumn("alternative", F.lit(alternative)).withColumn("low_n", (F.col("n1") < min_n) | (F.col("n2") < min_n)).withColumn("outcome", outcome)


def mixed_formula(df: DataFrame, response: str, fixed: list[str], random: list[str]) -> tuple[str, list[str]]:
    """The model formula with the factors that have two levels or more, and the factors left out."""
    levels = df.agg(*[F.countDistinct(c).alias(c) for c in [*fixed, *random]]).first()
    use = lambda names: [c for c in names if levels[c] >= 2]
    if not use(fixed) or not use(random):
        raise ValueError("no factor with two levels is left")
    return f"{response} ~ {' + '.join([*use(fixed), *(f'(1 | {c})' for c in use(random))])}", [c for c in [*fixed, *random] if levels[c] < 2]


def random_intercept(df: DataFrame, response: str, fixed: list[str], group: str) -> dict:
    """REML fit of y ~ fixed + (1 | group): coefficients, variance components, ICC, R2.

    The data enter through per-group sums of 1, x, y and their products; the likelihood needs no more
    than their totals at each ratio of variances, so the search goes over sums by group size. Fixed
    columns are numeric. Rows with nulls are left out.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in fixed], F.col(response).cast("double")]
    k = len(cols)
    rows = df.dropna(subset=[response, group, *fixed]).select(F.col(group).alias("g"), *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    sums = rows.groupBy("g").agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)])
    # A group of n rows enters as cross products, and the outer product of its sums shrunk by a factor of n alone.
    by_n = sums.groupBy(F.col("s0").alias("n")).agg(F.count("*").alias("m"), *[F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"o{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
    full = lambda r, c: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    parts = [(r["n"], r["m"], full(r, "p"), full(r, "o")) for r in by_n]
    n = sum(a * m for a, m, _, _ in parts)
    q = k - 1

    def profile(ratio: float):
        total = sum(p - o * (ratio / (1 + a * ratio)) for a, _, p, o in parts)
        xx, xy, yy = total[:q, :q], total[:q, q], total[q, q]
        beta = np.linalg.solve(xx, xy)
        rss = yy - xy @ beta
        loglik = -0.5 * ((n - q) * math.log(rss / (n - q)) + sum(m * math.log(1 + a * ratio) for a, m, _, _ in parts) + np.linalg.slogdet(xx)[1])
        return loglik, beta, rss / (n - q), np.linalg.inv(xx)

    lo, hi, gold = -12.0, 12.0, (math.sqrt(5) - 1) / 2
    a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
    fa, fb = profile(math.exp(a))[0], profile(math.exp(b))[0]
    for _ in range(80):
        if fa < fb:
            lo, a, fa = a, b, fb
            b = lo + gold * (hi - lo)
            fb = profile(math.exp(b))[0]
        else:
            hi, b, fb = b, a, fa
            a = hi - gold * (hi - lo)
            fa = profile(math.exp(a))[0]
    ratio = math.exp((lo + hi) / 2)
    if profile(0.0)[0] >= profile(ratio)[0]:
        ratio = 0.0
    loglik, beta, residual, cov = profile(ratio)
    whole = sum(p for _, _, p, _ in parts)
    mean = whole[0] / n
    spread = whole / n - np.outer(mean, mean)
    explained = float(beta @ spread[:q, :q] @ beta)
    between = ratio * residual
    return {"coefficients": dict(zip(["(Intercept)", *fixed], map(float, beta), strict=True)), "std_errors": dict(zip(["(Intercept)", *fixed], map(float, np.sqrt(residual * np.diag(cov))), strict=True)), "var_group": float(between), "var_residual": float(residual), "icc": float(between / (between + residual)), "r2_marginal": explained / (explained + between + residual), "r2_conditional": (explained + between) / (explained + between + residual), "singular": ratio == 0.0, "rows": int(n), "groups": int(sum(m for _, m, _, _ in parts)), "loglik": float(loglik)}

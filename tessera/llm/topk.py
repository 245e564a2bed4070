"""Exact top-k search by inner product, pruned by statistics of vector segments.

A vector is cut into segments at several resolutions, and of each segment the mean and the deviation are
kept. With l components a segment, the squared distance of two vectors is at least the sum over segments
of l * ((mean - mean')^2 + (dev - dev')^2); written for the inner product, whose squared norms are known
exactly, this says that it is at most the sum of l * (mean * mean' + dev * dev'). Coarse levels discard
most candidates cheaply where vectors have structure, finer ones the next; survivors are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Numbers of segments, coarse to fine.
LEVELS = (1, 4, 16)
#: Rows of a candidate block and of a query block: a task holds one of each.
CANDIDATES, QUERIES = 65_536, 2_048
#: Pairs whose bounds a task holds together; a 64th of them is scored together.
PAIRS = 1 << 20
#: At each level this many times k candidates of a query, those with the highest bounds, are scored first.
PROBES = 4


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row, sqrt(l) * mean and sqrt(l) * deviation of each segment; inner products of two such rows
    bound those of the vectors from above."""
    out = []
    for part in np.array_split(x.astype(np.float64), min(segments, x.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * root, part.std(axis=1) * root]
    return np.stack(out, axis=1)


def _products(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """The inner products of the pairs of rows (qi, ci), exact."""
    out = np.empty(len(qi), np.int64)
    for at in range(0, len(qi), PAIRS >> 6):
        part = slice(at, at + (PAIRS >> 6))
        out[part] = np.einsum("ij,ij->i", q[qi[part]], c[ci[part]])
    return out


def _reached(q: np.ndarray, c: np.ndarray, kept: np.ndarray, bound: np.ndarray, k: int) -> np.ndarray:
    """A score that k candidates of each query reach: the k-th of the exact scores of those with the highest bounds."""
    n = min(PROBES * k, len(kept))
    if n < k:
        return np.full(len(q), -np.inf)
    best = np.argpartition(-bound, n - 1, axis=1)[:, :n]
    score = np.einsum("qd,qnd->qn", q, c[kept[best]]).astype(np.float64)
    score[np.isneginf(np.take_along_axis(bound, best, axis=1))] = -np.inf
    return np.partition(score, n - k, axis=1)[:, n - k]


def search_block(query_rows: np.ndarray, q: np.ndarray, cand_rows: np.ndarray, cand_ids: np.ndarray, c: np.ndarray, k: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score): the k best candidates of each query within this block. A row is no
    candidate of itself.

    At each level the candidates with the highest bounds are scored exactly, which gives a score that k of them reach;
    those whose bound is below it go, and the next level looks at the others only. `left`, if given, is an array
    of len(LEVELS) + 1 numbers to which the pairs at the start and those left after each level are added.
    """
    width = q.shape[1]
    levels = [s for s in LEVELS if s < width] or [1] * min(1, width)
    features = [(segment_features(q, s), segment_features(c, s)) for s in levels]
    slack = 1.0 + 1e-9 * np.sqrt((q.astype(np.float64) ** 2).sum(1).max(initial=0) * (c.astype(np.float64) ** 2).sum(1).max(initial=0))
    found = []
    # Queries that are looked at together: neither their bounds nor the vectors they probe take much memory.
    step = max(1, PAIRS // max(1, len(c), PROBES * k * width >> 3))
    for at in range(0, len(q), step):
        own, asks = q[at : at + step], query_rows[at : at + step]
        kept, alive = np.arange(len(c)), asks[:, None] != cand_rows[None, :]
        reached = np.full(len(own), -np.inf)
        counts = [int(alive.sum())]
        for fq, fc in features:
            bound = np.where(alive, fq[at : at + step] @ fc[kept].T + slack, -np.inf)
            reached = np.maximum(reached, _reached(own, c, kept, bound, k))
            # An equal score may win by its id, so only those below go.
            alive &= bound >= reached[:, None]
            counts.append(int(alive.sum()))
            some = alive.any(axis=0)
            kept, alive = kept[some], alive[:, some]
        if left is not None:
            left += counts + counts[-1:] * (len(left) - len(counts))
        qi, ci = np.nonzero(alive)
        ci = kept[ci]
        score = _products(own, c, qi, ci)
        rank = np.lexsort((cand_ids[ci], -score, qi))
        qi, ci, score = qi[rank], ci[rank], score[rank]
        top = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        found.append((asks[qi[top]], cand_ids[ci[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.empty(0, np.int64) for _ in range(3))


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """For each query row its k best other rows: query_id, rank (from 1), id, score.

    Components are floor(scale * x); the score is their inner product as a long, exact while it fits
    one. is_query is a condition on the table's columns. Ties go to the smaller id; with fewer than k
    candidates all are returned. Rows without an id or a vector, or with a null or non-finite
    component, take no part; vectors of different lengths are not compared. Rows are told apart by a number,
    not by their id: of rows that share an id each is a query of its own with its own k results, and each
    is a candidate of the others. An empty table gives no rows; other columns are ignored.

    Candidates and queries are dealt into blocks, and every pair of blocks is one group of two bounded
    tables; the best of each block are merged by a window over k rows a block and query.
    """
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), is_query.alias("asks"))
    # Written, so that a row has the same number in every later read.
    rows, _ = materialize(rows.withColumn("dim", F.size("v")), "topk-rows")
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-sizes[0] // CANDIDATES))
    query_blocks = max(1, -(-sizes[1] // QUERIES))
    part = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    cands = rows.select("dim", part(blocks, 1).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "row", "id", "v")
    asked = rows.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"), part(query_blocks, 2).alias("qb"), "row", "v")

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        grid = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        of = lambda t, c: t.column(c).to_numpy()
        if q.num_rows and c.num_rows:
            a, b, s = search_block(of(q, "row"), grid(q), of(c, "row"), of(c, "id"), grid(c), k)
        else:
            a = b = s = np.empty(0, np.int64)
        return pa.table({"asker": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    key = ["dim", "cb", "qb"]
    found = asked.groupBy(*key).cogroup(cands.groupBy(*key)).applyInArrow(search, "asker long, id long, score long")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = ranked.join(rows.where("asks").select("row", F.col("id").alias("query_id")), F.col("asker") == F.col("row"))
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

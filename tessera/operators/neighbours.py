"""Distances between the rows of two tables: pairs, neighbour statistics, modelability.

Tables are dealt into blocks; every pair of a query block and a reference block is one group of two
bounded tables, whose distances are computed as one matrix. Only what an operator asks for leaves a
block: statistics, near pairs, or (distance_matrix) all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.distances import from_one, pairwise, unit
from tessera.session import materialize

#: Rows of a block. Two blocks of 64-bit components and their matrix fit a task.
BLOCK = 2_048


def grid(t: pa.Table, name: str = "vec") -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    column = t.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def _fitted(rows: DataFrame, metric: str) -> np.ndarray | None:
    """Variances or the inverse covariance over all rows: sums of one matrix a task, width squared in size."""
    if metric not in ("seuclidean", "mahalanobis"):
        return None

    def sums(batches):
        total = None
        for batch in batches:
            x = grid(pa.Table.from_batches([batch]))
            x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            total = x1.T @ x1 if total is None else total + x1.T @ x1
        if total is not None:
            at = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total.ravel())], ["i", "j", "s"])

    got = rows.select("vec").mapInArrow(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    width = max(r["i"] for r in got)
    m = np.zeros((width + 1, width + 1))
    for r in got:
        m[r["i"], r["j"]] = r["s"]
    n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
    cov = (m[:-1, :-1] - n * np.outer(mean, mean)) / (n - 1)
    return np.diag(cov) if metric == "seuclidean" else np.linalg.inv(cov)


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


#: Rows and bytes of a block, as doubles, of which only statistics or the k best leave.
LARGE_BLOCK, LARGE_BYTES = 65_536, 32 << 20


def by_blocks(queries: DataFrame, refs: DataFrame, work: Callable, schema: str, block: int | None = None) -> DataFrame:
    """work(query table, reference table) for every pair of blocks. Both frames have id and vec, and more.

    A table is shuffled once for each block of the other. Without `block` blocks are as large as LARGE_BLOCK and LARGE_BYTES let
    them be while every core gets some pairs, so that below these bounds their number, and the copies of a row, do not grow.
    """
    refs_rows, queries_rows = refs.count(), queries.count()
    if block is None:
        width = refs.select(F.max(F.size("vec"))).first()[0] or 1
        most = max(PIECE, min(LARGE_BLOCK, LARGE_BYTES // (8 * width)))
        cores = queries.sparkSession.sparkContext.defaultParallelism
        block = int(min(most, max(PIECE, (refs_rows * queries_rows / (8 * cores)) ** 0.5)))
    refs_n, queries_n = (max(1, -(-n // block)) for n in (refs_rows, queries_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(_part(queries_n).alias("qb"), every(refs_n).alias("rb"), *queries.columns)
    # New names for the same columns, so that a table can meet itself.
    right = refs.select(every(queries_n).alias("qb"), _part(refs_n).alias("rb"), *[F.col(c).alias(c) for c in refs.columns])
    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(work, schema)


def _rows(df: DataFrame, id_col: str, features_col: str, *more: Column) -> DataFrame:
    """id and vec of the rows that have a vector. Components of 32 bits stay so until a block is read."""
    kind = "array<float>" if dict(df.dtypes)[features_col] == "array<float>" else "array<double>"
    return df.where(F.col(features_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(features_col).cast(kind).alias("vec"), *more)


#: Metrics whose matrix is one product of unit vectors.
PRODUCTS = ("cosine", "correlation")


def _prepared(metric: str, a: np.ndarray, b: np.ndarray, fitted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Both blocks and the function that gives the matrix of pieces of them; unit vectors are made once a block."""
    if metric not in PRODUCTS:
        return a, b, lambda x, y: pairwise(metric, x, y, fitted)
    if metric == "correlation":
        a, b = (x - x.mean(axis=1, keepdims=True) for x in (a, b))
    return unit(a), unit(b), from_one


def _one_by_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of unit vectors, row by row; the same for equal rows."""
    return 1 - np.einsum("ij,ij->i", a, b)


def distance_matrix(queries: DataFrame, refs: DataFrame, metric: str = "jaccard", id_col: str = "id", features_col: str = "features") -> DataFrame:
    """(query_id, ref_id, distance) of every pair, as many rows as the matrix has cells."""
    q, r = _rows(queries, id_col, features_col), _rows(refs, id_col, features_col)
    fitted = _fitted(r, metric)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        d = pairwise(metric, grid(a), grid(b), fitted) if a.num_rows and b.num_rows else np.empty((0, 0))
        ids = (a.column("id").to_numpy(), b.column("id").to_numpy()) if d.size else (np.empty(0, np.int64),) * 2
        return pa.table({"query_id": np.repeat(ids[0], len(ids[1])), "ref_id": np.tile(ids[1], len(ids[0])), "distance": d.ravel()})

    return by_blocks(q, r, work, "query_id long, ref_id long, distance double", BLOCK)


#: Rows of a block where only statistics leave it, and rows and columns of the pieces that its matrix is computed in.
WIDE_BLOCK, PIECE = 8_192, 512


def _row_statistics(a: pa.Table, b: pa.Table, same: bool, distances: Callable) -> pa.Table:
    """Of each id in two blocks (or in one met with itself) the statistics of its distances to rows with a larger id.

    Rows are sorted by id, so most pieces of the matrix lie wholly on one side: the smaller ids are all rows or all columns.
    """
    sides = []
    for t in (a, b):
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        n = len(ids)
        sides.append((ids[order], grid(t)[order], np.zeros(n, np.int64), np.full(n, np.nan), np.zeros(n), np.full(n, -np.inf)))
    x, y = sides

    def add(side: tuple, at: int, d: np.ndarray, where: np.ndarray | None, axis: int) -> None:
        _, _, n, least, total, most = side
        own = slice(at, at + d.shape[1 - axis])
        n[own] += d.shape[axis] if where is None else where.sum(axis=axis)
        least[own] = np.fmin(least[own], np.fmin.reduce(d if where is None else np.where(where, d, np.nan), axis=axis))
        total[own] += d.sum(axis=axis) if where is None else np.where(where, d, 0).sum(axis=axis)
        most[own] = np.maximum(most[own], d.max(axis=axis) if where is None else np.where(where, d, -np.inf).max(axis=axis))

    for i in range(0, len(x[0]), PIECE):
        p = x[0][i : i + PIECE]
        for j in range(0, len(y[0]), PIECE):
            q = y[0][j : j + PIECE]
            if same and p[0] >= q[-1]:
                continue
            d = distances(x[1][i : i + PIECE], y[1][j : j + PIECE])
            if p[-1] < q[0]:
                add(x, i, d, None, 1)
            elif q[-1] < p[0]:
                add(y, j, d, None, 0)
            else:
                add(x, i, d, p[:, None] < q[None, :], 1)
                if not same:
                    add(y, j, d, p[:, None] > q[None, :], 0)
    used = [x] if same else [x, y]
    ids, n, least, total, most = (np.concatenate([s[k] for s in used]) for k in (0, 2, 3, 4, 5))
    met = n > 0
    return pa.table({"query_id": ids[met], "n": n[met], "least": least[met], "total": total[met], "most": most[met]})


def larger_id_statistics(df: DataFrame, metric: str = "jaccard", id_col: str = "id", features_col: str = "features", block: int | None = None) -> DataFrame:
    """(query_id, n, least, mean, most) of each row's distances to the rows with a larger id; the last id has no row.

    As many distances as there are pairs are computed, each once, but none leaves its two blocks: these give one row an id. What
    is shuffled is the table once for each block of the others and these rows; memory is two blocks and one piece of a matrix.
    """
    rows = _rows(df, id_col, features_col)
    fitted = _fitted(rows, metric)
    # Dealt by place, as rows may repeat an id.
    placed, _ = materialize(rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "pairs-rows")
    total = placed.count()
    # Enough pairs of blocks to keep all cores busy to the end.
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = block or int(min(WIDE_BLOCK, max(PIECE, total / (8 * cores) ** 0.5)))
    n = max(1, -(-total // size))
    own = F.pmod("place", F.lit(n)).cast("int")
    every = lambda of: F.explode(F.sequence(*of))
    left = placed.select(own.alias("qb"), every((own, F.lit(n - 1))).alias("rb"), "id", "vec")
    right = placed.select(every((F.lit(0), own)).alias("qb"), own.alias("rb"), F.col("id").alias("id"), F.col("vec").alias("vec"))

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("least", "total", "most")}})
        return _row_statistics(a, b, key[0].as_py() == key[1].as_py(), lambda x, y: pairwise(metric, x, y, fitted, products=True))

    parts = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(work, "query_id long, n long, least double, total double, most double")
    return parts.groupBy("query_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))


def _first_forest(u: np.ndarray, v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The edges, as places in u and v, of the forest that takes edges in this order unless they close a cycle.

    Borůvka's rounds on arrays: every component takes its first edge; edges within a component go.
    """
    u, v = u[order], v[order]
    label, left, taken = np.arange(max(u.max(), v.max()) + 1), np.arange(len(u)), []
    while len(left):
        a, b = label[u[left]], label[v[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        first = np.full(len(label), -1)
        # Of several writes to a place the last counts, which is the first edge in order.
        both, ends = np.concatenate([left, left]), np.concatenate([a, b])
        back = np.argsort(-both, kind="stable")
        first[ends[back]] = both[back]
        roots = np.nonzero(first >= 0)[0]
        edge = first[roots]
        taken.append(np.unique(edge))
        other = np.where(label[u[edge]] == roots, label[v[edge]], label[u[edge]])
        parent = np.arange(len(label))
        parent[roots] = other
        mutual = (parent[parent] == np.arange(len(label))) & (np.arange(len(label)) < parent)
        parent[mutual] = np.nonzero(mutual)[0]
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        label = parent[label]
    return order[np.concatenate(taken)] if taken else np.empty(0, np.int64)


#: Rows that cells are built around, at most.
PIVOTS = 128


def _by_pivots(rows: DataFrame, metric: str, threshold: float, cells: int, block: int) -> DataFrame | None:
    """rows with `own`, their block, and `partners`, the blocks that may hold a row within the threshold.

    Every row belongs to the nearest of some rows, `cells` and PIVOTS at most; a cell has the radius of its furthest row. By the triangle
    inequality a row has no near row in a cell whose pivot is further than radius plus threshold. Cosine distances are
    half the squared euclidean ones of unit vectors. At the driver are the pivots and three numbers for each. None where no row is
    that far from any pivot: cells would only be uneven blocks.
    """
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, cells)).select("vec").collect()
    unit = lambda x: _safe_unit(x) if metric == "cosine" else x
    pivots = np.unique(unit(np.array([r["vec"] for r in chosen], np.float64)), axis=0)
    reach = (np.sqrt(2 * max(threshold, 0.0)) if metric == "cosine" else threshold) + 1e-7

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                d = pairwise("euclidean", unit(grid(pa.Table.from_batches([batch]))), pivots)
                yield d, d.argmin(axis=1), batch

    def radii(batches):
        for d, cell, _ in placed(batches):
            own = d[np.arange(len(d)), cell]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array([float(own[cell == c].max(initial=-1.0)) for c in range(len(pivots))]), pa.array(np.bincount(cell, minlength=len(pivots))), pa.array(d.max(axis=0))], ["cell", "radius", "n", "most"])

    found = {r["cell"]: r for r in rows.mapInArrow(radii, "cell long, radius double, n long, most double").groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"), F.max("most").alias("most")).collect()}
    if found and all(r["radius"] >= 0 and r["most"] <= r["radius"] + reach for r in found.values()):
        return None
    radius = np.array([found[c]["radius"] if c in found else -1.0 for c in range(len(pivots))])
    parts = np.array([max(1, -(-found[c]["n"] // block)) if c in found else 1 for c in range(len(pivots))])
    begin = np.concatenate([[0], np.cumsum(parts)])
    cell_of = np.repeat(np.arange(len(pivots)), parts)

    def dealt(batches):
        for d, cell, batch in placed(batches):
            ids = batch.column(0).to_numpy()
            own = begin[cell] + (ids * 2654435761 % 2**32 // 7) % parts[cell]
            near = (d <= radius + reach) & (radius >= 0)
            near[np.arange(len(d)), cell] = True
            met = near[:, cell_of]
            ends = np.concatenate([[0], np.cumsum(met.sum(axis=1))])
            partners = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(met)[1], pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), partners], [*batch.schema.names, "own", "partners"])

    return rows.mapInArrow(dealt, ", ".join([*(f"{name} {kind}" for name, kind in rows.dtypes), "own int", "partners array<int>"]))


def _by_sizes(rows: DataFrame, metric: str, threshold: float, block: int) -> DataFrame:
    """As _by_pivots for 0/1 vectors under jaccard or dice: blocks are ranges of the number of ones.

    Vectors of s and S >= s ones are at least 1 - s / S (jaccard) or 1 - 2 s / (s + S) (dice) apart. At the driver is a count
    for each number of ones, as many as vectors have components at most.
    """
    sized = rows.withColumn("size", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).cast("int"))
    least = 1 - threshold if metric == "jaccard" else (1 - threshold) / (1 + threshold)
    cells, held = [], 0  # (first size, last size, rows)
    for r in sized.groupBy("size").count().orderBy("size").collect():
        if cells and held + r["count"] <= block:
            cells[-1] = (cells[-1][0], r["size"], held + r["count"])
        else:
            cells.append((r["size"], r["size"], r["count"]))
        held = cells[-1][2]
    parts = [max(1, -(-n // block)) for _, _, n in cells]
    begin = np.concatenate([[0], np.cumsum(parts)])
    meets = lambda a, b: min(a[1], b[1]) + 1e-9 >= least * max(a[0], b[0])
    lists = [[int(k) for j, b in enumerate(cells) if meets(a, b) for k in range(begin[j], begin[j + 1])] for a in cells]
    table = rows.sparkSession.createDataFrame([(a[0], a[1], int(begin[i]), parts[i], lists[i]) for i, a in enumerate(cells)], "low int, high int, at int, parts int, partners array<int>")
    placed = sized.join(F.broadcast(table), (F.col("size") >= F.col("low")) & (F.col("size") <= F.col("high")))
    return placed.select(*rows.columns, (F.col("at") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("own"), "partners")


def _safe_unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)


def _dealt(rows: DataFrame, metric: str, threshold: float, cells: int, block: int, total: int) -> DataFrame:
    """rows with `own`, their block of about `block` rows, and `partners`, the blocks that may hold a near row."""
    dealt = None
    if cells > 1 and metric in ("euclidean", "cosine"):
        dealt = _by_pivots(rows, metric, threshold, cells, block)
    elif cells > 1 and metric in ("jaccard", "dice") and 0 <= threshold < 1:
        dealt = _by_sizes(rows, metric, threshold, block)
    if dealt is None:
        n = max(1, -(-total // block))
        dealt = rows.withColumns({"own": _part(n), "partners": F.sequence(F.lit(0), F.lit(n - 1))})
    return dealt


def _near_blocks(rows: DataFrame, metric: str, threshold: float, total: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of blocks (qb <= rb) that may hold a near pair."""
    n = max(1, -(-total // block))
    dealt = _dealt(rows, metric, threshold, n, block, total)
    if n > 1:
        dealt, _ = materialize(dealt, "near-blocks")
    left = dealt.select(F.col("own").alias("qb"), F.explode(F.filter("partners", lambda b: b >= F.col("own"))).alias("rb"), *rows.columns)
    right = dealt.select(F.explode(F.filter("partners", lambda b: b <= F.col("own"))).alias("qb"), F.col("own").alias("rb"), *[F.col(c).alias(c) for c in rows.columns])
    return left, right


def near_pairs(df: DataFrame, threshold: float, metric: str = "jaccard", id_col: str = "id", features_col: str = "features", spanning: bool = False, report: dict | None = None) -> DataFrame:
    """(src, dst, distance) with src < dst of the pairs at most `threshold` apart. Two blocks meet once.

    Where a bound exists (euclidean, cosine, jaccard, dice) and the table has several blocks, blocks are cells of like rows,
    and a row is sent only to blocks that may hold a near one; otherwise every two blocks meet. With `spanning` two
    blocks give only a least spanning forest of their near pairs, as many edges as they have rows at most: for any
    lower threshold, too, it links what all near pairs link. `report` gets the numbers of pairs visited and of all.
    """
    rows = _rows(df, id_col, features_col)
    fitted = _fitted(rows, metric)
    total = rows.count()
    left, right = _near_blocks(rows, metric, threshold, total, BLOCK)
    if report is not None:
        met = left.groupBy("qb", "rb").agg(F.count("*").alias("a")).join(right.groupBy("qb", "rb").agg(F.count("*").alias("b")), ["qb", "rb"])
        report["all"] = total * (total - 1) // 2
        report["visited"] = int(met.agg(F.sum(F.when(F.col("qb") == F.col("rb"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b")))).first()[0] or 0)

    def work(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        x, y = a.column("id").to_numpy(), b.column("id").to_numpy()
        d = pairwise(metric, grid(a), grid(b), fitted)
        near = d <= threshold
        i, j = np.nonzero(near & (x[:, None] < y[None, :]) if key[0].as_py() == key[1].as_py() else near & (x[:, None] != y[None, :]))
        src, dst, d = np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), d[i, j]
        if spanning and len(src):
            _, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
            kept = _first_forest(ends[: len(src)], ends[len(src) :], np.lexsort((dst, src, d)))
            src, dst, d = src[kept], dst[kept], d[kept]
        return pa.table({"src": src, "dst": dst, "distance": d})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(work, "src long, dst long, distance double")


#: Least rows of a block where lists of near rows leave it, and near pairs that a task holds before their lists leave (and
#: those of one more piece).
LIST_BLOCK, HELD = 4_096, 1 << 18


def _lists(ids: np.ndarray, own: np.ndarray, at: np.ndarray, near: np.ndarray, weight: np.ndarray) -> pa.Table:
    """near_lists of the rows at `at` (places in ids, not sorted), each beside a near id and its weight."""
    order = np.argsort(at, kind="stable")
    at, near, weight = at[order], near[order], weight[order]
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    ends = np.append(begin, len(at))
    first, held = at[begin], np.append(0, np.cumsum(weight))
    cut = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x))
    return pa.table({"id": ids[first], "own": own[first], "links": np.diff(ends), "rows": np.diff(held[ends]), "near": cut(near), "weight": cut(weight)})


def copies_of(df: DataFrame, threshold: float, metric: str = "jaccard", id_col: str = "id", features_col: str = "features") -> tuple[DataFrame, np.ndarray | None]:
    """(id, vec, others) of the different vectors, with the least id of their rows and how many rows more have them, and what the
    metric is fitted with. Vectors of several rows that are beyond the threshold of themselves are left out."""
    rows = _rows(df, id_col, features_col)
    fitted = _fitted(rows, metric)

    def within(batches):
        for batch in batches:
            many = np.flatnonzero(batch.column(2).to_numpy() > 0)
            keep = np.ones(batch.num_rows, bool)
            if len(many):
                keep[many] = [bool(pairwise(metric, x[None], x[None], fitted)[0, 0] <= threshold) for x in grid(pa.Table.from_batches([batch]).take(many))]
            yield batch.filter(pa.array(keep))

    found = rows.groupBy("vec").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("others")).select("id", "vec", "others")
    return materialize(found.mapInArrow(within, found.schema), "near-copies")[0], fitted


def near_lists(rows: DataFrame, threshold: float, metric: str, fitted: np.ndarray | None) -> DataFrame:
    """(id, own, links, rows, near, weight) for rows (id, vec, others): ids at most `threshold` from a row, how many rows each
    stands for, and how many these are.

    Blocks are so large that every core gets some pairs of them, within LARGE_BLOCK and LARGE_BYTES, so that below these bounds
    their number, and the copies of a row, do not grow; a row is sent once to each block that may hold a near one. An id has
    a list for each of these and for each HELD pairs that a task has found.
    """
    total, width = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block = max(LIST_BLOCK, min(LARGE_BLOCK, LARGE_BYTES // (8 * max(1, width or 1)), math.ceil(total / (8 * cores) ** 0.5)))
    dealt = _dealt(rows, metric, threshold, -(-total // LIST_BLOCK), block, total)
    sent = dealt.select(*rows.columns, "own", F.explode("partners").alias("to"))
    sent = sent.select(F.least("own", "to").alias("qb"), F.greatest("own", "to").alias("rb"), (F.col("own") > F.col("to")).alias("second"), *rows.columns)

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, sides = key[0].as_py() == key[1].as_py(), ([], [])
        for batch in batches:
            second = batch.column("second")
            for side, kept in zip(sides, (pc.invert(second), second), strict=True):
                part = batch.filter(kept)
                if part.num_rows:
                    # As they are sent; a piece at a time becomes doubles.
                    side.append((part.column("id").to_numpy(), part.column("others").to_numpy(), part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)))
        if not (sides[0] and (same or sides[1])):
            return
        x, own_x, u = first = [np.concatenate(c) for c in zip(*sides[0], strict=True)]
        y, own_y, v = first if same else [np.concatenate(c) for c in zip(*sides[1], strict=True)]
        found, held = [], 0

        def lists() -> Iterator[pa.RecordBatch]:
            p, q = (np.concatenate([pair[k] for pair in found]) for k in (0, 1))
            if same:
                p, q = np.concatenate([p, q]), np.concatenate([q, p])
            else:
                yield from _lists(y, own_y, q, x[p], own_x[p] + 1).to_batches()
            yield from _lists(x, own_x, p, y[q], own_y[q] + 1).to_batches()

        for i in range(0, len(x), PIECE):
            a = u[i : i + PIECE].astype(np.float64)
            for j in range(i if same else 0, len(y), PIECE):
                near = pairwise(metric, a, v[j : j + PIECE].astype(np.float64), fitted) <= threshold
                p, q = np.divmod(np.flatnonzero(near), near.shape[1])
                p, q = p + i, q + j
                apart = (x[p] != y[q]) & (p < q) if same else x[p] != y[q]
                found.append((p[apart], q[apart]))
                held += len(found[-1][0])
                if held >= HELD:
                    yield from lists()
                    found, held = [], 0
        if held:
            yield from lists()

    return sent.groupBy("qb", "rb").applyInArrow(work, "id long, own long, links long, rows long, near array<long>, weight array<long>")


STATS = "query_id long, scope string, grp string, n long, total double, least double, most double, near array<double>, far array<double>"
#: Columns of the pieces of a matrix of which sums and the k best are taken.
BROAD = 4_096


def _k_best(best: np.ndarray, d: np.ndarray) -> None:
    """Put into best, the ascending least values of each row so far (inf where there are fewer), those of d that are less.

    Once best has values of some pieces few cells pass, so a row costs a comparison for each cell.
    """
    k = best.shape[1]
    if not k:
        return
    fresh = np.isinf(best[:, -1])
    if fresh.any() and d.shape[1] > k:
        best[fresh] = np.sort(np.concatenate([best[fresh], np.partition(d[fresh], k - 1, axis=1)[:, :k]], axis=1), axis=1)[:, :k]
    elif fresh.any():
        best[fresh] = np.sort(np.concatenate([best[fresh], d[fresh]], axis=1), axis=1)[:, :k]
    at = np.flatnonzero(d < np.where(fresh, -np.inf, best[:, -1])[:, None])
    if not len(at):
        return
    i = at // d.shape[1]
    begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    rows, count = i[begin], np.diff(np.append(begin, len(i)))
    more = np.full((len(rows), int(count.max())), np.inf)
    more[np.repeat(np.arange(len(rows)), count), np.arange(len(i)) - np.repeat(begin, count)] = d.ravel()[at]
    best[rows] = np.sort(np.concatenate([best[rows], more], axis=1), axis=1)[:, :k]


def _stats(ids: np.ndarray, groups: list | None, scope: str, a: np.ndarray, b: np.ndarray, others: np.ndarray | None, distances: Callable, near: int, far: int) -> list[tuple]:
    """Of each row of a the statistics of its distances to the rows of b, but for those whose id in others is its own.

    The matrix is computed in pieces; of what is left of a row between pieces are a count, a sum, two ends and the k best.
    """
    out = []
    for i in range(0, len(a), PIECE):
        own = ids[i : i + PIECE]
        m = len(own)
        n, total, least, most = np.zeros(m, np.int64), np.zeros(m), np.full(m, np.inf), np.full(m, -np.inf)
        nearest, furthest = np.full((m, near), np.inf), np.full((m, far), np.inf)
        for j in range(0, len(b), BROAD):
            d = distances(a[i : i + PIECE], b[j : j + BROAD])
            hidden = None if others is None else own[:, None] == others[None, j : j + BROAD]
            if hidden is not None and hidden.any():
                hidden |= np.isnan(d)
            elif np.isnan(d.sum()):
                hidden = np.isnan(d)
            else:
                hidden = None
            if hidden is None:
                n += d.shape[1]
                total += d.sum(axis=1)
            else:
                n += d.shape[1] - hidden.sum(axis=1)
                total += np.where(hidden, 0, d).sum(axis=1)
            low = d if hidden is None else np.where(hidden, np.inf, d)
            np.minimum(least, low.min(axis=1, initial=np.inf), out=least)
            _k_best(nearest, low)
            high = np.negative(d) if hidden is None else np.where(hidden, np.inf, -d)
            np.maximum(most, -high.min(axis=1, initial=np.inf), out=most)
            _k_best(furthest, high)
        for r in np.flatnonzero(n):
            group = None if groups is None else groups[i + r]
            out.append((int(own[r]), scope, group, int(n[r]), float(total[r]), float(least[r]), float(most[r]), nearest[r, : n[r]].tolist(), (-furthest[r, : n[r]]).tolist()))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    names = ["query_id", "scope", "grp", "n", "total", "least", "most", "near", "far"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _merged(parts: DataFrame, nearest_k: list[int], furthest_k: list[int], *keys: str) -> DataFrame:
    """The statistics of blocks combined: k of the k best of each block, one short list a block."""
    mean = lambda lists, k, order: F.aggregate(F.slice(F.array_sort(lists, order) if order else F.array_sort(lists), 1, k), F.lit(0.0), lambda a, x: a + x) / F.least(F.size(lists), F.lit(k))
    desc = lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)
    one = parts.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("min"), F.max("most").alias("max"), F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("far")).alias("far"))
    return one.select(*keys, "min", "mean", "max", *[mean(F.col("near"), k, None).alias(f"nearest_{k}") for k in nearest_k], *[mean(F.col("far"), k, desc).alias(f"furthest_{k}") for k in furthest_k])


def k_neighbors_distance(queries: DataFrame, refs: DataFrame | None = None, metric: str = "jaccard", nearest_k: list[int] | None = None, furthest_k: list[int] | None = None, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """Per query: min, mean, max distance to the references and the mean of its k nearest and furthest.

    Without refs the table is compared with itself, a row never with its own id. Where fewer than k
    references exist, the mean is over those that do.
    """
    near, far = nearest_k or [], furthest_k or []
    q = _rows(queries, id_col, features_col)
    r = q if refs is None else _rows(refs, id_col, features_col)
    fitted, itself = _fitted(r, metric), refs is None

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _table([])
        ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
        # Equal ids are dealt to blocks of one number.
        shared = itself and bool(np.isin(ids, others).any())
        u, v, distances = _prepared(metric, grid(a), grid(b), fitted)
        return _table(_stats(ids, None, "all", u, v, others if shared else None, distances, max(near, default=0), max(far, default=0)))

    return _merged(by_blocks(q, r, work, STATS), near, far, "query_id").withColumnRenamed("query_id", id_col)


def group_k_neighbors_distance(df: DataFrame, features_col: str, group_col: str, metric: str = "jaccard", nearest_k: list[int] | None = None, furthest_k: list[int] | None = None, id_col: str = "id") -> DataFrame:
    """k_neighbors_distance of the rows of each group, within the group (Intra) and to all others (Inter).

    The group is a value or an array of values; a row of several groups is a query in each. One row per
    scope, group and query.
    """
    near, far = nearest_k or [], furthest_k or []
    many = dict(df.dtypes)[group_col].startswith("array")
    groups = F.col(group_col).cast("array<string>") if many else F.array(F.col(group_col).cast("string"))
    rows = _rows(df, id_col, features_col, groups.alias("groups"))
    queries = rows.select("id", "vec", F.explode("groups").alias("grp"))
    fitted = _fitted(rows, metric)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return _table([])
        ids, others = a.column("id").to_numpy(), b.column("id").to_numpy()
        shared = bool(np.isin(ids, others).any())
        members: dict = {}
        for at, held in enumerate(b.column("groups").to_pylist()):
            for g in set(held):
                members.setdefault(g, []).append(at)
        asking: dict = {}
        for at, g in enumerate(a.column("grp").to_pylist()):
            asking.setdefault(g, []).append(at)
        u, v, distances = _prepared(metric, grid(a), grid(b), fitted)
        k, out = (max(near, default=0), max(far, default=0)), []
        for g, rows_of in asking.items():
            inside = np.zeros(len(others), bool)
            inside[members.get(g, [])] = True
            own, own_ids, name = u[rows_of], ids[rows_of], [g] * len(rows_of)
            out += _stats(own_ids, name, "Intra", own, v[inside], others[inside] if shared else None, distances, *k)
            out += _stats(own_ids, name, "Inter", own, v[~inside], None, distances, *k)
        return _table(out)

    return _merged(by_blocks(queries, rows, work, STATS), near, far, "scope", "grp", "query_id").withColumnRenamed("query_id", id_col)


def _nearest(metric: str, ids: np.ndarray, others: np.ndarray, a: np.ndarray, b: np.ndarray, fitted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a the least distance to a row of b with another id (inf if there is none) and the first place that has it.

    Products of matrices may differ in the last digits for equal rows, by where these lie. Cells within their error of the
    least are computed again pair by pair, so that equal rows are equally far and the first of them is taken.
    """
    u, v, distances = _prepared(metric, a, b, fitted)
    error = 8e-16 * u.shape[1] if metric in PRODUCTS else 0.0
    shared = bool(np.isin(ids, others).any())
    best, pick = np.full(len(a), np.inf), np.zeros(len(a), np.int64)
    for i in range(0, len(a), PIECE):
        for j in range(0, len(b), BROAD):
            d = distances(u[i : i + PIECE], v[j : j + BROAD])
            if shared:
                d[ids[i : i + PIECE, None] == others[None, j : j + BROAD]] = np.inf
            now = best[i : i + PIECE]
            low = np.fmin.reduce(d, axis=1)
            rows = np.flatnonzero(low - error < now)
            p, q = np.nonzero(d[rows] <= np.minimum(now[rows], low[rows])[:, None] + error)
            p = rows[p]
            exact = _one_by_one(u[i + p], v[j + q]) if error else d[p, q]
            exact = np.where(np.isinf(d[p, q]), np.inf, exact)
            order = np.lexsort((q, exact, p))
            p, q, exact = p[order], q[order], exact[order]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
            p, q, exact = p[first], q[first], exact[first]
            # A later place counts only if it is nearer, as places ascend by id.
            less = exact < now[p]
            best[i + p[less]], pick[i + p[less]] = exact[less], j + q[less]
    return best, pick


def nearest_label(df: DataFrame, label_col: str, metric: str = "jaccard", id_col: str = "id", features_col: str = "features") -> DataFrame:
    """(id, label, nearest_id, nearest_label): each row's nearest other row; of equal distances, the smaller id."""
    rows = _rows(df, id_col, features_col, F.col(label_col).alias("label"))
    kind = dict(rows.dtypes)["label"]
    fitted = _fitted(rows, metric)

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(np.argsort(b.column("id").to_numpy(), kind="stable")) if b.num_rows else b
        at, d, pick = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        if a.num_rows and b.num_rows:
            d, pick = _nearest(metric, a.column("id").to_numpy(), b.column("id").to_numpy(), grid(a), grid(b), fitted)
            at = np.flatnonzero(np.isfinite(d))
            d, pick = d[at], pick[at]
        return pa.table({"id": a.column("id").take(at), "label": a.column("label").take(at), "distance": pa.array(d, pa.float64()), "nearest_id": b.column("id").take(pick), "nearest_label": b.column("label").take(pick)})

    found = by_blocks(rows, rows, work, f"id long, label {kind}, distance double, nearest_id long, nearest_label {kind}")
    best = found.groupBy("id", "label").agg(F.min(F.struct("distance", "nearest_id", "nearest_label")).alias("n"))
    return best.select(F.col("id").alias(id_col), "label", "n.nearest_id", "n.nearest_label")


def modi_index(df: DataFrame, label_col: str, metric: str = "jaccard", id_col: str = "id", features_col: str = "features") -> DataFrame:
    """One row, modi: the mean over classes of the share of rows whose nearest row is of their class."""
    shares = nearest_label(df, label_col, metric, id_col, features_col).groupBy("label").agg(F.avg((F.col("label") == F.col("nearest_label")).cast("double")).alias("share"))
    return shares.agg(F.avg("share").alias("modi"))

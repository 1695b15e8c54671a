"""Exact k-nearest-neighbour regression (J13) by pivots and the triangle inequality.

Equal training vectors are equally far from any query, so of each vector only the k
rows of smallest id can be neighbours; the others go first.  A bounded number of
training rows (those of smallest id hash) are pivots; every training row belongs to
its nearest pivot's cell, and each cell knows its size and radius.  The queries of
neighbouring cells make groups, and neighbouring cells make slabs of training rows,
neither of more than ``block_rows`` rows.

A few rows of the cells nearest to a query give an upper bound of its k-th distance.
A query then visits the slabs with a cell that can hold a row within the bound
(distance to the pivot less the radius); a training row is copied to the groups with
such a query, not to each query.  In a cell only rows whose distance to the pivot
differs from the query's by the bound at most are compared: by a matrix product with
a margin for its rounding, then exactly.  Rows are ranked by (distance, id); the
results of the slabs are merged by a grouped top-k.  Only the pivots and one row per
cell pass through the driver; distances to pivots are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matfold.operators.models import materialize
from matfold.session import ship_package

#: Most rows of a group of queries or a slab of training rows, fewer if their vectors are long.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS = 16384, 1 << 25, 1024
#: Training rows per pivot, and the most pivots there are.
PIVOT_ROWS, MAX_PIVOTS = 1024, 1024
#: Rows of a cell that bound the k-th distance of the queries next to it.
BOUND_ROWS = 256
#: Distances held at once.
TILE = 1 << 20


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(arr):
        return np.zeros((0, 0))
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(arr), -1)


def _rows(df: DataFrame, id_col: str, vec_col: str, label_col: str | None) -> DataFrame:
    # a missing label makes the mean NaN
    label = [F.coalesce(F.col(label_col).cast("double"), F.lit(float("nan"))).alias("label")] if label_col else []
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *label)
    return rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, TILE // max(1, width))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _far(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to all pivots, one component after the other."""
    d = np.zeros((len(X), len(pivots)))
    for x, p in zip(X.T, pivots.T, strict=True):
        d += (x[:, None] - p) ** 2
    return np.sqrt(d)


def _groups(weight: np.ndarray, pivots: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell: the first of its groups and their number.  Neighbouring cells share one while it has room."""
    first, parts, todo, n = np.zeros(len(weight), np.int64), np.ones(len(weight), np.int64), [np.arange(len(weight))], 0
    while todo:
        cells = todo.pop()
        if len(cells) > 1 and weight[cells].sum() > most:
            axis = np.ptp(pivots[cells], axis=0).argmax()
            cells = cells[np.argsort(pivots[cells, axis], kind="stable")]
            half = int(np.clip(np.searchsorted(np.cumsum(weight[cells]), weight[cells].sum() / 2), 1, len(cells) - 1))
            todo += [cells[:half], cells[half:]]
        else:
            first[cells], parts[cells] = n, max(1, math.ceil(weight[cells].sum() / most)) if len(cells) == 1 else 1
            n += parts[cells[0]]
    return first, parts


def _homes(pivots: np.ndarray, held: np.ndarray, k: int) -> list[list[int]]:
    """Per cell: the nearest cells, itself first, that hold k rows together (all, if there are fewer)."""
    out = []
    for p in pivots:
        order = np.argsort(((pivots - p) ** 2).sum(1), kind="stable")
        order = order[held[order] > 0]
        out.append(order[:np.searchsorted(np.cumsum(held[order]), k) + 1].tolist())
    return out


def _in_cell(pivot: np.ndarray, Q: np.ndarray, bound: np.ndarray, X: np.ndarray, far: np.ndarray,
             radius: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, squared distance) of all that can be among the k nearest; rows by ``far``; ``bound`` (squared) sinks."""
    dq = np.sqrt(((Q - pivot) ** 2).sum(1))
    slack = 1e-9 * (1 + dq)
    asked = np.flatnonzero(~(dq - radius > np.sqrt(bound) * (1 + 1e-9) + slack))
    asked = asked[np.argsort(dq[asked], kind="stable")]
    norm = (X ** 2).sum(1)
    for i in range(0, len(asked), 256):
        part = asked[i:i + 256]
        reach = np.sqrt(bound[part]) * (1 + 1e-9) + slack[part]
        low, high = (dq[part] - reach).min(), (dq[part] + reach).max()
        a = np.searchsorted(far, low) if np.isfinite(low) else 0
        z = np.searchsorted(far, high, "right") if np.isfinite(high) else len(far)
        for j in range(a, z, TILE // 256):
            x, own = X[j:min(z, j + TILE // 256)], (Q[part] ** 2).sum(1)
            n = norm[j:j + len(x)]
            about = own[:, None] + n - 2 * (Q[part] @ x.T)
            error = 1e-12 * (own + n.max()) * max(1, x.shape[1] / 64)
            hit = ~(about > (bound[part] * (1 + 1e-9) + error)[:, None])
            if len(x) > k and hit.sum() > 4 * k * len(part):
                kth = np.partition(about, k - 1, axis=1)[:, k - 1] + error
                bound[part] = np.fmin(bound[part], kth)
                hit = ~(about > (bound[part] * (1 + 1e-9) + error)[:, None])
            q, r = np.nonzero(hit)
            for s in range(0, len(q), TILE // max(1, x.shape[1])):
                qs, rs = q[s:s + TILE // max(1, x.shape[1])], r[s:s + TILE // max(1, x.shape[1])]
                yield part[qs], rs + j, ((x[rs] - Q[part[qs]]) ** 2).sum(axis=1)


def _least(found: list[tuple], ids: np.ndarray, missing: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query by distance and id, null ids last."""
    q, r, d = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, np.float64)))
    order = np.lexsort((ids[r], missing[r], d, q))
    q, r, d = q[order], r[order], d[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else q
    turn = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = turn < k
    return q[keep], r[keep], d[keep]


def _search(cells: DataFrame, visits: DataFrame, pairs: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int) -> DataFrame:
    """(test_id, train_id, dist, label): the k nearest rows of every (query, slab) visit; ``pairs`` are the cells that each group visits."""
    def search(_: tuple, queries: pa.Table, base: pa.Table) -> pa.Table:
        base = base.take(pa.array(np.lexsort((base["far"].to_numpy(), base["cell"].to_numpy()))))
        Q, X, cell, far = _matrix(queries["vec"]), _matrix(base["vec"]), base["cell"].to_numpy(), base["far"].to_numpy()
        bound = queries["bound"].to_numpy().copy()
        missing = base["id"].is_null().to_numpy()
        ids = base["id"].fill_null(0).to_numpy()
        found: list[tuple] = []
        for c in np.unique(cell) if len(Q) else []:
            a, z = np.searchsorted(cell, c), np.searchsorted(cell, c, "right")
            for q, r, d in _in_cell(pivots[c], Q, bound, X[a:z], far[a:z], radius[c], k):
                found.append((q, r + a, d))
                if sum(len(f[0]) for f in found) > 2 * TILE:
                    found = [_least(found, ids, missing, k)]
        q, r, d = _least(found, ids, missing, k)
        return pa.table([queries["id"].take(pa.array(q)), base["id"].take(pa.array(r)), pa.array(d), base["label"].take(pa.array(r))],
                        ["test_id", "train_id", "dist", "label"])

    base = cells.hint("merge").join(pairs, "cell").select("grp", "slab", "cell", "far", "id", "vec", "label")
    return (visits.groupBy("grp", "slab").cogroup(base.groupBy("grp", "slab"))
            .applyInArrow(search, "test_id long, train_id long, dist double, label double"))


def knn_candidates(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, label_col: str,
                   k: int = 7, block_rows: int = BLOCK_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(test_id, train_id, dist, label): each test row's k nearest training rows by (squared distance, id).

    All, if there are fewer than k.  Rows without a vector, or with a null or NaN in
    it, take no part.
    """
    spark = train.sparkSession
    ship_package(spark)
    same = Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"), "label")
    rows = materialize(_rows(train, id_col, vec_col, label_col).withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r"))
    count = min(MAX_PIVOTS, math.ceil(rows.count() / pivot_rows))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
    if not picked:
        return spark.createDataFrame([], "test_id long, train_id long, dist double, label double")
    pivots = np.unique(np.array([r["vec"] for r in picked], np.float64), axis=0)
    width = len(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, width):
            d = _far(_matrix(b.column("vec")), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*b.schema.names, "cell", "far"])

    cells = materialize(rows.mapInArrow(nearest, "id long, vec array<double>, label double, cell int, far double"))
    asked = materialize(_rows(test, id_col, vec_col, None).mapInArrow(nearest, "id long, vec array<double>, cell int, far double"))
    # one row per pivot
    size, radius, weight = np.zeros(width, np.int64), np.zeros(width), np.zeros(width, np.int64)
    for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect():
        size[r["cell"]], radius[r["cell"]] = r["n"], r["radius"]
    for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        weight[r["cell"]] = r["n"]
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, pivots.shape[1]))))
    slab, slabs = _groups(size, pivots, min(most, max(LEAST_ROWS, math.ceil(size.sum() / 8))))
    group, groups = _groups(weight, pivots, min(most, max(LEAST_ROWS, math.ceil(weight.sum() / 4))))

    def dealt(first: np.ndarray, parts: np.ndarray, by: Column) -> Column:
        """The group or slab of a row: one of its cell's."""
        at = lambda x: F.element_at(F.lit(x.tolist()), F.col("cell") + 1)
        return (at(first) + F.pmod(by, at(parts))).cast("int")

    cells = cells.withColumn("slab", dealt(slab, slabs, F.xxhash64("id", "vec")))
    asked = asked.withColumn("grp", dealt(group, groups, F.monotonically_increasing_id()))
    homes = _homes(pivots, np.minimum(size, BOUND_ROWS), k)

    def bounded(_: tuple, queries: pa.Table, samples: pa.Table) -> pa.Table:
        Q, X, cell, own = _matrix(queries["vec"]), _matrix(samples["vec"]), queries["cell"].to_numpy(), samples["cell"].to_numpy()
        bound = np.full(len(Q), np.inf)
        for c in np.unique(cell):
            x, mine = X[np.isin(own, homes[c])], np.flatnonzero(cell == c)
            step = max(1, TILE // max(1, len(x)))
            for i in range(0, len(mine) if len(x) >= k else 0, step):
                part = mine[i:i + step]
                bound[part] = np.partition(_far(Q[part], x) ** 2, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
        return queries.select(["id", "vec", "grp"]).append_column("bound", pa.array(bound))

    first = Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id")
    samples = cells.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= BOUND_ROWS).select("cell", "vec")
    near = spark.createDataFrame([(c, int(h)) for c in np.flatnonzero(weight).tolist() for h in homes[c]], "cell int, home int")
    near = asked.select("grp", "cell").distinct().join(near, "cell").select(F.col("grp").alias("by"), F.col("home").alias("cell")).distinct()
    near = samples.hint("merge").join(near, "cell").select("by", "cell", "vec")
    asked = materialize(asked.select("id", "vec", "cell", "grp").groupBy("grp").cogroup(near.groupBy("by"))
                        .applyInArrow(bounded, "id long, vec array<double>, grp int, bound double"))

    holds = np.zeros((width, int((slab + slabs).max())), np.float32)
    for c in np.flatnonzero(size):
        holds[c, slab[c]:slab[c] + slabs[c]] = 1

    def reach(b: pa.RecordBatch) -> np.ndarray:
        far, limit = _far(_matrix(b.column("vec")), pivots), np.sqrt(b.column("bound").to_numpy())[:, None] * (1 + 1e-9)
        return ~(far - radius > limit + 1e-9 * (1 + far)) & (size > 0)

    def visited_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, width):
            row, cell = np.nonzero(reach(b))
            both = np.unique(np.c_[b.column("grp").to_numpy()[row], cell], axis=0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["grp", "cell"])

    def visited_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, max(width, holds.shape[1])):
            row, at = np.nonzero(reach(b).astype(np.float32) @ holds)
            for i in range(0, len(row), most):
                take = b.take(pa.array(row[i:i + most]))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(at[i:i + most].astype(np.int32))], [*take.schema.names, "slab"])

    pairs = asked.select("vec", "grp", "bound").mapInArrow(visited_cells, "grp int, cell int").distinct()
    visits = asked.mapInArrow(visited_slabs, "id long, vec array<double>, grp int, bound double, slab int")
    cand = _search(cells, visits, pairs, pivots, radius, k)
    # at most k rows per visited slab
    w = Window.partitionBy("test_id").orderBy("dist", F.asc_nulls_last("train_id"), "label")
    return cand.select("*", F.row_number().over(w).alias("_r")).where(F.col("_r") <= k).drop("_r")


def knn_regress(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, label_col: str,
                k: int = 7, block_rows: int = BLOCK_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    top = knn_candidates(train, test, id_col, vec_col, label_col, k, block_rows, pivot_rows)
    return top.groupBy(F.col("test_id").alias(id_col)).agg(F.avg("label").alias("prediction"),
                                                           F.count(F.lit(1)).cast("long").alias("n_neighbors"))

"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates are dealt into blocks of about ``BLOCK`` vectors by a hash of id
and vector, queries into blocks of about ``QUERIES``; each block is one row
with a matrix in the smallest integers that hold it.  A stripe of candidate
blocks and a block of queries are one unit of work.  A candidate block keeps a
sorted list of its values per dimension.  ``TILE`` queries walk all lists
together, from each end that one of them favours by its own component; what
they meet is scored in full by one matrix product for all of them.  A query
leaves the walk when its bound (the sum of its components times the values now
reached) lies below its k-th best score, that of the blocks before included,
so it passes by a block whose first entries already lie below.  Lists are read
``STEP`` entries at first and twice as many in each further step.  Per query
and stripe at most k results leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matfold.llm.common import prepare

BLOCK, QUERIES, STEP = 4096, 8192, 32
#: Most values of a block (long vectors make blocks of fewer rows), and most blocks of a stripe.
VALUES, STRIPE = 1 << 20, 8
#: Queries that walk together; scores that are first looked at by their maximum alone.
TILE, RUN = 512, 64
#: The score of no row.
NONE = np.iinfo(np.int64).min


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, computed in double; null if the vector is
    null or has a null or non-finite component."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vec.isNotNull() & fine, F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score, then id."""
    order = np.lexsort((ids, -score, q))
    at = q[order]
    order = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
    return q[order], ids[order], score[order]


def _raise(cut: np.ndarray, q: np.ndarray, score: np.ndarray, k: int) -> None:
    """Lift ``cut`` to the last score of the queries that have k; ``q`` and ``score`` as of ``_best``."""
    held = np.bincount(q, minlength=len(cut))
    full = np.flatnonzero(held >= k)
    cut[full] = np.maximum(cut[full], score[np.cumsum(held)[full] - 1])


def _above(weight: np.ndarray, rows: np.ndarray, ids: np.ndarray, own: np.ndarray, cut: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row, score) of all that can be among a query's k best and are not below its cut; ``ids`` ascend."""
    x = np.zeros((-(-len(rows) // RUN) * RUN, rows.shape[1]), rows.dtype)
    x[:len(rows)] = rows
    score = weight @ x.T
    score[:, len(rows):] = NONE
    a, z = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
    for q in np.flatnonzero(z > a):
        score[q, a[q]:z[q]] = NONE
    runs = score.reshape(len(weight), -1, RUN)
    peak = runs.max(2)
    most = peak if peak.shape[1] >= k else score  # of k runs the maxima are k scores
    if most.shape[1] >= k:
        cut = np.maximum(cut, np.partition(most, -k, axis=1)[:, -k])
    q, r = np.nonzero(peak >= cut[:, None])
    some = runs[q, r]
    hit, at = np.nonzero((some >= cut[q][:, None]) & (some > NONE))
    q, at, score = q[hit], r[hit] * RUN + at, some[hit, at]
    # of the rows that tie with the cut only the k of least id can count
    tied = score == cut[q]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][:len(q)])
    turn = np.cumsum(tied)
    turn -= np.repeat((turn - tied)[first], np.diff(np.r_[first, len(q)]))
    keep = ~tied | (turn <= k)
    return q[keep], at[keep], score[keep]


def threshold_top(matrix: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
                  least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query place, id, score) of each query's k best rows, and the number of rows scored.

    ``ids`` ascend; a query does not find its own id; ties go to smaller ids;
    of ``least``, a score per query, rows below it are left out.
    """
    n, dims = matrix.shape
    order = np.argsort(np.ascontiguousarray(matrix.T), axis=1, kind="stable").T  # per dimension, ascending
    values = np.take_along_axis(matrix, order, 0)
    size, length = (lambda m: max(1, -int(m.min(initial=0)), int(m.max(initial=0)))), (lambda m: np.square(m, dtype=np.float64).sum(1).max(initial=0) ** 0.5)
    exact = np.float64 if size(matrix) * size(queries) * dims < 1 << 53 else np.int64  # products and sums that doubles hold exactly
    kind = np.float32 if exact is np.float64 and length(matrix) * length(queries) < (1 << 24) - 1 else exact  # of scores, the same for floats
    table, floor = matrix.astype(kind), np.full(len(queries), NONE, kind) if least is None else least.astype(kind)
    found, scored = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for t in range(0, len(queries), TILE):
        w, own, cut = queries[t:t + TILE].astype(exact), query_ids[t:t + TILE], floor[t:t + TILE]
        up, down, weight = np.maximum(w, 0), np.minimum(w, 0), w.astype(kind)
        q, i, s = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0, kind)
        # nothing unseen scores above the bound; a tie could still have a smaller id
        bound = lambda at, depth: up[at] @ values[n - 1 - depth].astype(exact) + down[at] @ values[depth].astype(exact)  # noqa: B023, E731
        walking = np.arange(len(w))
        walking = walking[bound(walking, 0) >= cut] if n else walking
        met, depth, step = np.zeros(n, bool), 0, STEP
        while depth < n and len(walking):
            end = min(depth + step, n)
            high, low = (up[walking] > 0).any(0), (down[walking] < 0).any(0)
            new = np.full(n, not (high.any() or low.any()))
            new[order[n - end:n - depth, high]] = True
            new[order[depth:end, low]] = True
            rows = np.flatnonzero(new & ~met)
            met[rows] = True
            scored += len(walking) * len(rows)
            for j in range(0, len(rows), BLOCK):
                part = rows[j:j + BLOCK]
                more = _above(weight[walking], table[part], ids[part], own[walking], cut[walking], k)
                q, i, s = _best(np.concatenate([q, walking[more[0]]]), np.concatenate([i, ids[part][more[1]]]), np.concatenate([s, more[2]]), k)
                _raise(cut, q, s, k)
            if met.all():
                break
            walking = walking[bound(walking, end - 1) >= cut[walking]]
            depth, step = end, step * 2
        found.append((q + t, i, s.astype(np.int64)))
    return *(np.concatenate(c) for c in zip(*found, strict=True)), scored


def _blocks(rows: DataFrame, size: int, total: int) -> tuple[DataFrame, int]:
    """One row (block, ids, matrix, width) per block of (id, v) rows, ids ascending; the number of blocks."""
    n = max(1, math.ceil(total / size))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        flat = t["v"].combine_chunks().flatten().to_numpy().astype(np.int64)
        width = next(w for w in (2, 4, 8) if w == 8 or max(-int(flat.min(initial=0)) - 1, int(flat.max(initial=0))) < 1 << 8 * w - 1)
        return pa.table({"block": t["block"].slice(0, 1), "ids": pa.array([t["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
                         "matrix": pa.array([flat.astype(f"i{width}").tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, matrix binary, width int"), n


def _unpack(t: pa.Table, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(matrix, ids) of every block."""
    for r in range(t.num_rows):
        ids = np.frombuffer(t["ids"][r].as_py(), np.int64)
        yield np.frombuffer(t["matrix"][r].as_py(), f"i{t['width'][r].as_py()}").reshape(len(ids), dims), ids


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``.

    The score is the inner product of the quantised vectors, exact in 64 bits;
    a query does not find rows of its own id; ties go to the smaller id.
    Vectors that are null, hold a null or non-finite component, or have a null
    id take no part; where the length differs from the most frequent one, so
    does that row; rows that repeat an id each count; fewer candidates than k
    give fewer results; other columns are ignored; empty tables give an empty
    result.
    """
    spark = vectors.sparkSession
    prepare(spark)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col)).alias("v")).where("id is not null and v is not null")
    cand, quer = clean(vectors), clean(queries)
    sizes = cand.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = sizes["d"]
    cand, quer = cand.where(F.size("v") == dims), quer.where(F.size("v") == dims)
    room = max(1, VALUES // max(1, dims))
    left, n_left = _blocks(cand, min(BLOCK, room), sizes["n"])
    right, n_right = _blocks(quer, min(QUERIES, 2 * room), quer.count())
    per = min(STRIPE, max(1, n_left * n_right // (8 * spark.sparkContext.defaultParallelism)))
    stripes = math.ceil(n_left / per)
    left = left.withColumn("stripe", F.col("block") % stripes).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = right.withColumnRenamed("block", "qblock").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        qids = np.zeros(0, np.int64)
        for queries, qids in _unpack(asked, dims):  # one block
            least = np.full(len(qids), NONE)
            for matrix, ids in _unpack(blocks, dims):
                found = threshold_top(matrix, ids, queries, qids, k, least)
                best = _best(*(np.concatenate(c) for c in zip(best, found[:3], strict=True)), k)
                _raise(least, best[0], best[2], k)
        return pa.table({"query_id": qids[best[0]], "vec_id": best[1], "score": best[2]})

    cells = left.groupBy("stripe", "qblock").cogroup(right.groupBy("stripe", "qblock"))
    best = cells.applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

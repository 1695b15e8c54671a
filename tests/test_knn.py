"""kNN by groups and slabs: nothing per query and pivot is moved, ranks agree with brute force."""

import numpy as np

from matfold.operators import knn


def frames(spark, X, ids, y, Q, asked):
    train = spark.createDataFrame(list(zip(ids, X, y, strict=True)), "id long, v array<double>, y double")
    return train, spark.createDataFrame(list(zip(asked, Q, strict=True)), "id long, v array<double>")


def test_knn_broadcasts_no_query(spark):
    rng = np.random.default_rng(3)
    train, test = frames(spark, rng.normal(size=(200, 2)).tolist(), range(200), [0.0] * 200, rng.normal(size=(50, 2)).tolist(), range(50))
    found = knn.knn_candidates(train, test, "id", "v", "y", k=3, pivot_rows=4)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 150


def test_knn_with_repeated_vectors_null_ids_and_null_components(spark):
    rng = np.random.default_rng(4)
    n = 300
    X = rng.integers(0, 3, (n, 2)).astype(float).tolist()
    X[3], X[4], X[5] = None, [None, 1.0], [float("nan"), 1.0]
    ids = [i // 2 if i % 11 else None for i in range(n)]
    y = rng.normal(size=n).tolist()
    Q = rng.integers(0, 4, (40, 2)).astype(float).tolist()
    Q[1], Q[2] = None, [1.0, None]
    asked = [i // 3 if i % 7 else None for i in range(40)]
    usable = lambda v: v is not None and all(c is not None and c == c for c in v)
    per = {}
    for q, v in zip(asked, Q, strict=True):
        if usable(v):
            per.setdefault(q, []).extend((sum((a - b) ** 2 for a, b in zip(v, x)), i is None, i or 0, t) for i, x, t in zip(ids, X, y, strict=True) if usable(x))
    want = sorted((q is None, q or 0, *c) for q, cs in per.items() for c in sorted(cs)[:7])
    for block, pivot in ((knn.BLOCK_ROWS, knn.PIVOT_ROWS), (7, 4)):
        found = knn.knn_candidates(*frames(spark, X, ids, y, Q, asked), "id", "v", "y", k=7, block_rows=block, pivot_rows=pivot)
        assert sorted((r[0] is None, r[0] or 0, r[2], r[1] is None, r[1] or 0, r[3]) for r in found.collect()) == want, block


def _moved(plan):
    """Records written by all exchanges of an executed plan."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _moved(plan.executedPlan())
    if "QueryStage" in name:
        return _moved(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(_moved(plan.children().apply(i)) for i in range(plan.children().size()))


def test_knn_moves_queries_once_per_slab(spark):
    rng = np.random.default_rng(5)
    X, Q = rng.normal(size=(600, 16)), rng.normal(size=(200, 16))
    train, test = frames(spark, X.tolist(), range(600), [float(i) for i in range(600)], Q.tolist(), range(200))
    found = knn.knn_candidates(train, test, "id", "v", "y", k=7, pivot_rows=4)  # 150 cells, and a query reaches most of them
    d = ((Q[:, None, :] - X[None, :, :]) ** 2).sum(2)
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted((q, int(i)) for q in range(200) for i in np.argsort(d[q], kind="stable")[:7])
    assert _moved(found._jdf.queryExecution().executedPlan()) < 10_000  # 30,000 pairs of query and cell


def test_knn_hands_on_no_batch_that_grows_with_the_cells(spark, monkeypatch):
    """A worker's batch of vectors holds one block of (query, slab) visits, not its queries times the cells they visit."""
    rng = np.random.default_rng(6)
    X, Q = rng.normal(size=(600, 16)), rng.normal(size=(200, 16))
    train, test = frames(spark, X.tolist(), range(600), [float(i) for i in range(600)], Q.tolist(), range(200))
    frame = type(train)
    plain = frame.mapInArrow

    def watched(self, func, schema, *args, **kwargs):
        def run(batches):
            most = 64

            def seen():
                nonlocal most
                for b in batches:
                    most = max(most, b.num_rows)
                    yield b

            for out in func(seen()):
                assert out.num_rows <= most or "vec" not in out.schema.names, f"{out.num_rows} vectors at once, of {most}"
                yield out

        return plain(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    found = knn.knn_candidates(train.coalesce(1), test.coalesce(1), "id", "v", "y", k=7, block_rows=64, pivot_rows=4)  # 150 cells
    d = ((Q[:, None, :] - X[None, :, :]) ** 2).sum(2)
    assert sorted((r[0], r[1]) for r in found.collect()) == sorted((q, int(i)) for q in range(200) for i in np.argsort(d[q], kind="stable")[:7])

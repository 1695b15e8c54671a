"""Top k: queries walk the lists together, blocks below the k-th best scores are passed by, results as by brute force."""

import numpy as np
import pytest

from matfold.llm import topk


def brute(matrix, ids, queries, query_ids, k, least=None):
    out = []
    for q, w in enumerate(queries.astype(object)):
        found = sorted((-int(s), int(i)) for s, i in zip(matrix.astype(object) @ w, ids, strict=True) if i != query_ids[q] and (least is None or s >= least[q]))
        out += [(q, i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("size", [2, 300, 40_000, 1 << 29])  # scores as 32-bit floats, doubles and 64-bit integers; 2: many ties
@pytest.mark.parametrize("n", [1, 3, 100, 700])
def test_threshold_top_equals_brute_force(size, n):
    rng = np.random.default_rng(n)
    matrix, queries = rng.integers(-size, size, (n, 6)), rng.integers(-size, size, (40, 6))
    queries[:5, 1:], queries[5:8] = 0, 0
    ids, own = np.sort(rng.integers(-n, n, n)), rng.integers(-n, n, 40)
    *found, scored = topk.threshold_top(matrix, ids, queries, own, 5)
    assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == brute(matrix, ids, queries, own, 5) and scored <= 40 * n
    least = np.array([np.median(matrix @ w) for w in queries]).astype(np.int64)
    *found, _ = topk.threshold_top(matrix, ids, queries, own, 5, least)
    assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == brute(matrix, ids, queries, own, 5, least)


def test_work_is_not_done_query_by_query(monkeypatch):
    rng = np.random.default_rng(1)
    matrix, queries = rng.integers(-200, 200, (500, 16)), rng.integers(-200, 200, (1000, 16))
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorts.append(1), lexsort(keys))[1])
    topk.threshold_top(matrix, np.arange(500), queries, np.arange(1000), 5)
    assert 0 < len(sorts) < 100  # once per query and step before


def test_a_block_below_the_best_of_others_is_not_scored():
    rng = np.random.default_rng(2)
    low, queries, ids = rng.integers(0, 10, (500, 4)), rng.integers(1, 10, (30, 4)), np.arange(500)
    best = topk.threshold_top(low + 100, ids, queries, np.full(30, -1), 5)
    least = np.full(30, topk.NONE)
    topk._raise(least, best[0], best[2], 5)
    assert best[3] and topk.threshold_top(low, ids, queries, np.full(30, -1), 5, least)[3] == 0


def test_many_blocks_and_stripes(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(3)
    vec = [(int(i), [float(x) for x in rng.integers(-3, 4, 3) / 10]) for i in rng.integers(-150, 150, 400)] + [(200, [1e4, 0.0, 0.0])]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<float>")
    fine = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in vec]
    want = []
    for i, w in fine:
        if i % 10 == 0:
            want += [(i, c, -s) for s, c in sorted((-int(w @ v), c) for c, v in fine if c != i)[:5]]
    one = {i for i, _ in fine if sum(i == j for j, _ in fine) == 1}  # rows that repeat a query's id share its ranks
    got = topk.exact_top_k(df, df.where("vec_id % 10 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id in one) == \
        sorted((i, k % 5 + 1, c, s) for k, (i, c, s) in enumerate(w for w in want if w[0] in one))
    assert {r.query_id for r in got} == {i for i, _ in fine if i % 10 == 0}

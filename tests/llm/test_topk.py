import numpy as np
import pytest

from factloom.llm import topk


def brute(q, q_ids, x, x_ids, k):
    out = []
    for a, v in zip(q_ids, q):
        s = sorted((-sum(int(c) * int(d) for c, d in zip(v, w)), int(b)) for b, w in zip(x_ids, x) if a != b)[:k]
        out += [(int(a), b, -m) for m, b in s]
    return out


@pytest.mark.parametrize("high", [3, 1000, 10**8])
@pytest.mark.parametrize("n", [1, 7, 300])
def test_block(n, high):
    rng = np.random.default_rng(n)
    x = rng.integers(-high, high + 1, (n, 6))
    x[n // 2 :] = x[: n - n // 2]  # ties
    ids = np.arange(n) * 5
    q = x[:10]
    i, j, s = topk.block_top(q, ids[:10], x, ids, 4)
    assert [(int(ids[a]), int(ids[b]), int(c)) for a, b, c in zip(i, j, s)] == brute(q, ids[:10], x, ids, 4)


def test_pruning_happens():
    rng = np.random.default_rng(0)
    x = rng.integers(-9, 10, (4000, 3))
    x[:12] = 1000
    i, j, _ = topk.block_top(np.array([[5, 5, 5]]), np.array([-1]), x, np.arange(4000), 10)
    assert j.tolist() == list(range(10))


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-50, 51, (200, 5)), rng.integers(-9, 10, (30, 5))
    lists = topk.Lists(x)
    exact = q @ x.T
    for step in range(len(topk.DEPTHS)):
        t_high, t_low, b_low, b_high = lists.at(step)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = up @ t_low.T + down @ b_high.T, up @ t_high.T + down @ b_low.T
        assert (low <= exact).all() and (exact <= high).all()
    assert (low == exact).all() and (high == exact).all()


def test_blocks_before_prune_and_the_share_is_counted():
    """Random directions are the hardest input; most pairs still end by their bounds before their lists do."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6000, 64))
    x = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    ids, figures = np.arange(6000), {}
    blocks = [(x[a : a + 1000], ids[a : a + 1000]) for a in range(0, 6000, 1000)]
    best = topk.scan(x[:70], ids[:70], iter(blocks), 10, figures)
    got = [(i, int(b), int(s)) for i in range(70) for b, s in zip(best.ids[i], best.scores[i])]
    exact = x[:70] @ x.T
    exact[np.arange(70), np.arange(70)] = -(1 << 40)
    want = [(i, int(j), int(exact[i, j])) for i in range(70) for j in np.lexsort((ids, -exact[i]))[:10]]
    assert got == want
    assert figures["pruned"] / figures["pairs"] > 0.95 and figures["read"] / figures["entries"] < 0.95


def test_table(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).tolist(), 7) for i in range(120)]
    data += [(200, None, 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [1.0, float("nan"), 0.0, 0.0], 1), (500, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (600, [], 1), (7, data[7][1], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int).tolist() + [0] * (4 - len(v))) for i, v, _ in data if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for blocks in ({}, {"query_bytes": 40, "candidate_block": 20}):
        got = topk.top_k(df, df.filter("vec_id % 100 = 0"), 10, **blocks).collect()
        want = []
        for a in (0, 100, 600):
            v = dict(ok)[a]
            best = sorted((-sum(x * y for x, y in zip(v, w)), b) for b, w in ok if b != a)[:10]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
        assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.limit(1), df.limit(1)).count() == 0


def test_scores_beyond_a_long():
    x = np.array([[2**62, 2**62], [-(2**62), 2**61], [5, 5]])
    _, j, s = topk.block_top(x[:1], np.array([-1]), x, np.arange(3), 3)
    assert j.tolist() == [0, 2, 1] and s.tolist() == [2**63 - 1, 10 * 2**62 if 10 * 2**62 < 2**63 else 2**63 - 1, -(2**63)]

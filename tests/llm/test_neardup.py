import numpy as np
import pytest

from pagewright.llm import neardup

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(seed, n, labels, dim=24, spread=0.05):
    """Groups of near vectors, two to many each, and vectors of their own."""
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < n:
        size, label = int(rng.choice([1, 1, 2, 5, 40, 150])), int(rng.integers(labels))
        c = rng.standard_normal(dim)
        for _ in range(size):
            rows.append((len(rows), (c + spread * np.linalg.norm(c) / dim**0.5 * rng.standard_normal(dim) * rng.choice([0, 1, 4])).astype("float32").tolist(), label))
    return rows


def brute(rows):
    x = np.array([v for _, v, _ in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([k for *_, k in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))
        if (new == root).all():
            return near.sum(axis=1), root
        root = new


@pytest.mark.parametrize("shards", ["broadcast", "cogroup"])
def test_links_of_many_shards_and_blocks(spark, monkeypatch, shards):
    monkeypatch.setattr(neardup, "BLOCK", 300)
    monkeypatch.setattr(neardup, "QUERIES", 400)
    if shards == "cogroup":
        monkeypatch.setattr(neardup, "CENTRE_BYTES", 0)
        monkeypatch.setattr(neardup, "PART", 500)
    rows = clustered(5, 3500, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    n, root = brute(rows)
    have = np.array([got[i].n_links for i in range(len(rows))])
    assert (have <= n).all() and have.sum() >= 0.97 * n.sum()
    same = [(got[i].component_id, got[i].kept) == (root[i], root[i] == i) for i in range(len(rows))]
    assert np.mean(same) > 0.97
    recall, ends = neardup.audit(df, neardup.near_duplicates(df), every=5, block=200)
    assert recall > 0.95 and ends == n[::5].sum()


def test_rows_of_every_kind(spark):
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, a, 1), (None, a, 1), (2, [2 * x for x in a], 1), (3, a, 2), (4, b, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [float("inf"), 0.0, 0.0], 1), (8, [1.0, None, 0.2], 1), (9, [1.0, 0.0], 1), (None, b, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", n_links string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got[:2] == [(0, 0, None, True), (0, 3, 1, False)]
    assert got[2:] == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9))]
    assert neardup.near_duplicates(df.limit(0)).count() == 0

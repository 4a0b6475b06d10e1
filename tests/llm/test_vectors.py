import numpy as np
import pytest

from fenloom.llm import vectors

KIND = "vec_id long, embedding array<float>, label int, rid long, links string, row int"


def _want(rows, cosine=0.98):
    unit = {}
    for i, (_, v, label, *_) in enumerate(rows):
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            a = a.astype(np.float32).astype(float)
            unit[i] = a / np.linalg.norm(a)
    links, comp = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                comp[max(find(i), find(j))] = min(find(i), find(j))
    small = {}
    for i in range(len(rows)):
        small.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(small[find(i)])) for i in range(len(rows)))


def _rows(dim, n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 1, 4, 25])):
            near = base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.15, 0.2]) * np.linalg.norm(base) / np.sqrt(dim)
            out.append((near * rng.choice([1.0, 3.0])).tolist())
    order = rng.permutation(len(out))
    return [(int(i), out[o], int(o % 2) if n > 3 else 0, 1, "x", 2) for i, o in enumerate(order)]


@pytest.mark.parametrize("dim, block", [(64, 2048), (64, 8), (20, 16), (3, 2048)])
def test_against_all_pairs(spark, dim, block):
    rows = _rows(dim, 40, dim)
    got = vectors.near_vectors(spark.createDataFrame(rows, KIND).repartition(3), block=block).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == _want(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


def test_a_hot_bucket_is_cut_into_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + 0.02 * rng.normal(size=16)).tolist(), 1, 1, "x", 2) for i in range(120)]
    got = vectors.near_vectors(spark.createDataFrame(rows, KIND), block=16).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == _want(rows)


def test_odd_vectors(spark):
    one, nan = [1.0] * 8, float("nan")
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0] * 8, 1), (7, [nan] + one[1:], 1),
            (8, [None] + one[1:], 1), (9, [], 1), (10, [2.0] * 8, 1), (11, [1e30] * 8, 1), (12, [float("inf")] + one[1:], 1),
            (13, [1.0] * 4, 1), (14, [-1.0] * 8, 1), (15, [5.0], 3), (16, [7.0], 3), (17, [-7.0], 3)]
    rows = [(*r, 1, "x", 2) for r in rows]
    got = vectors.near_vectors(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == _want(rows)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    a, b = (vectors.bucket_codes(v, 6, 2, 3) for v in (x, y))
    assert ((a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))).mean() > 0.999


@pytest.mark.parametrize("functions, tables", [(3, 8), (4, 10)])
def test_recall_at_the_threshold_of_large_labels(functions, tables):
    assert _recall(functions, tables, 3000) > 0.9


def _recall(functions, tables, n):
    """Share of pairs at cosine 0.98 in 64 dimensions that share a bucket."""
    rng = np.random.default_rng(0)
    x, z = vectors.unit_rows(rng.normal(size=(n, 64))), rng.normal(size=(n, 64))
    z = vectors.unit_rows(z - (z * x).sum(axis=1, keepdims=True) * x)
    a, b = (vectors.bucket_codes(v, tables, functions, 3) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * z))
    return (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean()

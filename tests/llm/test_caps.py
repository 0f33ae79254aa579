import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from marlbrook.llm import caps, queries


def brute(rows, least=0.95):
    fine = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()  # or the norm overflows
            fine[n] = x / np.linalg.norm(x)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in fine:
        for b in fine:
            if a != b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= least:
                links[a] += 1
                parent[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if n in fine:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted(((i, links[n], low[find(n)] if n in fine else i, i == (low[find(n)] if n in fine else i)) for n, (i, _) in enumerate(rows)), key=repr)


def planted(seed=0, n=150, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = [rng.standard_normal(dim) for _ in range(n)]
    for c in centres:
        for _ in range(6):
            x.append(c + rng.uniform(0.02, 0.3) * rng.standard_normal(dim))
    x += [x[0], x[0], 3.0 * x[1]]
    return [(i, v.tolist()) for i, v in enumerate(x)]


ODD = [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [float("inf")] + [1.0] * 63), (906, [1.0, 2.0]), (907, [1.0, 2.001]), (908, [-0.0, 5.0]), (909, [0.0, 5.0]), (910, [1e300] * 64), (911, [1e-300] * 64)]
KIND = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("block", [1024, 3])
def test_planted_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)  # 3: full filters are verified in pairs of blocks
    rows = planted() + ODD + [(5, planted()[5][1])]
    got = caps.near_vectors(spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("id", "x", "filters", "label", "fine", "h1")})).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    codes = caps.n_codes(20_000)
    missed = sum(not np.isin(x, y).any() for x, y in zip(caps.decode(a, codes), caps.decode(c, codes)))
    assert missed <= 4


@pytest.mark.parametrize("codes, pairs", [(1_415, 3000), (10_000, 400), (32_768, 250)])
def test_misses_do_not_grow_with_the_codebook(codes, pairs):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    missed = 1.0
    for r in range(caps.n_rotations(codes)):
        f = caps.Filters(64, codes, r)
        missed *= np.mean([not np.isin(x, y).any() for x, y in zip(f.decode(a), f.decode(c))])
    assert missed < 1e-4  # the product of the codes' own shares; the pairs that all miss are too few to count


def test_empty_and_query(spark):
    assert caps.near_vectors(spark.createDataFrame([], KIND)).count() == 0
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op9_spherical_caps"](spark, SF_SMALL).collect()), key=repr) == brute(rows)

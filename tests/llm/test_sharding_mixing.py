import random
import zlib
from collections import defaultdict

import pytest
from conftest import SF_SMALL

from marlbrook.llm import mixing, queries, sharding


def fewest(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


@pytest.mark.parametrize("seed, n, shards, places", [(1, 400, 7, 8), (2, 3000, 40, 16), (3, 5, 40, 8), (4, 1000, 3, 1 << 16)])
def test_smallest_capacity(spark, monkeypatch, seed, n, shards, places):
    monkeypatch.setattr(sharding, "PLACES", places)  # few places: several requests
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 17, 300, 4000]) for _ in range(n)] + [20_000] * (seed == 2)
    upto, rows = 0, []
    for s in sizes:
        upto += s
        rows.append((upto, s))
    capacity, ends = sharding.minimax_cuts(spark.createDataFrame(rows, "upto long, size long").cache(), shards)
    want = next(c for c in range(max(sizes), sum(sizes) + 1) if fewest(sizes, c) <= shards)
    assert capacity == want and ends[-1] == upto and set(ends) <= {u for u, _ in rows}
    assert max(b - a for a, b in zip([0, *ends], ends)) <= capacity


def check_shards(rows, source, shards):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((k, len((t or "").encode()) + 16, zlib.crc32(t.encode()) if t is not None else None) for k, t in source)
    slots, of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in of.values())


def test_shards(docs, docs_rows, wide_docs, empty_docs):
    for table in (docs, wide_docs):
        check_shards(sharding.shard_by_bytes(table, 6).collect(), [r[:2] for r in docs_rows], 6)
    assert sharding.shard_by_bytes(empty_docs, 6).count() == 0


def test_sharding_query(spark):
    """The query's largest shard is the least that a brute-force search over the ordered groups finds, and all shards are used evenly."""
    import hashlib

    import xxhash

    source = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = queries.QUERIES["op3_sharding"](spark, SF_SMALL).collect()
    check_shards(rows, source, 40)
    groups = defaultdict(int)
    for _, t in source:
        groups[b"" if t is None else hashlib.sha256(t.encode()).digest()] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda k: ((xxhash.xxh64_intdigest(k, 42) ^ 1 << 63), k))
    sizes = [groups[k] for k in order]
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fewest(sizes, mid) <= 40 else (mid + 1, high)
    held = defaultdict(int)
    for r in rows:
        held[r.shard] += r.size
    assert max(held.values()) == low and len(held) == min(40, len(sizes))
    mean = sum(sizes) / 40
    assert sorted(held.values())[1] >= mean - max(sizes)


def test_all_shards_are_used_beside_a_very_large_group(spark):
    docs = spark.createDataFrame([(i, "x" * 3000) for i in range(150)] + [(1000 + i, f"text {i} " * 10) for i in range(3000)], "doc_id long, text string")
    held = defaultdict(int)
    for r in sharding.shard_by_bytes(docs, 40).collect():
        held[r.shard] += r.size
    big = 150 * 3016
    rest = sorted(held.values())[:-1]
    assert len(held) == 40 and max(held.values()) == big and rest[1] > 0.9 * sum(rest) / 39


def test_pivot_keeps_the_sum_and_the_expectations():
    sizes, probs = [3, 50, 7, 7, 120, 1, 9, 33], [0.2, 0.5, 0.9, 0.31, 0.25, 0.5, 0.77, 0.64]
    total, seen = sum(s * p for s, p in zip(sizes, probs)), [0.0] * len(sizes)
    for k in range(4000):
        p = list(probs)
        mixing._pivot(sizes, p, mixing._seeded(k, "t"))
        assert sum(s * x for s, x in zip(sizes, p)) == pytest.approx(total)
        assert sum(1e-9 < x < 1 - 1e-9 for x in p) <= 1
        seen = [a + x / 4000 for a, x in zip(seen, p)]
    assert seen == pytest.approx(probs, abs=0.04)


def brute_targets(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in order if s not in full)
        if not free:
            return {s: cap * sizes[s] for s in order}
        level = (total - sum(cap * sizes[s] for s in full)) / free
        new = {s for s in order if w[s] * level >= cap * sizes[s]}
        if new == full:
            return {s: min(w[s] * level, cap * sizes[s]) for s in order}
        full = new


@pytest.mark.parametrize("leaf", [2048, 5])
def test_mix(spark, docs, docs_rows, empty_docs, wide_docs, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF_ROWS", leaf)  # small leaves: a deep tree
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(docs_rows) and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(wide_docs.repartition(3)).collect()))
    source = {r[0]: r[3] for r in docs_rows}
    sizes, taken, want = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        want[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert want == pytest.approx(brute_targets(sizes))
    assert all(abs(taken[s] - want[s]) <= 60 or sizes[s] > 30_000 for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 30_000 for s in sizes)
    assert mixing.mix_report(empty_docs).count() == 0


def test_tree_keeps_the_expectations(spark, monkeypatch):
    """Over many seeds each row's mean number of copies is target / source size, through all levels of the tree to the root."""
    import pandas as pd

    rng = random.Random(3)
    n, seeds, leaf, fan = 40, 500, 6, 3
    base = pd.DataFrame({"source": "a", "key": range(n), "size": [rng.choice([1, 3, 20, 77, 400]) for _ in range(n)], "prob": 0.37, "node": [i % (n // leaf) for i in range(n)]})
    total, seen, off = 0.37 * base["size"].sum(), [0.0] * n, 0.0
    for seed in range(seeds):
        cur, done, leaves, level = base, [], n // leaf, 0
        while True:
            out = pd.concat([mixing._node(seed, level, leaves <= 1)(g) for _, g in cur.groupby("node")])
            live = (out["prob"] > 1e-9) & (out["prob"] < 1 - 1e-9)
            done.append(out[~live])
            if leaves <= 1:
                break
            assert live.sum() <= leaves
            cur, leaves, level = out[live].assign(node=out[live]["node"] // fan), -(-leaves // fan), level + 1
        got = pd.concat(done).set_index("key")
        assert len(got) == n and set(got["prob"]) <= {0.0, 1.0}
        off = max(off, abs(float((got["prob"] * got["size"]).sum()) - total))
        seen = [a + got["prob"][i] / seeds for i, a in enumerate(seen)]
    assert off <= 400 and seen == pytest.approx([0.37] * n, abs=0.1) and sum(seen) / n == pytest.approx(0.37, abs=0.02)


def test_mix_gives_rows(docs, wide_docs, docs_rows):
    out = mixing.mix(wide_docs)
    assert out.columns == wide_docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    goal = {r.source: r.target for r in mixing.mix_copies(docs).select("source", "target").distinct().collect()}
    assert all(abs(got[s] - goal[s]) <= 30_000 for s in goal)


def test_mix_keeps_rows_that_differ_in_another_column(spark):
    rows = [(1, "a b c", "s", "first"), (1, "a b c", "s", "second"), (2, "x y", "t", None), (2, "x y", "t", None), (3, "u v w", None, "z")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    got = [tuple(r) for r in mixing.mix(docs).collect()]
    copies = {r.source: r for r in mixing.mix_copies(docs).collect()}
    counts = {k: got.count(k) for k in set(rows)}
    for s in copies:
        q = copies[s].target / copies[s].source_size
        for k in {r for r in rows if r[2] == s}:
            assert abs(counts[k] - q * rows.count(k)) <= 1 and counts[k] > 0
    assert sorted(got, key=str) == sorted((tuple(r) for r in mixing.mix(docs.repartition(7)).collect()), key=str)


def test_a_row_that_repeats_very_often_is_one_row_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 8)
    rows = [(7, "hot row here", "a")] * 500 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.mix_copies(docs).collect()
    assert len(out) == 800
    hot = [r.copies for r in out if r.doc_id == 7 and r.size == 3]
    q = next(r.target / r.source_size for r in out if r.source == "a")
    assert abs(sum(hot) - 500 * q) <= 2 and max(hot) - min(hot) <= 1


def test_mixing_query(spark):
    q = queries.QUERIES["op6_mixing"]
    rows = q(spark, SF_SMALL).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    taken, want = defaultdict(int), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        want[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - want[s]) < 0.1 * want[s] + 50 for s in want) and sorted(map(tuple, rows)) == sorted(map(tuple, q(spark, SF_SMALL).collect()))

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SF_SMALL
from pyspark.sql import functions as F

from marlbrook.llm import queries, simhash_trie
from marlbrook.llm.simhash_trie import Trie, fingerprint


def brute(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, budget=4):
    u = np.array(sorted(set(values)), np.uint64)
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return {int(x): find(i) for i, x in enumerate(u)}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one two THREE", "a b c d", "É É a b c D e", "x " * 500, "a\x0bb\x1cc d e f"])
def test_fingerprint(text):
    assert fingerprint(text or "") == brute(text)


@pytest.mark.parametrize("n, flips", [(300, 9), (60, 3), (1, 0), (400, 30)])
def test_trie(n, flips):
    rng = random.Random(n)
    centres = [rng.getrandbits(64) for _ in range(5)]
    values = []
    for _ in range(n):
        v = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    u = np.array(sorted(set(values)), np.uint64)
    want = components(values)
    got = Trie(u, 4).join()
    assert {int(x): r for x, r in zip(u, got)} == want


@pytest.mark.parametrize("rows", [4096, 3])
def test_components_whatever_the_groups(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash_trie, "TRIE_ROWS", rows)  # 3: nearly all groups are dealt out again
    rng = random.Random(rows)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash_trie.trie_links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = components(values)
    assert len({find(v) for v in signed}) == len(set(want.values()))
    groups = {}
    for v in signed:
        groups.setdefault(find(v), set()).add(want[v & (1 << 64) - 1])
    assert all(len(g) == 1 for g in groups.values())


def expected(rows):
    prints = {(k, t): brute(t) for k, t in rows}
    comp = components(prints.values())
    least = {}
    for (k, _), v in prints.items():
        least[comp[v]] = min(least.get(comp[v], k), k)
    return sorted((k, f"{prints[k, t]:016x}", least[comp[prints[k, t]]]) for k, t in rows)


def test_odd_tables(docs, wide_docs, docs_rows, empty_docs):
    want = expected([r[:2] for r in docs_rows])
    for table in (docs, wide_docs):
        assert sorted(map(tuple, simhash_trie.simhash_components(table).collect())) == want
    assert simhash_trie.simhash_components(empty_docs).count() == 0
    kept = simhash_trie.keep_first(wide_docs)
    assert kept.columns == wide_docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})


def brute_jaccard(a, b):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_texts(spark, docs, wide_docs, docs_rows, empty_docs):
    """No link below 0.8, copies always, and most edited copies of 0.8 or more; clean rows stay."""
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(60, 300))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        for rate in (0.003, 0.01, 0.02):
            texts.append(" ".join(f"z{rng.randrange(4000)}" if rng.random() < rate else w for w in t.split()))
    texts += [base[0].upper(), base[1].replace(" ", "  "), base[2]] * 3
    rows = list(enumerate(texts))
    comp = {r.doc_id: r.component_id for r in simhash_trie.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    links = [(i, j) for i, a in rows for j, b in rows[:i] if brute_jaccard(a, b) >= 0.8]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    assert all(find(c) == find(i) for i, c in comp.items())  # never beyond the true components
    assert sum(comp[i] == comp[j] for i, j in links) >= 0.9 * len(links)
    assert all(comp[i] == comp[j] for i, j in links if texts[i].lower().split() == texts[j].lower().split())


def odd_pairs():
    """Pairs just above and just below 0.8, of long and of short texts, beside lines that very many texts share."""
    rng, texts = random.Random(11), ["", " ", "\n \t", "one", "one two", "ONE  two"]
    line = " ".join(f"common{i}" for i in range(14))
    for i in range(160):
        n = rng.choice([8, 9, 12, 30, 60, 120, 300])
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        edited = list(words)
        for at in rng.sample(range(n), max(1, n // 45)):
            edited[at] = f"z{rng.randrange(3000)}"
        texts += [" ".join(words), " ".join(edited), " ".join(words[: -max(1, n // 6)]), " ".join(words + words[:2])]
        if i % 4 == 0:
            texts += [line + " " + " ".join(words[:20]), line + " " + " ".join(edited[:20])]
    return texts


@pytest.mark.parametrize("common, small", [(6, 24), (2, 2), (10**9, 24)])
def test_no_similar_pair_is_left_out(spark, monkeypatch, common, small):
    """Components are those of all pairs of 0.8 or more, whatever the order of shingles and the size of groups."""
    monkeypatch.setattr(simhash_trie, "COMMON", common)
    monkeypatch.setattr(simhash_trie, "SMALL", small)
    texts = odd_pairs()
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [set(simhash_trie.shingles(t, 5).tolist()) for t in texts]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if not x and not y or x & y and len(x & y) / len(x | y) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, simhash_trie.similar_components(rows).collect())) == {i: find(i) for i in range(len(texts))}


def test_unrelated_long_texts_are_no_pairs(spark, monkeypatch):
    """Long texts that share some lines only are not handed on to be compared; those of 0.8 or more all are, whatever their lengths."""
    monkeypatch.setattr(simhash_trie, "COMMON", 10**9)  # shared lines are no later than others
    rng = random.Random(3)
    lines = [" ".join(f"common{rng.randrange(500)}" for _ in range(9)) for _ in range(40)]

    def long_text(n):
        words = [f"w{rng.randrange(100_000)}" for _ in range(n)]
        for line in lines:
            words.insert(rng.randrange(len(words)), line)
        return " ".join(words)

    texts = [long_text(n) for n in (2100, 3300, 4100, 5100, 6000, 6600, 7500, 9000, 14_000, 20_000)]
    texts += [" ".join(t.split()[: len(t.split()) * 7 // 8]) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").selectExpr("node", "node AS component", "text", "xxhash64(text) AS h1", "xxhash64(1, text) AS h2")
    nodes = rows.select("node", "h1", "component", simhash_trie.simhashes(F.col("text"), 5, 1)["outline"].alias("outline"))
    near = {(a, b) for b in range(len(texts)) for a in range(b) if brute_jaccard(texts[a], texts[b]) >= 0.8}
    assert len(near) == 10
    assert {(r.a, r.b) for r in simhash_trie.pairs_left(rows, nodes, 0.8, 5).collect()} == near


@pytest.mark.parametrize("most", [512, 4])
def test_wide_pairs_whatever_the_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_trie, "WIDE_ROWS", most)  # 4: groups come back and are dealt out again
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash_trie.wide_pairs(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()]
    assert all(0 < (a ^ b).bit_count() <= simhash_trie.WIDE for a, b in links)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert len({find(v) for v in values}) == 20


def test_similar_odd_tables(wide_docs, docs_rows, empty_docs, monkeypatch):
    kept = simhash_trie.keep_similar(wide_docs)
    text = {r[0]: r[1] or "" for r in docs_rows}
    first = {}
    for k in sorted(text):
        first.setdefault(tuple(text[k].split()), k)
    assert kept.columns == wide_docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    assert simhash_trie.keep_similar(empty_docs).count() == 0


@pytest.mark.parametrize("a, b", [("", " "), ("a b c", "A  b c"), ("a b c d e f", "a b c d e g"), ("a b", "a c"), ("x " * 50, "x " * 60), ("", "a")])
def test_jaccard(a, b):
    assert simhash_trie.jaccard(a, b, 5) == pytest.approx(brute_jaccard(a, b))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op4_simhash_trie"](spark, SF_SMALL).collect())) == expected(rows)

import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL

from marlbrook.llm import queries, sp_sample
from marlbrook.llm.sp_sample import MARK, lattices, sample, sample_pieces

from .conftest import PIECE, words


@pytest.fixture(scope="module")
def lat():
    return lattices(PIECE, 1.0)


def all_ways(lat, text):
    text = " " + text
    ids = {p.replace(MARK, " "): i for i, p in enumerate(lat.pieces) if i >= 259}
    cost = {int(i): c for i, c in zip(lat.piece_at, lat.cost_at) if i >= 0}
    out = []

    def go(at, seg):
        if at == len(text):
            out.append(tuple(seg))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ids:
                go(end, [*seg, ids[text[at:end]]])

    go(0, [])
    w = np.array([sum(cost[i] for i in s) for s in out])
    return out, np.exp(w - w.max()) / np.exp(w - w.max()).sum()


@pytest.mark.parametrize("text", ["ab", "the cat", "an a", "to go"])
def test_law_of_two_samples(lat, text):
    ways, p = all_ways(lat, text)
    law, n, pairs = dict(zip(ways, p)), 12_000, Counter()
    for own in sample(lat, [text] * n, [random.Random(i).getrandbits(64) for i in range(n)], 2):
        a, b = (tuple(lat.ids(e).tolist()) for e, *_ in own)
        assert a != b and own[0][2] >= own[1][2] and np.exp(own[0][1]) == pytest.approx(law[a], rel=1e-3)
        pairs[a, b] += 1
    for a in ways:
        for b in ways:
            if a != b:
                assert pairs[a, b] / n == pytest.approx(law[a] * law[b] / (1 - law[a]), abs=0.015)


def test_all_ways_come_out_in_the_end(lat):
    ways, _ = all_ways(lat, "the")
    own = sample(lat, ["the"], [3], len(ways) + 5)[0]
    assert {tuple(lat.ids(e).tolist()) for e, *_ in own} == set(ways) and all(s == 0.0 for *_, s in own)


@pytest.mark.parametrize("text", ["", "\n", " ", "   x  ", "▁ mark", "é日本😀\x00\t", "x" * 3000 + " y" * 3000, "a,b.c!d", "\ud800"])
def test_round_trip(lat, text):
    for own in sample(lat, [text, text], [1, 2], 3):
        assert all(lat.decode(lat.ids(e).tolist()) == text for e, *_ in own)
        assert len({tuple(e.tolist()) for e, *_ in own}) == len(own)


def test_units_dropped_and_learnt_again(monkeypatch):
    small, big = sp_sample.Lattices(PIECE), sp_sample.Lattices(PIECE)
    rng = random.Random(8)
    texts = [words(rng, 40) for _ in range(30)]
    whole = [sample(big, [t], [i], 2)[0] for i, t in enumerate(texts)]
    monkeypatch.setattr(sp_sample, "HELD_UNITS", 60)
    for i, t in enumerate(texts):
        for (a, *x), (b, *y) in zip(sample(small, [t], [i], 2)[0], whole[i]):
            assert small.ids(a).tolist() == big.ids(b).tolist() and x == pytest.approx(y, rel=1e-5, abs=1e-5)


def test_unspaced_texts_leave_nothing_behind():
    lat, rng, held = sp_sample.Lattices(PIECE), np.random.default_rng(3), []
    for _ in range(4):
        text = "".join(map(chr, rng.integers(0x4E00, 0x9F00, 60_000)))
        own = sample(lat, [text], [1], 2)[0]
        assert all(lat.decode(lat.ids(e).tolist()) == text for e, *_ in own)
        sample(lat, ["a b"], [1], 2)
        held.append(len(lat.goal))
    assert held == [held[0]] * 4 and held[0] < 20


def test_held_edges_are_bounded(monkeypatch):
    monkeypatch.setattr(sp_sample, "HELD_EDGES", 5000)
    lat, rng = sp_sample.Lattices(PIECE), random.Random(4)
    for i in range(20):
        text = words(rng, 300)
        assert all(lat.decode(lat.ids(e).tolist()) == text for e, *_ in sample(lat, [text], [i], 2)[0])
        assert lat.kept[2] < 5000 + 300 * 7 * 3


def test_memory_of_a_worker_that_meets_new_units():
    lat, rng = sp_sample.Lattices(PIECE), np.random.default_rng(5)
    texts = [" ".join(map(bytes.decode, rng.integers(97, 123, (50_000, 9), np.uint8).view("S9").ravel().tolist())) for _ in range(6)]
    tracemalloc.start()
    for text in texts:
        lat.rows([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lat.row) > 50_000 and peak < 160e6


def test_no_piece_lies_across_the_parts_of_a_long_unit(lat, monkeypatch):
    """So all ways go through the ends of parts, and the lattice's law is the product of theirs."""
    rng = np.random.default_rng(6)
    unit = " " + "".join(map(chr, rng.integers(0x4E00, 0x9F00, 300))) + "thequickbrown,7fox"
    monkeypatch.setattr(sp_sample, "PART_CHARS", 50)
    parts = list(lat.parts(unit))
    assert "".join(parts) == unit and len(parts) > 3
    ends = set(np.cumsum([len(p) for p in parts])[:-1].tolist())
    assert not any(unit[i:j] in lat.known for e in ends for i in range(max(0, e - 20), e) for j in range(e + 1, e + 20))


def test_odd_tables(docs, wide_docs, docs_rows, empty_docs):
    rows = sample_pieces(docs, PIECE, k=2).collect()
    text = {r[0]: r[1] or "" for r in docs_rows}
    again = sample_pieces(wide_docs.repartition(7), PIECE, k=2).collect()
    assert sorted(map(tuple, (tuple(r)[:8] for r in rows))) == sorted(map(tuple, (tuple(r)[:8] for r in again)))
    for r in rows:
        assert r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.n_pieces == len(r.ids) and r.log_inclusion <= 0
    assert {r.doc_id for r in rows if r["rank"] == 1} == set(text)
    assert sample_pieces(empty_docs, PIECE).count() == 0


def test_query(spark):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_sp_sample"](spark, SF_SMALL).collect()
    assert Counter(r["rank"] for r in rows)[1] == len(source)
    assert all(r.text_crc32 == zlib.crc32(source[r.doc_id].encode()) for r in rows)

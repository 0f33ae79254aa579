"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k over the lattice.

The pieces of a model form a lattice over a text. With the log-probabilities of
the pieces each path is a segmentation with a probability, and a path's
perturbed log-probability is that plus Gumbel noise. The k paths of greatest
perturbed log-probability are k samples without replacement. They are found by
best-first (A-star) search over sets of paths: a set is "this prefix, then any
edge but these", its bound is exact because the greatest noise in a set is one
draw of a truncated Gumbel variable, and taking a set off the agenda draws its
best path and leaves the sets that branch off it.

A text is cut into units where no piece can cross, so a unit's lattice is built
once for each distinct unit a worker holds, and all units of a round of texts
step through their lattices together.
"""

from __future__ import annotations

import ctypes
import heapq
import math
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from marlbrook.llm.units import Rows

#: Distinct units whose lattice a worker holds, edges of these, and bytes of the texts of one round.
HELD_UNITS, HELD_EDGES, ROUND_BYTES = 100_000, 3_000_000, 1 << 19
#: Characters of the units whose lattices are built at once; one unit alone may have more.
LEARN_CHARS = 1 << 15
#: Characters of a unit beyond which it is split further where no piece can cross, and places that are tried for each cut.
PART_CHARS, PART_LOOK = 4096, 256
#: Decisions of a path that are looked at first for where the next path may branch off, and by how much noise can lift a bound at most.
FIRST_LOOK, MOST_NOISE = 64, 18.0
MARK = "▁"
#: Blanks and the letters after them up to a sign or a blank; or what stands between blanks; line feeds alone.
UNITS = re.compile(r" *[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[.,;:!?#$%&*|()\" \n]|$)| *[^ \n]+| +|\n")
_LETTER_SIGN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?#$%&*|()\"]|[^▁]▁")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit counters."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)


def _extended(held: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` behind it: a stretch of a buffer that has room, so that held lattices are not copied for every few new ones. What else views the buffer behind ``held`` is overwritten."""
    n, m = len(held), len(held) + len(more)
    room = held.base
    if room is None or len(room) < m:
        room = np.empty(m + m // 4, held.dtype)  # what is not written takes no memory
        room[:n] = held
    room[n:m] = more
    return room[:m]


def _moved(held: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``held[at]`` at the front of the same buffer."""
    held[: len(at)] = held[at]
    return held[: len(at)]


def _runs(units: list[str]) -> Iterator[list[str]]:
    """``units`` in runs of LEARN_CHARS characters at most, one unit at least."""
    at, held = 0, 0
    for i, u in enumerate(units):
        if held and held + len(u) > LEARN_CHARS:
            yield units[at:i]
            at, held = i, 0
        held += len(u)
    if units:
        yield units[at:]


class Lattices:
    """The pieces of a model file, and the lattices of the units met.

    A piece of merge rank r has a probability in proportion to 1 / (r + 2.7)
    (Zipf's law: the file holds ranks, no probabilities), raised to ``alpha``.
    A character that is no piece is spelt in bytes.
    """

    def __init__(self, path: str, alpha: float = 1.0):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_of = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_ids = np.array([self.byte_of[b] for b in range(256)], np.int32)
        normal = [(p.piece, i, -p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
        if any(_LETTER_SIGN.search(p) for p, _, _ in normal):
            raise ValueError("pieces of this model cross the boundaries of units")
        norm = math.log(sum(1 / (r + 2.7) for _, _, r in normal))
        self.byte_cost = alpha * (-math.log(max(r for _, _, r in normal if r < 1e8) + 2.7) - norm - 2.0)
        # a trie of the pieces: (node, character) -> node
        children: dict[tuple[int, str], int] = {}
        ids, costs = [-1], [0.0]
        for piece, i, r in normal:
            at = 0
            for c in piece.replace(MARK, " "):
                nxt = children.get((at, c))
                if nxt is None:
                    nxt = children[(at, c)] = len(ids)
                    ids.append(-1)
                    costs.append(0.0)
                at = nxt
            ids[at], costs[at] = i, alpha * (-math.log(r + 2.7) - norm)
        self.piece_at, self.cost_at = np.array(ids, np.int32), np.array(costs)
        keys = np.array([(n << 21) | ord(c) for n, c in children], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.into = np.array(list(children.values()), np.int64)[order]
        self.text_of = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b, i in self.byte_of.items():
            self.text_of[i] = bytes([b])
        self.known = {p.replace(MARK, " ") for p, _, _ in normal}
        self.longest = max(map(len, self.known))
        self.kept = 0, 0, 0  # units, nodes and edges that outlive a round
        self.row = Rows()
        self.hits = np.zeros(0, np.int64)
        self.root = np.zeros(0, np.int32)  # first node of each unit
        self.first = np.zeros(0, np.int32)  # first edge of each node; the longest piece first
        self.upto = np.zeros(0, np.float32)  # running probability inside the node; the last edge has 2
        self.logp, self.rest = np.zeros(0, np.float32), np.zeros(0, np.float32)  # of the edge, and of all others of its node
        self.goal = np.zeros(0, np.int32)  # node behind the edge, -1: the unit's end
        self.piece = np.zeros(0, np.int32)  # id, or -1 - code point

    def shrink(self) -> None:
        """Keep the units that were met most often, up to half of what may be held; in the buffers that hold them, so that no second copy stands beside."""
        units = list(self.row)
        nodes = np.append(self.root, len(self.first))
        edges = np.append(self.first, len(self.goal))
        m = edges[nodes[1:]] - edges[nodes[:-1]]
        often = np.argsort(-self.hits, kind="stable")[: HELD_UNITS // 2]
        keep = np.sort(often[np.cumsum(m[often]) <= HELD_EDGES // 2])
        n, m = np.diff(nodes)[keep], m[keep]
        new_root, new_edge = np.cumsum(n) - n, np.cumsum(m) - m
        by_node, by_edge = (self.root[keep] - new_root).astype(np.int32), (self.first[self.root[keep]] - new_edge).astype(np.int32)
        at_node = np.arange(int(n.sum()), dtype=np.int32) + np.repeat(by_node, n)
        at_edge = np.arange(int(m.sum()), dtype=np.int32) + np.repeat(by_edge, m)
        self.first = _moved(self.first, at_node)
        self.first -= np.repeat(by_edge, n)
        self.upto, self.logp, self.rest, self.goal, self.piece = (_moved(x, at_edge) for x in (self.upto, self.logp, self.rest, self.goal, self.piece))
        self.goal -= np.where(self.goal < 0, 0, np.repeat(by_node, m))
        self.root, self.hits = new_root.astype(np.int32), np.zeros(len(keep), np.int64)
        self.row = Rows(zip((units[k] for k in keep.tolist()), range(len(keep))), len(keep))

    def learn(self, units: list[str]) -> None:
        """Build the lattices of new units, all at once."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, units), np.int64, len(units))
        away = np.repeat(np.cumsum(lens), lens)  # from a place to its unit's end
        total = len(codes)
        away -= np.arange(total)
        # pieces from each place, one length after the other
        at, node, found, n = np.arange(total), np.zeros(total, np.int64), [], np.zeros(total, np.int64)
        depth = 0
        while len(at):
            depth += 1
            k = np.searchsorted(self.keys, node << 21 | codes[at + depth - 1])
            hit = self.keys[k] == (node << 21 | codes[at + depth - 1])
            at, node = at[hit], self.into[k[hit]]
            piece = self.piece_at[node]
            is_piece = piece >= 0
            start, leaf = at[is_piece], node[is_piece]
            n[start] += 1
            found.append((start, piece[is_piece], self.cost_at[leaf]))
            if depth == 1:
                spelt = np.flatnonzero(n == 0)
                n[spelt] = 1
                c = codes[spelt]
                width = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
                ids = np.where(c > 0x7F, -1 - c, self.byte_ids[np.minimum(c, 255)]).astype(np.int32)
                found.append((spelt, ids, width * self.byte_cost))
            inside = away[at] > depth
            at, node = at[inside], node[inside]
        # edges of a place stand together, the longest piece first; each unit has a slot for its end
        unit = np.repeat(np.arange(len(units)), lens)
        heads = np.cumsum(n) - n
        last = heads + n - 1
        size, fill = int(n.sum()), last.copy()
        piece, cost, stop, start = np.empty(size, np.int32), np.empty(size), np.empty(size, np.int64), np.repeat(np.arange(total), n)
        for (places, ids, costs), m in zip(found, [1, 1, *range(2, depth + 1)]):
            e = fill[places]
            fill[places] -= 1
            piece[e], cost[e], stop[e] = ids, costs, places + m
        slot = stop + unit[start]
        # log of the sum over all ways to the end, from the last places to the first
        beta = np.zeros(total + len(units))
        order = np.argsort(away.astype(np.uint16) if total and away.max() < 1 << 16 else away, kind="stable")
        width = n[order]
        tops = np.cumsum(width) - width
        edges = np.arange(size) + np.repeat(heads[order] - tops, width)
        cost_by, slot_by, place_by = cost[edges], slot[edges], order + unit[order]
        steps = np.concatenate([[0], np.flatnonzero(np.diff(away[order])) + 1, [total]]).tolist()
        for a, b in zip(steps[:-1], steps[1:]):
            lo, hi = int(tops[a]), int(tops[b]) if b < total else size
            v = cost_by[lo:hi] + beta[slot_by[lo:hi]]
            at = tops[a:b] - lo
            top = np.maximum.reduceat(v, at)
            beta[place_by[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, width[a:b])), at))
        logp = cost + beta[slot] - beta[start + unit[start]]
        p = np.exp(logp)
        run = np.cumsum(p)
        run = run - np.repeat(run[heads] - p[heads], n)
        run[last] = 2.0
        # where one edge has over half, the others are summed by themselves
        big = p > 0.5
        others = np.where(big, np.repeat(np.add.reduceat(np.where(big, 0.0, p), heads), n), 1 - p)
        with np.errstate(divide="ignore"):
            rest = np.log(others)
        ends_here = away[start] == stop - start
        # every place is a node: single characters lead everywhere
        node0, edge0 = len(self.first), len(self.goal)
        goal = np.where(ends_here, -1, stop + node0)
        self.hits = _extended(self.hits, np.zeros(len(units), np.int64))
        self.root = _extended(self.root, node0 + np.cumsum(lens) - lens)
        self.first = _extended(self.first, edge0 + heads)
        self.upto, self.logp, self.rest = _extended(self.upto, run), _extended(self.logp, logp), _extended(self.rest, rest)
        self.goal, self.piece = _extended(self.goal, goal), _extended(self.piece, piece)

    def parts(self, unit: str) -> Iterator[str]:
        """A very long unit in parts of about PART_CHARS characters, cut where no piece that it holds lies across, so that the lattice falls apart there; longer where no place is found."""
        at, p = 0, PART_CHARS
        while p < len(unit):
            till = min(len(unit), p + PART_LOOK)
            cut = next((q for q in range(p, till) if not any(unit[i:j] in self.known for i in range(q - 1, q - self.longest, -1) for j in range(q + 1, i + self.longest + 1))), None)
            if cut is None:
                p = till
                continue
            yield unit[at:cut]
            at, p = cut, cut + PART_CHARS
        yield unit[at:]

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The lattice of each unit of all texts (a blank before each), and the units of each text; lattices of long units are forgotten by the next call."""
        n, nodes, edges = self.kept
        self.root, self.hits, self.first = self.root[:n], self.hits[:n], self.first[:nodes]
        self.upto, self.logp, self.rest, self.goal, self.piece = (x[:edges] for x in (self.upto, self.logp, self.rest, self.goal, self.piece))
        if n > HELD_UNITS or edges > HELD_EDGES:
            self.shrink()
        units = [UNITS.findall(" " + t) for t in texts]
        for i, t in enumerate(texts):
            if len(t) > PART_CHARS and any(len(u) > PART_CHARS for u in units[i]):
                units[i] = [p for u in units[i] for p in self.parts(u)]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        new, long, self.row.new, self.row.long = self.row.new, self.row.long, [], []
        for run in _runs(new):
            self.learn(run)
        self.kept = len(self.root), len(self.first), len(self.goal)
        rows = np.where(rows < 0, len(self.root) - 1 - rows, rows)
        for run in _runs(long):
            self.learn(run)
        self.hits += np.bincount(rows, minlength=len(self.hits))
        return rows, counts

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a way to its unit's end from each node (-1: there already): the edges of all in order, and how many each has."""
        counts = np.zeros(len(node), np.int64)
        who = np.flatnonzero(node >= 0)
        at, step, went = node[who], 0, []
        while len(who):
            u = _uniform(key[who] + np.uint64((step + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF))
            edge = self.first[at]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            went.append((who, edge))
            counts[who] += 1
            goal = self.goal[edge]
            on = goal >= 0
            who, at = who[on], goal[on]
            step += 1
        offset = np.cumsum(counts) - counts
        edges = np.zeros(int(counts.sum()), np.int64)
        for step, (who, edge) in enumerate(went):
            edges[offset[who] + step] = edge
        return edges, counts

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Ids of a path's edges; spelt characters give the ids of their bytes."""
        piece = self.piece[edges]
        if not (piece < 0).any():
            return piece
        out = [np.array([self.byte_of[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")], np.int32) for p in piece[piece < 0].tolist()]
        cut_at = np.flatnonzero(piece < 0)
        n = np.ones(len(piece), np.int64)
        n[cut_at] = [len(x) for x in out]
        ends = np.cumsum(n)
        ids = np.repeat(piece, n)
        for i, x in zip(cut_at, out):
            ids[ends[i] - len(x) : ends[i]] = x
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text that the ids stand for: pieces joined, without the blank before the text."""
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def edges_of(self, edge: int) -> tuple[int, int]:
        """First and last edge of the node that an edge leaves."""
        node = int(self.first.searchsorted(np.int32(edge), side="right")) - 1  # of the same type, or the whole array is converted
        a = int(self.first[node])
        b = int(self.first[node + 1]) if node + 1 < len(self.first) else len(self.goal)
        return a, b


class _Text:
    """The search of one text: the paths found and the agenda of sets."""

    __slots__ = ("seed", "paths", "agenda", "units", "lo")

    def __init__(self, seed: int, units: int, lo: int):
        self.seed, self.units, self.lo = seed, units, lo
        self.paths: list[tuple[float, np.ndarray, np.ndarray]] = []  # perturbed, edges, decisions of each unit
        self.agenda: list[tuple] = []  # -bound, number, path, decision, edges left out


def _chance(seed: int, *what: int) -> float:
    """A number in (0, 1) for one event of a text's search."""
    return (xxhash.xxh64_intdigest(np.array(what, np.int64).tobytes(), seed & 0xFFFFFFFFFFFFFFFF) + 0.5) / 2.0**64


def _branches(lat: Lattices, jobs: list[tuple], look: int = FIRST_LOOK) -> None:
    """Put the sets that branch off paths on their texts' agendas.

    A job is (text, path, first decision, log-probability before it, edges left
    out at it, sets wanted at most). A set's bound is a draw of Gumbel noise
    about its log-probability, truncated at the bound of the path it leaves.
    Later decisions have ever less probability before them; a job whose first
    ``look`` decisions do not settle the wanted sets looks further.
    """
    if not jobs:
        return
    n = np.array([min(look, len(t.paths[path][1]) - d) for t, path, d, *_ in jobs])
    edges = np.concatenate([t.paths[path][1][d : d + m] for (t, path, d, *_), m in zip(jobs, n.tolist())])
    inside = np.arange(look) < n[:, None]
    logp, rest = np.zeros(inside.shape), np.full(inside.shape, -np.inf)
    logp[inside], rest[inside] = lat.logp[edges], lat.rest[edges]
    first = np.cumsum(n) - n
    for i, (t, path, d, _, gone, _) in enumerate(jobs):
        if gone:  # at the first decision more than one edge is out
            e = int(edges[first[i]])
            a, b = lat.edges_of(e)
            p = sum(math.exp(lat.logp[x]) for x in range(a, b) if x != e and x not in gone)
            rest[i, 0] = math.log(p) if p > 0 else -math.inf
    before = np.cumsum(logp, 1) - logp + np.array([j[3] for j in jobs])[:, None]
    mass = before + rest
    bound = np.array([t.paths[path][0] for t, path, *_ in jobs])[:, None]
    key = np.array([(t.seed + (path + 1) * int(_M2) + (d + 1) * int(_M3)) & 0xFFFFFFFFFFFFFFFF for t, path, d, *_ in jobs], np.uint64)
    u = _uniform(key[:, None] + np.arange(look, dtype=np.uint64) * _M3).astype(float)
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        got = mass - np.logaddexp(mass - bound, np.log(-np.log(u + 2.0**-25)))
    got[~np.isfinite(mass)] = -np.inf
    most = max(j[5] for j in jobs)
    best = np.argsort(-got, 1, kind="stable")[:, : min(most, look)].tolist()
    further = []
    for i, ((t, path, d, head, gone, want), m) in enumerate(zip(jobs, n.tolist())):
        row = [(float(got[i, k]), k) for k in best[i][:want]]
        worst = row[-1][0] if len(row) == want else -math.inf
        if d + m < len(t.paths[path][1]) and before[i, m - 1] + logp[i, m - 1] + MOST_NOISE >= worst:
            further.append(jobs[i])
            continue
        for g, k in row:
            if g > -math.inf:
                e = int(edges[first[i] + k])
                heapq.heappush(t.agenda, (-g, len(t.agenda), path, d + k, gone | {e} if k == 0 else frozenset((e,)), float(before[i, k])))
    group = max(1, 4096 // look)
    for a in range(0, len(further), group):
        _branches(lat, further[a : a + group], look * 4)


def sample(lat: Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text at most k distinct segmentations, the best first: edges, log-probability, perturbed log-probability, log of the inclusion score.

    The inclusion score is the probability that a path's perturbed
    log-probability passes that of the first path left out; it is 1 if none is.
    """
    rows, counts = lat.rows(texts)
    lo = np.cumsum(counts) - counts
    found = [_Text(s, int(n), int(a)) for s, n, a in zip(seeds, counts, lo)]
    seed_of = np.repeat(np.array([s & 0xFFFFFFFFFFFFFFFF for s in seeds], np.uint64), counts)
    place = np.arange(len(rows)) - np.repeat(lo, counts)
    keys = seed_of + place.astype(np.uint64) * _M2
    roots = lat.root[rows]
    for r in range(k):
        if r == 0:
            edges, n = lat.walk(roots, keys)
            ends = np.cumsum(n)
            for t in found:
                a, b = (int(ends[t.lo - 1]) if t.lo else 0), (int(ends[t.lo + t.units - 1]) if t.units else 0)
                top = -math.log(-math.log(_chance(t.seed, 0)))
                t.paths.append((top, edges[a:b], n[t.lo : t.lo + t.units]))
            _branches(lat, [(t, 0, 0, 0.0, frozenset(), k) for t in found if t.units])
            continue
        jobs, nodes, key_parts = [], [], []
        for t in found:
            if not t.agenda:
                continue
            bound, _, path, d, gone, head = heapq.heappop(t.agenda)
            _, edges, n = t.paths[path]
            a, b = lat.edges_of(int(edges[d]))
            free = [e for e in range(a, b) if e not in gone]
            p = np.exp(lat.logp[free].astype(float))
            e = free[min(int(np.searchsorted(np.cumsum(p), _chance(t.seed, r, d) * p.sum(), side="right")), len(free) - 1)]
            unit = int(np.searchsorted(np.cumsum(n), d, side="right"))
            jobs.append((t, -bound, path, d, e, gone, head, unit))
            own = roots[t.lo + unit : t.lo + t.units].copy()
            own[0] = lat.goal[e]
            nodes.append(own)
            key_parts.append(keys[t.lo + unit : t.lo + t.units] + np.uint64(r * int(_M3) & 0xFFFFFFFFFFFFFFFF))
        if not jobs:
            break
        edges, n = lat.walk(np.concatenate(nodes), np.concatenate(key_parts))
        ends, at = np.concatenate([[0], np.cumsum(n)]), 0
        for (t, bound, path, d, e, gone, head, unit), own in zip(jobs, nodes):
            a, b = int(ends[at]), int(ends[at + len(own)])
            _, old, old_n = t.paths[path]
            done = int(old_n[:unit].sum())
            new_n = np.concatenate([old_n[:unit], n[at : at + len(own)]])
            new_n[unit] += d - done + 1
            t.paths.append((bound, np.concatenate([old[:d], [e], edges[a:b]]), new_n))
            at += len(own)
        _branches(lat, [(t, r, d, head, gone, k - r) for t, _, _, d, _, gone, head, _ in jobs])
    out = []
    for t in found:
        limit = -t.agenda[0][0] if t.agenda else -math.inf
        own = []
        for bound, edges, _ in t.paths:
            logp = float(lat.logp[edges].sum(dtype=float))
            gap = logp - limit
            score = 0.0 if gap > 700 else math.log(-math.expm1(-math.exp(gap))) if gap > -30 else gap
            own.append((edges, logp, bound, score))
        out.append(own)
    return out


_LOADED: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """The worker's lattices of a model."""
    if (path, alpha) not in _LOADED:
        _LOADED[path, alpha] = Lattices(path, alpha)
    return _LOADED[path, alpha]


def _give_back() -> None:
    """Return what the worker has freed to the system, which counts it until then; the worker is used again by other stages."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)
    pa.default_memory_pool().release_unused()


def _rounds(batch: pa.RecordBatch) -> Iterator[list[tuple[int | None, str]]]:
    """(doc_id, text) of a batch in rounds of about equal size; a null text is an empty one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), ROUND_BYTES, side="right")))
        yield [(k, t or "") for k, t in zip(batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist())]
        at += n


DIGEST = "doc_id long, rank int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, text_crc32 long"


def _sampler(path: str, k: int, alpha: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path, alpha)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for batch in batches:
            for part in _rounds(batch):
                seeds = [xxhash.xxh64_intdigest(repr(key).encode(), seed) for key, _ in part]
                rows, lists = [], []
                for (key, _), own in zip(part, sample(lat, [t for _, t in part], seeds, k)):
                    for rank, (edges, logp, bound, score) in enumerate(own, 1):
                        ids = lat.ids(edges)
                        text = lat.decode(ids.tolist())
                        rows.append((key, rank, len(ids), logp, bound, score, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(text.encode("utf-8", "surrogatepass"))))
                        if with_ids:
                            lists.append(ids)
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)
        _give_back()

    return run


def sample_pieces(docs: DataFrame, path: str, k: int = 2, alpha: float = 1.0, seed: int = 7, with_ids: bool = True) -> DataFrame:
    """At most ``k`` distinct segmentations of each whole text of ``docs(doc_id, text)``, one row each.

    rank 1 is a plain sample; the rows of a document are samples without
    replacement, by falling perturbed log-probability, with the log of their
    inclusion scores. ``ids_crc32`` is of the ids as little-endian unsigned
    32-bit integers, ``text_crc32`` of the UTF-8 bytes of the text decoded from
    the ids, which is the text itself. A text with fewer than k segmentations
    gives fewer rows; an empty or null text gives one row. Seeded by doc_id:
    rows that share it and the text get the same samples, whatever the
    partitions. An empty table gives no rows; other columns are left out. A
    null doc_id is a seed like any other and stays null.

    A worker holds lattices within a bound of units and of edges, those of long
    units for one round only, and one round of texts; a text larger than a
    round is a round of its own, with about 100 bytes a character.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_sampler(path, k, alpha, seed, with_ids), DIGEST + ", ids array<int>" * with_ids)

"""Embedding near-duplicates: spherical-cap filters from random product codes, joined on the filter and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlbrook.operators.graph import connected_components
from marlbrook.shared import cut

#: Filters of each code that a vector exceeds on average.
LIST_SIZE = 10
#: Codes, each with a rotation of its own, for codebooks of so many codewords at most. A pair at cosine 0.95 shares a filter
#: of one code less often the more codewords there are (measured in 64 dimensions, means of 14 codes: 0.69 at 1,415, 0.69 at
#: 3,000, 0.62 at 10,000, 0.56 at 32,768). The product of the measured misses of the codes is 0.8, 0.4, 0.3 and 0.3 in 10,000.
ROTATIONS = ((1415, 8), (3000, 9), (10_000, 11), (1 << 15, 13))
#: Vectors other than near ones that meet under a filter on average, and the bounds of a codebook.
LOAD, LEAST_CODES, MOST_CODES = 0.1, 128, 1 << 15
#: Vectors of a block: a fuller filter is verified in pairs of blocks, each a task of its own.
BLOCK = 1024
#: Vectors of a group whose pairs are first looked through together with those of other groups.
SMALL = 24
SEED = 99991


class Filters:
    """Filters of one code: directions (c_i, c_j) / sqrt 2 from two codebooks of random unit vectors, after a random rotation.

    A vector exceeds a filter if its cosine with the direction is at least
    ``height``, which is set so that a random vector exceeds LIST_SIZE of the
    codes * codes filters on average.
    """

    def __init__(self, dim: int, codes: int, rotation: int):
        rng = np.random.Generator(np.random.PCG64([SEED, dim, codes, rotation]))
        self.dim, self.wide, self.base = dim, max(2, dim + dim % 2), dim * ROTATIONS[-1][1] + rotation << 40
        half = self.wide // 2
        # few directions differ in few dimensions: more codes would only repeat them
        self.codes = codes = min(codes, 4 ** min(half, 12))
        self.rotation = np.linalg.qr(rng.standard_normal((self.wide, self.wide)))[0]
        self.books = [b / np.linalg.norm(b, axis=1, keepdims=True) for b in rng.standard_normal((2, codes, half))]
        probe = rng.standard_normal((64, self.wide))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        s = [np.sort(probe[:, :half] @ self.books[0].T, 1), np.sort(probe[:, half:] @ self.books[1].T, 1)]
        low, high = 0.0, 1.5
        for _ in range(30):
            mid = (low + high) / 2
            n = sum(int((codes - np.searchsorted(b, mid - a)).sum()) for a, b in zip(*s)) / len(probe)
            low, high = (mid, high) if n > LIST_SIZE else (low, mid)
        self.height = low

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """All filters that each unit vector exceeds; the best one for a vector that exceeds none."""
        wide = np.zeros((len(x), self.wide))
        wide[:, : self.dim] = x
        wide = wide @ self.rotation
        half, out = self.wide // 2, []
        for a in range(0, len(x), 256):
            one, two = wide[a : a + 256, :half] @ self.books[0].T, wide[a : a + 256, half:] @ self.books[1].T
            for s, t, top_s, top_t in zip(one, two, one.max(1), two.max(1)):
                least = min(self.height, top_s + top_t)
                i, j = np.flatnonzero(s >= least - top_t), np.flatnonzero(t >= least - top_s)
                p, q = np.nonzero(s[i][:, None] + t[j] >= least)
                out.append(i[p] * self.codes + j[q] + self.base)
        return out


_FILTERS: dict[tuple[int, int], list[Filters]] = {}


def n_rotations(codes: int) -> int:
    """Codes that hold the misses at cosine 0.95 under one in ten thousand with codebooks of ``codes`` codewords."""
    return next((n for most, n in ROTATIONS if codes <= most), ROTATIONS[-1][1])


def decode(x: np.ndarray, codes: int) -> list[np.ndarray]:
    """The filters of all codes that each row exceeds, ascending."""
    key = (x.shape[1], codes)
    if key not in _FILTERS:
        _FILTERS[key] = [Filters(*key, r) for r in range(n_rotations(codes))]
    return [np.sort(np.concatenate(parts)) for parts in zip(*(f.decode(x) for f in _FILTERS[key]))]


def n_codes(n: int) -> int:
    """Codewords of a codebook for n vectors, so that LOAD others meet under a filter on average."""
    return min(MOST_CODES, max(LEAST_CODES, math.ceil(math.sqrt(n * LIST_SIZE / LOAD))))


def _unit(lists: list[list[float]]) -> np.ndarray:
    x = np.array(lists, float)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoder(codes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, places in by_dim.items():
                x = _unit([vectors[i] for i in places])
                found = decode(x, codes)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in places], pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int64()))], names=["id", "x", "filters"])

    return run


def _group(f: int, apart: bool, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, block: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, ...]:
    """Links of one filter, or of two blocks of one: how many each vector has here, and a vector that it is joined with.

    A pair that shares several filters counts under the first of them only.
    """
    link = (x @ x.T) >= least
    np.fill_diagonal(link, False)
    if apart:
        link &= block[:, None] != block[None, :]
    earlier, n = np.unique(np.concatenate([v[v < f] for v in lists]), return_counts=True)
    earlier = earlier[n > 1]
    if len(earlier):
        met = np.zeros((len(x), len(earlier)), np.float32)
        for i, v in enumerate(lists):
            met[i, np.searchsorted(earlier, v[np.isin(v, earlier)])] = 1
        link &= (met @ met.T) < 0.5
    count, root = link @ copies, np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(link, root[None, :], len(ids)).min(1))
        new = new[new]
        if (new == root).all():
            break
        root = new
    on = count > 0
    return ids[on], count[on], ids[root][on]


def _verify(least: float):
    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """All groups of a table in which each group is whole: those in which some pair is near go to _group."""
        t = t.combine_chunks()
        key = np.stack([t[c].to_numpy() for c in ("filter", "bi", "bj")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(1)]))
        ends = np.append(starts[1:], len(key))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        flat, at = t["x"].chunk(0).values.to_numpy(), t["x"].chunk(0).offsets.to_numpy()
        width = np.diff(at)
        near = ends - starts > SMALL
        for d in np.unique(width).tolist():
            rows = np.flatnonzero(width == d)
            x = flat[at[rows][:, None] + np.arange(d)]
            g = of[rows]
            for o in range(1, SMALL):
                same = np.flatnonzero((g[o:] == g[:-o]) & ~near[g[o:]])
                if not len(same):
                    break
                near[g[same[np.einsum("ij,ij->i", x[same], x[same + o]) >= least - 1e-9]]] = True
        ids, copies, block, lists = t["id"].to_numpy(), t["copies"].to_numpy(), t["block"].to_numpy(), t["filters"].chunk(0)
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k in np.flatnonzero(near).tolist():
            a, b = int(starts[k]), int(ends[k])
            x = flat[at[a] : at[b]].reshape(b - a, -1)  # one filter, one dimension
            got = _group(int(key[a, 0]), key[a, 1] != key[a, 2], x, ids[a:b], copies[a:b], block[a:b], [values[bounds[i] : bounds[i + 1]] for i in range(a, b)], least)
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            same = np.ones(len(batch), bool)
            for c in ("filter", "bi", "bj"):
                col = batch.column(batch.schema.get_field_index(c)).to_numpy()
                same &= col == col[-1]
            tail = len(batch) - int(np.argmin(same[::-1])) if not same.all() else 0  # first row of the last group
            if held and same.all() and all(held[-1].column(held[-1].schema.get_field_index(c))[-1] == batch.column(batch.schema.get_field_index(c))[0] for c in ("filter", "bi", "bj")):
                held.append(batch)
                continue
            yield from solve(pa.Table.from_batches([*held, batch.slice(0, tail)])) if held or tail else ()
            held = [batch.slice(tail)]
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``: links are pairs with a cosine of at least ``least``.

    Cosines are taken in double precision. Equal vectors collapse to one that
    knows its copies. Each is decoded to the filters it exceeds; vectors meet
    under a filter, and a pair counts under the first filter it shares. A
    filter with more than BLOCK vectors is dealt out as pairs of blocks. Counts
    are summed and links leave a task as a star, never as all pairs. A pair at
    cosine 0.95 is missed with a probability under one in ten thousand whatever
    the number of vectors (measured in 64 dimensions), and closer pairs less
    often. Never a pair below.

    Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing, and neither do vectors of unlike lengths.
    Repeated rows count as vectors. An empty table gives no rows; other columns
    are left out.
    """
    v = F.col("v")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    raw = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("fine", fine)
    # the sign of a zero is no difference
    raw = raw.withColumn("v", F.transform("v", lambda e: e + F.lit(0.0)))
    keyed = cut(raw.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v")), "vectors")
    good = keyed.where("fine and vec_id is not null")
    own = cut(good.groupBy("h1", "h2").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct")
    codes = n_codes(own.count())
    decoded = cut(own.select("id", "v").mapInArrow(_decoder(codes), "id long, x array<double>, filters array<long>").join(own.select("id", "copies"), "id"), "filters")
    met = decoded.select("id", F.explode("filters").alias("filter")).withColumn("size", F.count("*").over(Window.partitionBy("filter"))).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = met.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    # under one filter block b meets each block, the lower number first
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("bi", F.least("block", "with")).withColumn("bj", F.greatest("block", "with"))
    rows = cut(met.select("id", "filter", "block", "bi", "bj"), "met").join(decoded, "id")
    dealt = rows.repartition("filter", "bi", "bj").sortWithinPartitions("filter", "bi", "bj", "id")
    found = cut(dealt.mapInArrow(_verify(least), "id long, n long, root long"), "links")
    count = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = connected_components(found.select("id", "root").distinct(), "id", "root")
    named = cut(own.select("h1", "h2", "id", "copies").join(count, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left"), "named")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.lit(True).alias("fine"))
    out = keyed.select("vec_id", "h1", "h2", (F.col("fine") & F.col("vec_id").isNotNull()).alias("fine")).join(named, ["h1", "h2", "fine"], "left")
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

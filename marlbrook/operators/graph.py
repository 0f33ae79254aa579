"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlbrook.shared import cut, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38)))")).first())


#: Edges that one task may hold: a graph that small, or contracted so far, is finished there in one pass.
FOLD_EDGES = 1_000_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, given the ends of the edges, by passing the smaller label along until nothing changes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # the least label goes to the ends and to what the ends stood for
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return label
        label = new


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of all edges -> (node, least node of its component)."""
    edges = [b for b in batches if len(b)]
    if not edges:
        return
    u, v = (pa.chunked_array([b.column(k) for b in edges]) for k in (0, 1))
    nodes = pc.unique(pa.chunked_array(u.chunks + v.chunks))
    nodes = nodes.take(pc.sort_indices(nodes))
    label = least_labels(len(nodes), *(pc.index_in(x, nodes).to_numpy() for x in (u, v)))
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "component"])


def _lower(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    Alternates the large-star and small-star contractions, which end after a
    number of rounds that is logarithmic in the size of the longest chain. A
    star's centre may touch a third of all nodes: minima are partial
    aggregates, and the joins that carry them are plain shuffles of two scans,
    which adaptive execution splits where a key is hot. Every half-round is a
    table in the shared folder. Nodes without an edge, and edges with a null
    end, have no row; a node that only loops to itself is its own component.
    An empty edge table gives no rows.
    """
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null")
    loops = pairs.where("src = dst").select(F.col("src").alias("u")).distinct()
    cur = cut(pairs.where("src <> dst").select(*_lower(F.col("src"), F.col("dst"))).distinct(), "edges")
    state, whole = _state(cur), None
    for _ in range(max_rounds):
        if not state[0]:
            break
        if state[0] <= FOLD_EDGES and dict(cur.dtypes) in ({"u": "bigint", "v": "bigint"}, {"u": "string", "v": "string"}):
            kind = cur.dtypes[0][1]
            whole = cut(cur.coalesce(1).mapInArrow(_fold, f"node {kind}, component {kind}"), "folded")
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        star = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = cut(star.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = star.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small")
        for t in (least, star, lower, cur):
            drop(t)
        cur, before = new, state
        state = _state(cur)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    if whole is not None:
        return whole.unionByName(alone.join(whole.select("node"), "node", "left_anti"))
    named = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = named.unionByName(roots)
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))

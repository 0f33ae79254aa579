"""Mixing sources to target weights: pivotal dependent rounding of copy probabilities."""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlbrook.shared import cut

#: Rows of one leaf of the reduction tree, and residuals that one inner node combines.
LEAF_ROWS, FAN_IN = 2048, 64
#: Rows of more than this part of their source's target are large: drawing one would put the source off by as much.
LARGE = 0.01


def n_words(text: Column) -> Column:
    """Runs of bytes that are neither a blank nor U+0009 to U+000D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, cap: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """source, source_size, source_rows, target for ``sized(source, size)``.

    Sources by code point, null last, get the weights in turn and share the
    sum of all sizes; a target stops at ``cap`` times its source's size, and
    the excess goes to the others by weight until none is above. The per-source
    table stays distributed; a round brings three numbers to the driver.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    ranked = sums.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    ranked = cut(ranked.withColumn("_m", F.monotonically_increasing_id()), "sources").withColumn("_p", F.shiftright("_m", 33))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in ranked.groupBy("_p").count().collect()):
        offsets.append((p, before))
        before += n
    base = spark.createDataFrame(offsets, "_p long, _before long")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_m").bitwiseAND((1 << 33) - 1) + F.col("_before"), F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranked.join(F.broadcast(base), "_p").select("source", "source_size", "source_rows", w.alias("w")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, seen = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("w") * level >= F.col("source_size") * cap
        n, taken, free = ranked.agg(F.coalesce(F.sum(full.cast("long")), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        if n == seen or not free:
            break
        level, seen = (total - taken) / free, n
    t = F.col("source_size") * cap if level is None else F.least(F.col("w") * level, F.col("source_size") * cap)
    return ranked.select("source", "source_size", "source_rows", t.cast("double").alias("target"))


def _seeded(seed: int, *parts) -> random.Random:
    return random.Random(hashlib.sha256(repr((seed, *parts)).encode()).digest())


def _pivot(sizes: list[int], probs: list[float], rng: random.Random) -> int | None:
    """Round ``probs`` in place until at most one is fractional, and return its place.

    Two fractional rows a and b play: words move from one to the other until
    one of them has probability 0 or 1, in the direction that keeps both
    expectations. The sum of size times probability never changes.
    """
    held = None
    for i, p in enumerate(probs):
        if not 1e-9 < p < 1 - 1e-9:
            probs[i] = float(round(p))
            continue
        if held is None:
            held = i
            continue
        j = held
        a, b, pa, pb = sizes[j], sizes[i], probs[j], p
        to_b, to_a = min(a * pa, b * (1 - pb)), min(b * pb, a * (1 - pa))
        move = to_b if rng.random() * (to_a + to_b) < to_a else -to_a
        pa, pb = pa - move / a, pb + move / b
        fa, fb = 1e-9 < pa < 1 - 1e-9, 1e-9 < pb < 1 - 1e-9
        probs[j], probs[i] = pa if fa else float(round(pa)), pb if fb else float(round(pb))
        held = j if fa else i if fb else None
    return held


def _node(seed: int, level: int, root: bool):
    """Grouped map of one node of the tree: rows play from the largest to the smallest, so what stays fractional is a small row. The root rounds it by its probability."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "prob"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes, probs = pdf["size"].tolist(), pdf["prob"].tolist()
        rng = _seeded(seed, level, None if pd.isna(pdf["source"][0]) else pdf["source"][0], int(pdf["node"][0]))
        left = _pivot(sizes, probs, rng)
        if root and left is not None:
            probs[left] = float(rng.random() < probs[left])
        pdf["prob"] = probs
        return pdf

    return combine


def _rounded(groups: DataFrame, leaves: int, seed: int) -> DataFrame:
    """``groups(source, key, size, prob, node)`` with prob 0 or 1: each level of the tree leaves one fractional row of a node, the root none."""
    live = (F.col("prob") > 1e-9) & (F.col("prob") < 1 - 1e-9)
    done, cur, level = [groups.where(~live).withColumn("prob", F.round("prob"))], groups.where(live), 0
    while True:
        root = leaves <= 1
        out = cut(cur.groupBy("source", "node").applyInPandas(_node(seed, level, root), cur.schema), f"level{level}")
        if root:
            done.append(out)
            break
        done.append(out.where(~live))
        leaves, level = -(-leaves // FAN_IN), level + 1
        cur = out.where(live).withColumn("node", F.expr(f"node div {FAN_IN}"))
    all_rows = done[0]
    for d in done[1:]:
        all_rows = all_rows.unionByName(d)
    return all_rows


def _large_copies(cap: float):
    """Grouped map over a source's large rows: copies from the largest row to the smallest, each the whole number nearest to what the words that are left ask of the rows that are left.

    A row takes more or less where only that leaves the rows after it within 0
    and ``cap`` copies, so what a row is given too much or too little is made up
    by smaller ones. A source has no more than source_size / (LARGE * target)
    large rows, whatever its size.
    """

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable", ignore_index=True)
        words, rest, sure = float(pdf["target"][0]), int(pdf["source_size"][0]), []
        for size, same in zip(pdf["size"].tolist(), pdf["same"].tolist()):
            ask = words / rest * same
            rest -= size * same
            least, most = math.ceil((words - cap * rest) / size - 1e-9), math.floor(words / size + 1e-9)
            n = max(least, min(round(ask), most)) if rest else round(words / size)
            n = max(0, min(n, math.floor(cap * same)))
            sure.append(n)
            words -= n * size
        return pdf.assign(sure=sure)[["source", "key", "size", "sure"]]

    return give


def _shared_out(rows: DataFrame) -> DataFrame:
    """copies for each row of ``rows(..., key, source, size, same, all_copies, _m)``: its share of what all ``same`` rows equal to it get.

    Where the share is no whole number, rows count themselves: those of one
    partition in a window, partitions by a prefix over one number each, so a
    row that repeats very often is never one task.
    """
    same = ["source", "key", "size"]
    even, odd = rows.where("all_copies % same = 0"), rows.where("all_copies % same <> 0")
    even = even.withColumn("copies", F.expr("all_copies div same"))
    odd = odd.withColumn("_p", F.shiftright("_m", 33))
    counts = odd.groupBy(*same, "_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*same).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("size").alias("_z"), F.col("_p").alias("_q"), "_before")
    place = F.row_number().over(Window.partitionBy(*same, "_p").orderBy("_m")) - 1
    odd = odd.withColumn("_at", place).join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_z")) & (F.col("_p") == F.col("_q")))
    odd = odd.withColumn("copies", F.expr("all_copies div same + if(_at + _before < all_copies % same, 1, 0)"))
    return even.unionByName(odd.select(even.columns)).drop("same", "all_copies")


def _taken(slim: DataFrame, seed: int, cap: float) -> DataFrame:
    """``slim(key, source, size, ...)`` with source_size, target and copies. Rows with equal source, key and size are equal and share their copies."""
    slim = cut(slim.withColumn("_m", F.monotonically_increasing_id()), "sizes")
    goal = cut(targets(slim, cap), "targets")
    same = ["source", "key", "size"]
    groups = slim.groupBy(*same).agg(F.count("*").alias("same")).join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    groups = cut(groups, "distinct")
    large, own = F.col("size") > LARGE * F.col("target"), F.col("source").eqNullSafe(F.col("_s"))
    given = groups.where(large & (F.col("target") > 0)).groupBy("source").applyInPandas(_large_copies(cap), "source string, key long, size long, sure long")
    given = cut(given, "large").withColumnRenamed("source", "_s")
    spent = groups.join(given.withColumnsRenamed({"key": "_k", "size": "_z"}), own & (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_z")), "left").drop("_s", "_k", "_z")
    fixed = F.col("sure").isNotNull()
    left = spent.groupBy(F.col("source").alias("_s")).agg(F.coalesce(F.sum(F.when(fixed, F.col("sure") * F.col("size"))), F.lit(0)).alias("_words"), F.coalesce(F.sum(F.when(fixed, F.col("size") * F.col("same"))), F.lit(0)).alias("_size"))
    # what the large rows leave of the target, over the words of the others
    ratio = F.when(F.col("source_size") > F.col("_size"), F.least(F.lit(cap), F.greatest(F.lit(0.0), (F.col("target") - F.col("_words")) / (F.col("source_size") - F.col("_size"))))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    groups = spent.join(left, own).withColumn("_q", ratio).withColumn("whole", F.floor(F.col("_q") + 1e-12).cast("long"))
    # equal rows are one row of the tree: what they are owed together, without its whole part
    groups = groups.withColumn("_f", F.when((F.col("size") > 0) & ~fixed, F.greatest(F.col("_q") - F.col("whole"), F.lit(0.0)) * F.col("same")).otherwise(0.0))
    groups = groups.withColumn("sure", F.coalesce("sure", F.col("whole") * F.col("same") + F.floor(F.col("_f") + 1e-9).cast("long")))
    # a source's rows spread over as many leaves as its own share needs
    groups = groups.withColumn("prob", F.greatest(F.col("_f") - F.floor(F.col("_f") + 1e-9), F.lit(0.0))).withColumn("node", F.pmod(F.col("key"), F.ceil(F.col("source_rows") / LEAF_ROWS)).cast("long"))
    groups = cut(groups.select(*same, "same", "source_size", "target", "sure", "prob", "node"), "groups")
    leaves = -(-(goal.agg(F.max("source_rows")).first()[0] or 0) // LEAF_ROWS)
    owed = _rounded(groups, leaves, seed).select(F.col("source").alias("_s"), F.col("key").alias("_k"), F.col("size").alias("_z"), "same", "source_size", "target", (F.col("sure") + F.col("prob").cast("long")).alias("all_copies"))
    joined = slim.join(owed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & (F.col("size") == F.col("_z"))).drop("_s", "_k", "_z")
    return _shared_out(joined).drop("_m")


def mix_copies(docs: DataFrame, seed: int = 17, cap: float = 3.0) -> DataFrame:
    """doc_id, text_crc32, source, size, source_size, target, copies for each row of ``docs(doc_id, text, source)``.

    A source needs target / source_size copies of each of its rows on average.
    Rows of more than LARGE of the target get whole numbers of copies first,
    nearest to that average, as a draw of one could miss the target by its
    size. The others share what these leave: the whole part of their average is
    given to each, the fraction is rounded to 0 or 1 by pivotal dependent
    rounding, so each of them keeps its expected number of copies and the
    source's words come within LARGE of the target, or where all of its rows
    are large, near to it within a small one of them. Rows are dealt to
    leaves by a hash, so a source with a third of all rows has many; a leaf
    pairs its rows from the largest to the smallest and leaves one fractional
    row, inner nodes combine those of FAN_IN nodes, and the root of a source
    rounds the last one, a small row, by its probability. Seeded by the row:
    reruns agree.

    Rows without words (null or empty texts) have size 0 and no copies, except
    for the whole part of their source's ratio; a source of size 0 has target 0.
    Null sources are a source, the last; a null doc_id is an id like any other.
    Repeated rows are one row of the tree, which is owed the copies of all, and
    share them, so their numbers differ by one at most. An empty table gives no
    rows.
    """
    text = F.col("text")
    slim = docs.select("doc_id", F.crc32("text").alias("text_crc32"), "source", F.xxhash64("doc_id", text).alias("key"), n_words(text).alias("size"))
    return _taken(slim, seed, cap).select("doc_id", "text_crc32", "source", "size", "source_size", "target", "copies")


def mix_report(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each row, repeats counted.

    Nulls, ties, repeated rows and an empty table: as ``mix_copies`` has it.
    """
    return mix_copies(docs, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 17, cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, each repeated as often as ``mix_copies`` would take it.

    Rows that no copy is taken of go. Rows are told apart by a number that the
    first pass gives them in a table of the shared folder, so rows that differ
    in any column are rows of their own; rows equal in every column share their
    copies. The draw is seeded by a hash of the whole row: reruns agree. An
    empty table gives no rows.
    """
    row, whole = F.struct(*docs.columns), [F.to_json(c) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in docs.dtypes]
    rows = docs.select(row.alias("row"), F.xxhash64(*whole).alias("key"), F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    taken = _taken(rows.select("_row", "key", "source", "size"), seed, cap).where("copies > 0").select("_row", F.col("copies").cast("int").alias("copies"))
    return rows.select("_row", "row").join(taken, "_row").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

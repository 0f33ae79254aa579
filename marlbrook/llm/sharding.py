"""Sharding: minimax contiguous partition of ordered groups of equal texts.

Groups stand in the order of a hash of their text. A running sum of their
sizes makes a shard a stretch of that order, the greedy check of a capacity a
walk of look-ups in the running sum, and a document's shard a comparison of
its hash with the cuts. The driver holds the running sum only at a bounded
number of places; it asks for finer ones around the cuts until the smallest
feasible capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlbrook.shared import cut

#: Places of the running sum that one request may bring to the driver.
PLACES = 1 << 16
#: Rows that one window of the numbering inside a shard should have.
SLOT_ROWS = 1_000_000
BUCKETS = 4096


class _Sums:
    """What the driver knows of the running sum: ends of groups, and stretches in which other ends may lie."""

    def __init__(self, groups: DataFrame, total: int):
        self.groups, self.total = groups, total
        self.width = max(1, -(-total // PLACES))
        self.ends: list[int] = []
        self.spans: list[tuple[int, int, int]] = []
        self._ask([(0, total)], self.width)

    def _ask(self, spans: list[tuple[int, int]], width: int) -> None:
        near = F.lit(False)
        for a, b in spans:
            near = near | F.col("upto").between(a, b)
        got = self.groups.where(near).groupBy(F.expr(f"upto div {width}").alias("b")).agg(F.max("upto").alias("x"), F.min("upto").alias("y")).collect()
        self.ends = sorted({*self.ends, *(r["x"] for r in got), *(r["y"] for r in got), 0})
        self.spans += [(a, b, width) for a, b in spans]
        self.width = width

    def at_most(self, x: int) -> tuple[int, int]:
        """Bounds of the last end of a group that is at most x."""
        i = bisect_right(self.ends, x)
        low = self.ends[i - 1]
        if low == x or i == len(self.ends):
            return low, low
        # the first and last end of each stretch of a span are known: others lie between two of the same stretch
        apart = any(a <= low and x <= b and (low == 0 or low // w != self.ends[i] // w) for a, b, w in self.spans)
        return (low, low) if apart else (low, x)

    def walk(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, list[int]]:
        """Greedy cuts; where an end is not known, hopeful takes the upper bound."""
        at, cuts = 0, []
        for _ in range(shards):
            at2 = self.at_most(at + capacity)[1 if hopeful else 0]
            at = max(at, at2)
            cuts.append(at)
            if at >= self.total:
                return True, cuts
        return False, cuts


    def even(self, capacity: int, shards: int) -> list[int]:
        """Cuts at known ends with no shard over ``capacity``, each filled to a least size as large as lets ``shards`` shards hold all.

        A shard ends at the first end that gives it that size, or before a
        group that would take it over the capacity. At the least size
        ``capacity`` this is the greedy walk, which is feasible.
        """

        def cuts(least: int) -> list[int]:
            out, at = [], 0
            while at < self.total and len(out) <= shards:
                i = bisect_left(self.ends, at + least)
                if i == len(self.ends) or self.ends[i] > at + capacity:
                    i = bisect_right(self.ends, at + capacity) - 1
                if self.ends[i] <= at:
                    return [*out, *[self.total] * (shards + 1)]
                at = self.ends[i]
                out.append(at)
            return out

        return cuts(_least(lambda m: len(cuts(m)) <= shards, 1, capacity))


def _least(check, low: int, high: int) -> int:
    """The smallest number for which check holds; it holds for high."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if check(mid) else (mid + 1, high)
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, ends of the shards) for ``groups(upto, size)``, upto being the running sum of size up to and with the group.

    The capacity is the smallest for which walking the groups in order, and
    opening a shard when the next group does not fit, needs ``shards`` shards
    or fewer: binary search, checked greedily. Among the cuts of that capacity
    a second search takes those with the largest least fill, so that no shard
    is left empty where there are groups for it. No groups: (0, []).
    """
    total, largest = groups.agg(F.max("upto"), F.max("size")).first()
    if not total:
        return 0, []
    sums = _Sums(groups, total)
    low, high = max(largest, -(-total // shards)), total
    while True:
        low = _least(lambda c: sums.walk(c, shards, True)[0], low, high)
        high = _least(lambda c: sums.walk(c, shards, False)[0], low, high)
        if low == high:
            return low, sums.even(low, shards)
        a, b = sums.walk(low, shards, False)[1], sums.walk(high, shards, True)[1]
        b += [total] * (len(a) - len(b))
        spans: list[tuple[int, int]] = []
        for x, y in sorted((max(0, min(x, y) - sums.width), max(x, y) + sums.width) for x, y in zip(a, b)):
            if spans and x <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
            else:
                spans.append((x, y))
        span = sum(y - x for x, y in spans)
        n = groups.where(" or ".join(f"upto between {x} and {y}" for x, y in spans)).count()
        sums._ask(spans, 1 if n <= PLACES else max(1, min(sums.width // 2, -(-span // PLACES))))


def running_sum(groups: DataFrame, order: str, size: str = "size") -> DataFrame:
    """``groups`` with upto: the sum of size over all groups up to this one in the order of ``order``, a 64-bit hash.

    The order is dealt into BUCKETS stretches; each is summed by itself and
    raised by the sum of those before it, one number for each stretch.
    """
    spark = groups.sparkSession
    g = groups.withColumn("_b", F.expr(f"cast(floor(({order} / 1.8446744073709552E19 + 0.5D) * {BUCKETS}) as int)"))
    sums = sorted(tuple(r) for r in g.groupBy("_b").agg(F.sum(size)).collect())
    before, offsets = 0, []
    for b, n in sums:
        offsets.append((b, before))
        before += n
    base = spark.createDataFrame(offsets, "_b int, _before long")
    w = Window.partitionBy("_b").orderBy(order, "text_key").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("_run", F.sum(size).over(w)).join(F.broadcast(base), "_b").withColumn("upto", F.col("_run") + F.col("_before")).drop("_b", "_run", "_before")


def _numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """slot: numbers from 0 without gaps inside each shard, whatever the shard's share of the rows."""
    spark = rows.sparkSession
    salts = max(16, -(-n_rows // SLOT_ROWS))
    r = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int"))
    counts = sorted(tuple(x) for x in r.groupBy("shard", "_salt").count().collect())
    run: dict[int, int] = {}
    offsets = []
    for shard, salt, n in counts:
        offsets.append((shard, salt, run.get(shard, 0)))
        run[shard] = run.get(shard, 0) + n
    base = spark.createDataFrame(offsets, "shard int, _salt int, _before long")
    w = Window.partitionBy("shard", "_salt").orderBy("doc_id", "text_crc32", "size")
    return r.withColumn("_n", F.row_number().over(w)).join(F.broadcast(base), ["shard", "_salt"]).withColumn("slot", F.col("_before") + F.col("_n") - 1)


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs(doc_id, text)``.

    Law ``bytes``: rows of equal text form one group that is never cut, groups
    stand in the order of a hash of the text, and the largest shard is as
    small as any contiguous cut into ``shards`` shards allows. Null texts form
    a group of their own, with a null text_crc32, apart from empty ones; a
    group larger than the mean fills a shard alone. Within that capacity shards
    are filled as evenly as the groups allow. A null doc_id is a row like any other. Slots follow a salt, then
    doc_id. Repeated rows keep a row and a slot each. ``grown_shard`` is null
    under this law. An empty table gives no rows; other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    key = F.coalesce(F.unhex(F.sha2(F.col("text"), 256)), F.lit(b""))
    slim = cut(docs.select("doc_id", text_size(F.col("text")).alias("size"), F.crc32(F.col("text")).alias("text_crc32"), key.alias("text_key")), "slim").withColumn("ord", F.xxhash64("text_key"))
    sized = cut(running_sum(slim.groupBy("ord", "text_key").agg(F.sum("size").alias("size")), "ord"), "groups")
    _, ends = minimax_cuts(sized, shards)
    last = sorted(set(ends))
    # the last group of each shard: as many rows as shards
    marks = sorted((r["upto"], r["ord"], bytes(r["text_key"])) for r in sized.where(F.col("upto").isin(last)).select("upto", "ord", "text_key").collect())
    shard = F.lit(len(marks) - 1)
    for i in range(len(marks) - 2, -1, -1):
        _, o, k = marks[i]
        shard = F.when((F.col("ord") < o) | ((F.col("ord") == o) & (F.col("text_key") <= F.lit(k))), F.lit(i)).otherwise(shard)
    dealt = slim.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    out = _numbered(dealt, slim.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""SimHash near-duplicates: fingerprints of word shingles, joined with themselves by a binary trie."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructType
from pyspark.sql import Window

from marlbrook.operators.graph import connected_components
from marlbrook.shared import cut, drop

BITS = 64
#: Fingerprints that share a key and are joined in one trie; larger groups are dealt out by more bits first.
TRIE_ROWS = 4096
#: Shingles whose bits are counted at once.
SLICE = 1 << 15
#: Similar texts: fingerprints of each text, differing bits of one of them that make a pair a candidate, and of all of them
#: together beyond which it is none (unrelated texts differ in half of all bits).
WAYS, WIDE, FAR = 3, 12, 48
#: Masks for each fingerprint: AIM of the pairs with TYPICAL differing bits agree under one, LEAST_MASKS at least, of bits for
#: FEW unrelated fingerprints in a group; bits of a further dealing and its keys, and fingerprints of one trie (a wide budget prunes less).
TYPICAL, AIM, LEAST_MASKS, FEW, FURTHER_BITS, FURTHER_KEYS, WIDE_ROWS = 8, 0.9, 16, 8, 8, 6, 512
#: Members of a group whose pairs are first looked through together with those of other groups, and words whose hash a worker holds.
SMALL, HELD_WORDS = 24, 100_000
#: Texts of the sample that shows which shingles are common, texts of it that hold a common one at least, and common ones that are told apart:
#: these only set the order of shingles, and any order finds the same pairs.
SAMPLE, COMMON, MOST_COMMON = 4000, 6, 20_000
#: Entries that a worker holds before it passes them on, and texts for each task that looks through entries.
BLOCK_ENTRIES, TASK_TEXTS = 200_000, 50_000
#: Bits of an outline, powers of two: as many as the text has shingles up to SHORT_BITS, beyond that as many as show unrelated
#: long texts to be such, OUTLINE_BITS at most.
SHORT_BITS, OUTLINE_BITS = 2048, 1 << 14

_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def fingerprint(text: str, width: int = 4) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of the shingles of ``width`` words, repeats included.

    Words are runs of bytes other than a blank and U+0009 to U+000D, A to Z in
    lower case; with fewer words the whole sequence is the only shingle, with
    none the fingerprint is 0.
    """
    return fingerprints(text, width, 1)[0]


def fingerprints(text: str, width: int, ways: int) -> list[int]:
    """``fingerprint`` and ``ways`` - 1 more of the same kind, each of other hashes: the XXH64 mixed with another odd number."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).translate(_SPACE).split(b" ")
    words = [w for w in words if w]
    if not words:
        return [0] * ways
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((ways, BITS), np.int64)
    for at in range(0, n, SLICE):
        till = min(n, at + SLICE)
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[at:till], ends[at + width - 1 : till + width - 1] if len(words) > width else ends[-1:])]
        h = np.array(hashes, np.uint64)
        for way in range(ways):
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[way] += bits.sum(0, dtype=np.int64)
            h = (h ^ h >> np.uint64(31)) * _ODD[way % 3]
            h ^= h >> np.uint64(29)
            h = (h ^ h >> np.uint64(32)) * _ODD[(way + 1) % 3]
            h ^= h >> np.uint64(32)
    return [int.from_bytes(row.tobytes(), "big") for row in np.packbits(ones * 2 > n, axis=1)]


def simhash(text: Column, width: int = 4) -> Column:
    """The 64 bits of the fingerprint as a long; a null text has the fingerprint 0."""

    @F.arrow_udf(LongType())
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t or "", width) for t in batch.to_pylist()], np.uint64).view(np.int64), pa.int64())

    return prints.asNondeterministic()(text)


def simhashes(text: Column, width: int, ways: int) -> Column:
    """bits: ``fingerprints`` as an array of longs; outline: the text's ``outline``. One worker gives both."""

    @F.arrow_udf(StructType().add("bits", ArrayType(LongType())).add("outline", BinaryType()))
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bits, outs = np.zeros((len(batch), ways), np.uint64), []
            for i, t in enumerate(batch):
                text = t.as_py() or ""
                bits[i] = fingerprints(text, width, ways)
                outs.append(outline(text, width))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * ways), pa.array(bits.reshape(-1).view(np.int64)))
            yield pa.StructArray.from_arrays([arrays, pa.array(outs, pa.binary())], names=["bits", "outline"])
        _HASHES.clear()

    return prints.asNondeterministic()(text)


def hex64(bits: Column) -> Column:
    """16 lower-case hexadecimal digits of a long's bits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


class Trie:
    """A binary trie over distinct sorted fingerprints: a node is a stretch of the array and the depth to which its members agree."""

    def __init__(self, values: np.ndarray, budget: int):
        self.v, self.budget = [int(x) for x in values], budget
        self.parent = list(range(len(self.v)))
        self.one: set[tuple[int, int]] = set()
        self.links: list[tuple[int, int]] = []  # pairs within the budget, each the first to bring its components together

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def node(self, lo: int, hi: int) -> tuple[int, int, int]:
        return lo, hi, BITS - (self.v[lo] ^ self.v[hi - 1]).bit_length()

    def children(self, node: tuple[int, int, int]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
        lo, hi, depth = node
        bit, a, b = 1 << (BITS - 1 - depth), lo, hi
        while a < b:  # the first member with the bit set
            m = (a + b) // 2
            a, b = (a, m) if self.v[m] & bit else (m + 1, b)
        return self.node(lo, a), self.node(a, hi)

    def joined(self, lo: int, hi: int) -> bool:
        """All members are already in one component."""
        if hi - lo == 1 or (lo, hi) in self.one:
            return True
        root = self.find(lo)
        if any(self.find(i) != root for i in range(lo + 1, hi)):
            return False
        self.one.add((lo, hi))
        return True

    def join(self) -> list[int]:
        """The smallest place that each member reaches over links of at most ``budget`` differing bits.

        Walks pairs of nodes from the root: a pair's differing bits are those of
        the prefixes both have, a pair beyond the budget is left, and so is one
        whose members are one component already.
        """
        if len(self.v) > 1:
            todo: list[tuple] = [(self.node(0, len(self.v)), None)]
            while todo:
                a, b = todo.pop()
                if b is None:
                    if a[1] - a[0] > 1:
                        x, y = self.children(a)
                        todo += [(x, y), (x, None), (y, None)]  # inside first: what is joined there need not be walked across
                    continue
                shared = min(a[2], b[2])
                if ((self.v[a[0]] ^ self.v[b[0]]) >> (BITS - shared)).bit_count() > self.budget if shared else False:
                    continue
                if shared == BITS:
                    self.link(a[0], b[0])
                    continue
                if self.find(a[0]) == self.find(b[0]) and self.joined(a[0], a[1]) and self.joined(b[0], b[1]):
                    continue
                if a[2] <= b[2]:
                    x, y = self.children(a)
                    # the nearer child first
                    far = (self.v[x[0]] ^ self.v[b[0]]) >> (BITS - 1 - a[2]) & 1
                    todo += [(x, b), (y, b)] if far else [(y, b), (x, b)]
                else:
                    x, y = self.children(b)
                    far = (self.v[x[0]] ^ self.v[a[0]]) >> (BITS - 1 - b[2]) & 1
                    todo += [(a, x), (a, y)] if far else [(a, y), (a, x)]
        return [self.find(i) for i in range(len(self.v))]


def _blocks(bits: int, parts: int) -> list[int]:
    """Widths of ``parts`` blocks that cover ``bits`` bits."""
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def _mask(bits: list[int]) -> int:
    """The bits of a fingerprint that are set in a mask, as a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def _pairs_of_blocks(free: list[int], budget: int) -> list[int]:
    """Masks of two of budget + 2 blocks of the bits ``free``, for each two.

    Of so many blocks two at least have no differing bit if at most ``budget``
    bits differ, so any two fingerprints that link agree under one mask.
    """
    at, blocks = 0, []
    for n in _blocks(len(free), budget + 2):
        blocks.append(free[at : at + n])
        at += n
    return [_mask(x + y) for x, y in itertools.combinations(blocks, 2)]


def _deal(masks_of):
    """(bits, mask, key): fingerprints of groups that are too large for one trie, dealt out again by masks of the bits that their group does not fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, m, k in _dealt(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "mask", "key")), masks_of):
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(np.full(len(b), m, np.int64)), pa.array(k)], names=["bits", "mask", "key"])

    return run


def _stars(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            src, dst = [], []
            for group in np.split(values, cuts) if len(keys) else []:
                if len(group) > 1:
                    v = np.unique(group.view(np.uint64))
                    for i, r in enumerate(Trie(v, budget).join()):
                        if r != i:
                            src.append(v[i])
                            dst.append(v[r])
            if src:
                return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (src, dst)], names=["src", "dst"])
            return None

        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if out := solve(keys[:whole], values[:whole]):
                yield out
            keys, values = keys[whole:], values[whole:]
        if out := solve(keys, values):
            yield out

    return run


def _groups(keyed: DataFrame, masks_of, most: int) -> DataFrame:
    """``keyed(bits, mask, key)`` with groups of more than ``most`` dealt out by further bits, and what of these has more than 16 times as many dealt out again.

    A dealing repeats each member under several keys, so only groups that
    would strain one task go on. Each fixes more of the free bits: after five
    a group holds a few thousand distinct fingerprints at most.
    """
    whole, cur = None, cut(keyed, "keyed")
    for level in range(5):
        counts = cur.groupBy("key").agg(F.count("*").alias("n"))  # partial counts: a hot key is no task
        large = cut(counts.where(F.col("n") > most * (16 if level else 1)).select("key"), "large")
        if not large.limit(1).count():
            break
        small = cur.join(large, "key", "left_anti")
        whole = small if whole is None else whole.unionByName(small)
        cur = cut(cur.join(large, "key", "left_semi").select("bits", "mask", "key").mapInArrow(_deal(masks_of), "bits long, mask long, key long"), "dealt")
    return cur if whole is None else whole.unionByName(cur)


def trie_links(prints: DataFrame, budget: int = 4) -> DataFrame:
    """(src, dst): enough links between the distinct fingerprints of ``prints(bits)`` to reach whatever links of at most ``budget`` differing bits reach.

    Fingerprints meet under the bits of two blocks of six; a group too large
    for one trie is dealt out again by two blocks of its other bits, until it
    is small. A task joins the groups of its partition one after the other and
    gives at most one link for each member, never all pairs.
    """
    masks = _pairs_of_blocks(list(range(BITS)), budget)
    keys = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.xxhash64(F.lit(k), F.col("bits").bitwiseAND(F.lit(m))).alias("key")) for k, m in enumerate(masks)))
    keyed = _groups(prints.select("bits", F.inline(keys)), lambda free: _pairs_of_blocks(free, budget), TRIE_ROWS)
    dealt = keyed.select("key", "bits").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_stars(budget), "src long, dst long")


def simhash_components(docs: DataFrame, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs(doc_id, text)``.

    component_id is the least doc_id that is reached over fingerprints with at
    most ``budget`` differing bits, itself included. Copies collapse to one
    fingerprint before any join. Null and empty texts, and those of white
    space, have the fingerprint 0 and link like any other. Repeated rows stay
    all. A row with a null doc_id has a fingerprint, joins nothing by its id,
    and gets the component of its fingerprint. An empty table gives no rows.
    """
    slim = cut(docs.select("doc_id", simhash(F.col("text")).alias("bits")), "fingerprints")
    prints = cut(slim.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    found = cut(connected_components(cut(trie_links(prints, budget).distinct(), "links")), "components")
    # few fingerprints have a link; those of a component meet in one partial aggregate
    named = prints.join(found, prints["bits"] == found["node"], "left").select("bits", "least", F.coalesce("component", "bits").alias("component"))
    named = cut(named, "named")
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    label = cut(named.select("bits", "component").join(least, "component").select("bits", "component_id"), "labels")
    return slim.join(label, "bits").select("doc_id", hex64(F.col("bits")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, budget: int = 4) -> DataFrame:
    """The rows of ``docs``, with their columns, of one document of each component: that of the least doc_id.

    Rows that repeat a doc_id: one of them stays, the first by text. Rows
    without a doc_id can't stand for a component and stay all.
    """
    return _keep(docs, simhash_components(docs, budget))


def _keep(docs: DataFrame, components: DataFrame) -> DataFrame:
    kept = cut(components.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy(F.col("row.text").asc_nulls_first()))
    one = rows.join(kept.withColumnRenamed("doc_id", "key"), "key").withColumn("first", first).where("first = 1").select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def sampled_masks(n: int) -> list[int]:
    """Masks of random bits for n fingerprints: of so many bits that about FEW others agree under one, and as many masks as let AIM of the pairs with TYPICAL differing bits agree under one."""
    b = min(28, max(10, (max(n // FEW, 2) - 1).bit_length()))
    agree = math.comb(BITS - TYPICAL, b) / math.comb(BITS, b)
    rng = random.Random(b)
    return [_mask(rng.sample(range(BITS), b)) for _ in range(max(LEAST_MASKS, math.ceil(math.log(1 - AIM) / math.log(1 - agree))))]


def _further_masks(free: list[int]) -> list[int]:
    rng = random.Random(repr(free))
    return [_mask(rng.sample(free, min(FURTHER_BITS, len(free)))) for _ in range(FURTHER_KEYS)]


def _dealt(bits: np.ndarray, mask: np.ndarray, key: np.ndarray, masks_of) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(bits, mask, key) of members of groups dealt out by masks of the bits that their group does not fix."""
    for m in np.unique(mask).tolist():
        own = mask == m
        b, k = bits[own], key[own].view(np.uint64)
        for n, more in enumerate(masks_of([b for b in range(BITS) if not m >> b & 1])):
            h = (k ^ (b & np.int64(more)).view(np.uint64) * _ODD[0]) * _ODD[1] + np.uint64(n)
            h = (h ^ h >> np.uint64(32)) * _ODD[2]
            h ^= h >> np.uint64(29)
            both = (m | more) & 0xFFFFFFFFFFFFFFFF
            yield b, both - (1 << 64) if both >> 63 else both, h.view(np.int64)


def _candidates(budget: int, most: int | None):
    """(src, dst) for each group of equal key: the pairs within the budget by which its trie first brings two components together.

    A group of more than ``most`` is not joined: its members pass through as
    (bits, null, mask, key), dealt out by further bits; no more than ``most``
    rows of a group are held.
    """

    def batch(src, dst, mask=None, key=None) -> pa.RecordBatch:
        cols = [src, dst, mask, key]
        n = len(src)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if c is not None else pa.nulls(n, pa.int64()) for c in cols], names=["src", "dst", "mask", "key"])

    def pass_on(key, bits, mask) -> Iterator[pa.RecordBatch]:
        for b, m, k in _dealt(bits, mask, key, _further_masks):
            yield batch(b, None, np.full(len(b), m, np.int64), k)

    def solve(key: np.ndarray, bits: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        of = np.repeat(np.arange(len(starts)), ends - starts)
        near, v = ends - starts > SMALL, bits.view(np.uint64)
        if most is not None and (large := ends - starts > most).any():
            near &= ~large
            rows = large[of]
            yield from pass_on(key[rows], bits[rows], mask[rows])
        else:
            large = np.zeros(len(starts), bool)
        for o in range(1, SMALL):
            same = np.flatnonzero((of[o:] == of[:-o]) & ~(near | large)[of[o:]])
            if not len(same):
                break
            near[of[same[np.bitwise_count(v[same] ^ v[same + o]) <= budget]]] = True
        src, dst = [], []
        for g in np.flatnonzero(near).tolist():
            u = np.unique(v[starts[g] : ends[g]])
            trie = Trie(u, budget)
            trie.join()
            src += [u[i] for i, _ in trie.links]
            dst += [u[j] for _, j in trie.links]
        if src:
            yield batch(*(np.array(x, np.uint64).view(np.int64) for x in (src, dst)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = [np.zeros(0, np.int64)] * 3, None
        for one in batches:
            held = [np.concatenate([h, one.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "bits", "mask"))]
            key = held[0]
            if hot is not None:  # the rest of a group that is being passed on
                n = int(np.searchsorted(key, hot, side="right"))
                yield from pass_on(*(h[:n] for h in held))
                held, hot = [h[n:] for h in held], hot if n == len(key) else None
                key = held[0]
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))
            yield from solve(*(h[:whole] for h in held))
            held = [h[whole:] for h in held]
            if most is not None and len(held[0]) > most:
                hot = held[0][0]
                yield from pass_on(*held)
                held = [np.zeros(0, np.int64)] * 3
        yield from solve(*held)

    return run


def wide_pairs(prints: DataFrame, budget: int = WIDE) -> DataFrame:
    """(src, dst): candidate pairs of the distinct fingerprints of ``prints(bits)``, those by which tries of fingerprints that agree under a mask bring components together.

    With a column ``way``, only fingerprints of one way meet. One shuffle deals all fingerprints out; groups too large for one trie come
    back and are dealt out by further bits, and only those.
    """
    if "way" not in prints.columns:
        prints = prints.withColumn("way", F.lit(0))
    most = prints.groupBy("way").count().agg(F.max("count")).first()[0] or 0
    masks = F.array(*(F.lit(m).cast("long") for m in sampled_masks(most)))
    keys = F.transform(masks, lambda m, i: F.struct(m.alias("mask"), F.xxhash64("way", i, F.col("bits").bitwiseAND(m)).alias("key")))
    cur, found = prints.select("bits", F.inline(keys)), None
    for most in (WIDE_ROWS, 16 * WIDE_ROWS, 16 * WIDE_ROWS, 16 * WIDE_ROWS, None):
        dealt = cur.select("key", "bits", "mask").repartition("key").sortWithinPartitions("key")
        out = cut(dealt.mapInArrow(_candidates(budget, most), "src long, dst long, mask long, key long"), "candidates")
        links = out.where("dst is not null").select("src", "dst")
        found = links if found is None else found.unionByName(links)
        cur = out.where("dst is null").select(F.col("src").alias("bits"), "mask", "key")
        if most is None or not cur.limit(1).count():
            return found.distinct()


_HASHES: dict[bytes, int] = {}


def shingles(text: str, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, words as in ``fingerprint``; without words none."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).translate(_SPACE).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > HELD_WORDS:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        out = (out ^ h[i : i + n]) * _ODD[i % 3] + np.uint64(i)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def jaccard(a: str, b: str, width: int) -> float:
    """Similarity of the shingle sets of two texts; of two texts without words 1."""
    x, y = shingles(a, width), shingles(b, width)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _similar(width: int, least: float):
    @F.arrow_udf(BooleanType())
    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([jaccard(x.as_py() or "", y.as_py() or "", width) >= least for x, y in zip(a, b)], pa.bool_())
        _HASHES.clear()  # workers are used again by other stages

    return check


def _power(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << (max(n, 1) - 1).bit_length()


def outline(text: str, width: int) -> bytes:
    """The number n of distinct shingles of a text (4 bytes), and for each of about n places, OUTLINE_BITS at most, whether an odd number of them fall there.

    Two texts differ in at least as many shingles as places. Unrelated ones
    differ in half of the places, which must be more than texts of 0.8 may
    differ in (a quarter of n if one is as long as it may be), so long texts
    have places for 5 in 8 of their shingles at least.
    """
    h = shingles(text, width)
    b = min(OUTLINE_BITS, max(64, min(SHORT_BITS, _power(len(h))), _power(5 * len(h) // 8)))
    odd = np.bincount((h & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1
    return len(h).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: list[bytes], b: int) -> np.ndarray:
    """The places of outlines of b bits or more, b of them."""
    out = np.zeros((len(rows), b // 64), np.uint64)
    size = np.fromiter(map(len, rows), np.int64, len(rows)) - 4
    for c in np.unique(size).tolist():
        at = np.flatnonzero(size == c)
        places = np.frombuffer(b"".join(rows[i][4:] for i in at.tolist()), np.uint64).reshape(len(at), -1, b // 64)
        out[at] = np.bitwise_xor.reduce(places, axis=1)
    return out


def _may_differ(n: np.ndarray, least: float) -> np.ndarray:
    """Shingles that two texts of n together may differ in."""
    return (1 - least) / (1 + least) * n + 1e-6


def _near(least: float):
    """False only for pairs of outlines whose texts are below ``least``."""

    @F.arrow_udf(BooleanType())
    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            out = []
            for a, b in zip(x.to_pylist(), y.to_pylist()):
                bits = (min(len(a), len(b)) - 4) * 8
                differ = int(np.bitwise_count(_folded([a], bits) ^ _folded([b], bits)).sum())
                out.append(bool(differ <= _may_differ(int.from_bytes(a[:4], "little") + int.from_bytes(b[:4], "little"), least)))
            yield pa.array(out, pa.bool_())

    return check


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def _sample_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width).view(np.int64))], names=["s"])

    return run


def _prefixes(width: int, least: float, common: np.ndarray, buckets: int):
    """(bucket, entries): the first shingles of each text, so many that two texts of similarity ``least`` have one of them in common.

    A text of n shingles shares at least least * n with such a partner, so the
    first that both have, in one order for all texts, is among the first
    n - least * n + 1 of either. The order puts ``common`` shingles last. An
    entry is 40 bits of the shingle, its place and n (both rounded), and 48
    bits of the text's hash.
    """
    at_of = np.argsort(common)
    known = common[at_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def emit() -> pa.RecordBatch:
            key, shape, ref = (np.concatenate(x) for x in zip(*held))
            bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            word = key << np.uint64(24) | shape
            order = np.lexsort((word, bucket))
            bucket, word, ref = bucket[order], word[order], ref[order]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [word[a:b].tobytes() + (ref[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (ref[a:b] >> np.uint64(32)).astype(np.uint16).tobytes() for a, b in zip(starts, np.append(starts[1:], len(bucket)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for batch in batches:
            last = None
            for h, text in sorted(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)), key=lambda x: x[0]):
                if h == last:
                    continue
                last, s = h, shingles(text.as_py(), width)
                n = len(s)
                if len(known) and n:
                    place = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[place] == s
                    s = np.concatenate([s[~hit], common[np.sort(at_of[place[hit]])]])
                first = s[: n - _ceil(least * n) + 1] if n else np.zeros(1, np.uint64)
                part = np.arange(len(first), dtype=np.uint64) * np.uint64(256) // np.uint64(max(n, 1))
                shape = np.minimum(part, np.uint64(255)) << np.uint64(16) | np.uint64(int(math.log1p(n) * 2048))
                held.append((first, shape, np.full(len(first), h[0] & 0xFFFFFFFFFFFF, np.uint64)))
                n_held += len(first)
                if n_held > BLOCK_ENTRIES:
                    yield emit()
                    held, n_held = [], 0
        if held:
            yield emit()
        _HASHES.clear()

    return run


def _sizes(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries: the least and the greatest n, and the most shingles from the place on."""
    q = (shape & 0xFFFF).astype(float)
    most = np.exp((q + 1) / 2048) - 1
    return np.maximum(np.exp(q / 2048) - 1.001, 0), most, most * (1 - (shape >> 16 & 0xFF) / 256)


def _may_pair(x: tuple, y: tuple, least: float) -> np.ndarray:
    """Whether texts whose first common shingle these entries are can reach ``least``."""
    shared, sizes = np.minimum(x[2], y[2]), np.minimum(x[1], y[1])
    return (shared + 1e-3 >= least / (1 + least) * (x[0] + y[0])) & (sizes + 1e-3 >= least * np.maximum(x[0], y[0]))


def _shared(least: float):
    """(key, ref, shape): the entries of a bucket whose shingle another text has too, without those that can reach ``least`` with none of these."""

    def solve(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = [len(b) // 14 for b in blobs]
        word = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(blobs, n)])
        low = np.concatenate([np.frombuffer(b, np.uint32, m, m * 8) for b, m in zip(blobs, n)]).astype(np.int64)
        ref = np.concatenate([np.frombuffer(b, np.uint16, m, m * 12) for b, m in zip(blobs, n)]).astype(np.int64) << 32 | low
        key, shape = (word >> np.uint64(24)).astype(np.int64), (word & np.uint64(0xFFFFFF)).astype(np.int64)
        order = np.lexsort((ref, key))
        key, ref, shape = key[order], ref[order], shape[order]
        own = np.concatenate([[True], (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])])  # copies of a text that other workers met
        key, ref, shape = key[own], ref[own], shape[own]
        same = key[1:] == key[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        key, ref, shape = key[many], ref[many], shape[many]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(key)))
        keep, sizes = np.repeat(size > SMALL, size), _sizes(shape)
        for o in range(1, SMALL):
            at = np.flatnonzero((key[o:] == key[:-o]) & ~(keep[o:] & keep[:-o]))
            if not len(at):
                break
            at = at[_may_pair([x[at] for x in sizes], [x[at + o] for x in sizes], least)]
            keep[at] = keep[at + o] = True
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[keep] | bucket << 40, ref[keep], shape[keep])], names=["key", "ref", "shape"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != bucket and blobs:
                    yield from solve(bucket, blobs)
                    blobs = []
                bucket = b
                blobs.append(blob)
        if blobs:
            yield from solve(bucket, blobs)

    return run


def _across(least: float):
    """(a, b, of_a, of_b) for entries (key, node, component, shape, outline) that come by key: nodes of two components that have the key and can reach ``least``."""

    def solve(key: np.ndarray, node: np.ndarray, of: np.ndarray, shape: np.ndarray, outs: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        mixed = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        out, n_out = [], 0
        for lo, hi in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            n = np.array([int.from_bytes(x[:4], "little") for x in outs[lo:hi]], float)
            order = np.argsort(n, kind="stable")
            n, v, c, own = n[order], node[lo:hi][order], of[lo:hi][order], outs[lo:hi][order].tolist()
            shared = n * (1 - (shape[lo:hi][order] >> 16 & 0xFF) / 256)
            size, base, places = 0, 0, None
            for i in range(hi - lo - 1):
                till = int(np.searchsorted(n, n[i] / least + 1e-6, side="right"))
                at = i + 1 + np.flatnonzero(c[i + 1 : till] != c[i])
                at = at[np.minimum(shared[at], shared[i]) + 1e-6 >= least / (1 + least) * (n[at] + n[i])]
                if not len(at):
                    continue
                if len(own[i]) != size:  # texts further on have as many places or more
                    size, base = len(own[i]), i
                    places = _folded(own[i:], (size - 4) * 8)
                differ = np.bitwise_count(places[at - base] ^ places[i - base]).sum(1, dtype=np.int64)
                at = at[differ <= _may_differ(n[at] + n[i], least)]
                if len(at):
                    swap = v[at] < v[i]
                    vi, ci = np.full(len(at), v[i]), np.full(len(at), c[i])
                    out.append((np.where(swap, v[at], vi), np.where(swap, vi, v[at]), np.where(swap, c[at], ci), np.where(swap, ci, c[at])))
                    n_out += len(at)
                    if n_out > BLOCK_ENTRIES:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "of_a", "of_b"])
                        out, n_out = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "of_a", "of_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, object)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            yield from solve(*(h[:whole] for h in held))
            held = [h[whole:] for h in held]
        yield from solve(*held)

    return run


def pairs_left(texts: DataFrame, nodes: DataFrame, least: float, width: int) -> DataFrame:
    """(a, b, of_a, of_b, n): all pairs of ``nodes(node, h1, component, outline)`` in two components that may have a similarity of ``least``, with the first shingles that both have.

    Prefix filtering, so none of ``least`` or more is left out, whatever its
    fingerprints: of each text of ``texts(h1, h2, text)`` the first shingles
    are dealt out, and only those that a text of another component has go on.
    Members of one component are not paired, nor texts whose outlines differ in
    too many places.
    """
    count = nodes.count()
    sample = texts.where(F.pmod("h1", F.lit(max(1, count // SAMPLE))) == 0).groupBy("h1", "h2").agg(F.first("text").alias("text")).select("text")
    often = sample.mapInArrow(_sample_shingles(width), "s long").groupBy("s").count().where(F.col("count") >= COMMON)
    common = [r[0] for r in often.orderBy(F.desc("count"), "s").limit(MOST_COMMON).collect()][::-1]
    tasks = max(64, count // TASK_TEXTS)
    entries = texts.select("h1", "h2", "text").mapInArrow(_prefixes(width, least, np.array(common, np.int64).view(np.uint64), 4 * tasks), "bucket long, entries binary")
    dealt = entries.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    shared = cut(dealt.mapInArrow(_shared(least), "key long, ref long, shape long"), "shared")
    named = cut(shared.join(nodes.select(F.col("h1").bitwiseAND(F.lit(0xFFFFFFFFFFFF)).alias("ref"), "node", "component"), "ref").select("key", "node", "component", "shape"), "entries")
    mixed = cut(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    told = named.join(mixed, "key", "left_semi").join(nodes.select("node", "outline"), "node").select("key", "node", "component", "shape", "outline")
    pairs = told.repartition("key").sortWithinPartitions("key").mapInArrow(_across(least), "a long, b long, of_a long, of_b long")
    return pairs.groupBy("a", "b", "of_a", "of_b").agg(F.count("*").alias("n"))


def similar_components(docs: DataFrame, least: float = 0.8, width: int = 5, budget: int = WIDE) -> DataFrame:
    """doc_id, component_id for each row of ``docs(doc_id, text)`` with a doc_id: links are texts whose sets of ``width``-word shingles have a Jaccard similarity of at least ``least``.

    Each text has WAYS fingerprints of these shingles, from hashes of their own,
    so a pair that one of them puts far apart is near by another. Those of one
    way meet under the bits of random masks and are joined by tries with a wide
    budget; what a trie gives is the pairs that first bring two of its
    components together, fewer than its members, never all pairs. Pairs that
    differ in more than FAR bits of all ways are unrelated texts near by chance
    and go, and so do those whose outlines show them to be below ``least``;
    every other pair is held against its texts, so no link is below ``least``. Equal texts are one node from the start, whatever their number.
    The number of masks follows the number of fingerprints.

    A pair that differs in more than the budget by every way, agrees under no
    mask, or was joined in a trie only over pairs that their texts refute, is
    not among these. So all pairs of two components that may reach ``least``
    come from their first shingles (``pairs_left``) and are held against their
    texts: of each two components the pair with most of them first, then all
    that still lie in two. No pair of ``least`` or more is left out.

    component_id is the least doc_id reached, itself included. Null texts are
    empty ones; texts without words are alike. Rows that share a doc_id keep a
    row each. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.where("doc_id is not null").select("doc_id", text.alias("text")).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    slim = cut(keyed.select("doc_id", "h1", "h2", simhashes(F.col("text"), width, WAYS).alias("p")).select("doc_id", "h1", "h2", "p.*"), "fingerprints")
    nodes = slim.groupBy("h1", "h2", "bits", "outline").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes, "nodes")
    each = nodes.select("node", F.posexplode("bits").alias("way", "bits"))
    prints = cut(each.groupBy("way", "bits").agg(F.min("node").alias("head")), "distinct")
    met = wide_pairs(prints.select("way", "bits"), budget)
    # bits of two ways that are equal by chance name a pair that the texts refute
    one, two = prints.select(F.col("bits").alias("src"), F.col("head").alias("a")), prints.select(F.col("bits").alias("dst"), F.col("head").alias("b"))
    across = met.join(one, "src").join(two, "dst").select("a", "b")
    # texts of one fingerprint are held against the first of them
    inside = each.join(prints, ["way", "bits"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    met = across.unionByName(inside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = nodes.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("outline").alias("p")), nodes.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("outline").alias("q"))
    apart = F.aggregate(F.zip_with("x", "y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)
    pairs = cut(met.join(x, "a").join(y, "b").select("a", "b", apart.alias("apart"), "p", "q").where(F.col("apart") <= FAR).where(_near(least)("p", "q")).drop("p", "q"), "pairs")

    def texts_of(some: DataFrame) -> DataFrame:
        wanted = some.select(F.col("a").alias("node")).unionByName(some.select(F.col("b").alias("node"))).distinct()
        wanted = cut(wanted.join(nodes, "node").select("node", "h1", "h2", F.col("least").alias("doc_id")), "wanted")
        # repeated rows collapse in the partial aggregate
        return cut(keyed.join(wanted, ["doc_id", "h1", "h2"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    def held(some: DataFrame, texts: DataFrame) -> DataFrame:
        checked = some.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return cut(checked.where(_similar(width, least)("x", "y")).select("a", "b"), "links")

    def still_apart(some: DataFrame, comp: DataFrame) -> DataFrame:
        one, two = comp.select(F.col("node").alias("a"), F.col("component").alias("of_a")), comp.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
        return cut(some.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "rest")

    texts = texts_of(pairs)
    # each text's nearest first; of the other pairs only those that this leaves in two components need their texts
    nearest = cut(pairs.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b"), "nearest")
    links = held(nearest, texts)
    rest = still_apart(pairs.select("a", "b").join(nearest, ["a", "b"], "left_anti"), cut(connected_components(links, "a", "b"), "joined"))
    links = links.unionByName(held(rest, texts))
    drop(texts)
    comp = cut(connected_components(links, "a", "b"), "joined")
    parted = cut(nodes.join(comp, "node", "left").select("node", "h1", "outline", F.coalesce("component", "node").alias("component")), "parted")
    left = cut(pairs_left(keyed.select("h1", "h2", "text"), parted, least, width), "left")
    if left.limit(1).count():
        texts = texts_of(left)
        first = cut(left.groupBy(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")).agg(F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("p")).select("p.a", "p.b"), "first")
        links = links.unionByName(held(first, texts))
        rest = still_apart(left.select("a", "b").join(first, ["a", "b"], "left_anti"), cut(connected_components(links, "a", "b"), "joined"))
        comp = connected_components(links.unionByName(held(rest, texts)), "a", "b")
        drop(texts)
    named = cut(nodes.join(comp, "node", "left").select("h1", "h2", "least", F.coalesce("component", "node").alias("component")), "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    label = cut(named.join(first, "component").select("h1", "h2", "component_id"), "labels")
    return slim.join(label, ["h1", "h2"]).select("doc_id", "component_id")


def keep_similar(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``docs``, with their columns, of one document of each component of ``similar_components``: that of the least doc_id.

    Rows that repeat a doc_id: one of them stays, the first by text. Rows
    without a doc_id can't stand for a component and stay all. An empty table
    gives no rows.
    """
    return _keep(docs, similar_components(docs, least, width))

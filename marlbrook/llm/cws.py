"""Document fingerprints: consistent weighted sampling of word shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Samples of a fingerprint, bits kept of each, words of a shingle.
SAMPLES, SAMPLE_BITS, WIDTH = 64, 16, 5
#: Rows of the tables of gamma and uniform variates; a term takes its variates from two rows that separate bits of its hash choose.
VARIATES = 1 << 13
SEED = 20240611
#: Stretches of doc_id for each partition: some in each even out what hashing deals to it.
STRETCHES = 8
#: Terms whose samples are compared at once, and words whose hash a worker holds.
SLICE, HELD_WORDS = 1 << 12, 500_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Sampler:
    """Weighted terms -> signature.

    For sample k a term of weight w draws r, c from Gamma(2, 1) and b from
    U(0, 1), takes t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y
    exp(r)); the term of the least a, with its t, is the sample. Two weighted
    sets give the same sample with probability sum of minima over sum of maxima
    of their weights.
    """

    def __init__(self) -> None:
        rng = np.random.Generator(np.random.PCG64(SEED))
        shape = (VARIATES, SAMPLES)
        self.ln_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.b = rng.random(shape).astype(np.float32)
        self.once = (self.r * (1 - self.b)).astype(np.float32)  # ln a = ln c - once for weight 1, for which t = 0
        self.words: dict[str, int] = {}

    def terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 64-bit hashes of the shingles of a text and how often each occurs; fewer words: the whole sequence."""
        words = _WORD.findall(text)
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = self.words
        if len(held) > HELD_WORDS:
            held.clear()
        for w in set(words).difference(held):
            held[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - WIDTH + 1)
        out = np.zeros(n, np.uint64)
        for i in range(min(WIDTH, len(h))):
            out = (out ^ h[i : i + n]) * _MIX[i]
            out ^= out >> np.uint64(29)
        return np.unique(out, return_counts=True)

    def signature(self, text: str) -> np.ndarray:
        """SAMPLES numbers of SAMPLE_BITS bits; a text without words has zeros."""
        h, n = self.terms(text)
        if not len(h):
            return np.zeros(SAMPLES, np.uint16)
        i, j = (h & np.uint64(VARIATES - 1)).astype(np.int64), (h >> np.uint64(20) & np.uint64(VARIATES - 1)).astype(np.int64)
        least, which, tick = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
        cols = np.arange(SAMPLES)
        often = np.flatnonzero(n > 1)
        single = np.flatnonzero(n == 1) if len(often) else None
        for at in range(0, len(h) if single is None else len(single), SLICE):
            part = slice(at, at + SLICE) if single is None else single[at : at + SLICE]
            ln_a = self.ln_c[i[part]]
            ln_a -= self.once[j[part]]
            best = ln_a.argmin(0)
            low = ln_a[best, cols]
            new = low < least
            least[new], which[new] = low[new], (best + at if single is None else single[at + best])[new]
        for at in range(0, len(often), SLICE):
            part = often[at : at + SLICE]
            r, b = self.r[j[part]], self.b[j[part]]
            t = np.floor(np.log(n[part])[:, None] / r + b)
            ln_a = self.ln_c[i[part]] - r * (t - b) - r
            best = ln_a.argmin(0)
            low = ln_a[best, cols].astype(np.float32)
            new = low < least
            least[new], which[new], tick[new] = low[new], part[best][new], t[best, cols][new].astype(np.int64)
        s = (h[which] ^ (tick.astype(np.uint64) * _MIX[1]) ^ (cols.astype(np.uint64) * _MIX[2])) * _MIX[0]
        s ^= s >> np.uint64(32)
        return (s * _MIX[3] >> np.uint64(64 - SAMPLE_BITS)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, without those that 16 bits let agree by chance: the estimate of generalised Jaccard similarity, 0 to 1."""
    chance = 2.0**-SAMPLE_BITS
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


_SAMPLER: list[Sampler] = []


def sampler() -> Sampler:
    """The worker's sampler; its tables are the same everywhere."""
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def edited(text: str, following: str) -> str:
    """The last third of a text's code points replaced by as many first ones of the next text, or all of it."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m] if m else text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (stretch, place): each is compared with the next of its stretch; the last of a stretch only lends its text."""
    import hashlib

    s = sampler()
    held = None  # stretch, doc_id, text, signature
    for batch in batches:
        rows: list[tuple] = []
        for stretch, key, text, lends in zip(*(batch.column(c).to_pylist() for c in ("stretch", "doc_id", "text", "lends"))):
            text = text or ""
            sig = s.signature(text)
            if held is not None and held[0] == stretch:
                _, k, t, own = held
                e = edited(t, text)
                es = own if e == t else s.signature(e)
                rows.append((k, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(es), likeness(own, es), likeness(own, sig)))
            held = None if lends else (stretch, key, text, sig)
        if rows:
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])


def _stretch(ids: pa.Array, bounds: list[int]) -> np.ndarray:
    """Stretch 0 holds the ids above bounds[0], the next those above bounds[1], ...; null ids stand in the last."""
    got = np.searchsorted(-np.array(bounds, np.int64), -ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(bounds) + 1, got).astype(np.int32)


def _placed(bounds: list[int]):
    return F.arrow_udf(lambda ids: pa.array(_stretch(ids, bounds), pa.int32()), IntegerType())


def _lent(bounds: list[int], first: dict[int, int | None]):
    used = sorted(first)
    before = {b: a for a, b in zip(used, used[1:])} | {used[0]: used[-1]}

    def lend(ids: pa.Array) -> pa.Array:
        return pa.array([before[k] if first[k] == i else None for k, i in zip(_stretch(ids, bounds).tolist(), ids.to_pylist())], pa.int32())

    return F.arrow_udf(lend, IntegerType())


def fingerprint_documents(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` with its fingerprint, that of its edited text, and their likeness.

    The next document is the one of the next smaller doc_id; after the least
    comes the greatest, the first. Rows that share a doc_id follow each other
    by text; rows with a null doc_id come last. A null text counts as an empty
    one; a text without words has a fingerprint of zeros, so two such texts are
    alike. One row alone is its own next. An empty table gives no rows.

    Texts are dealt once, by stretches of doc_id; the first row of a stretch is
    also lent to the stretch before it. A task streams through its stretches
    and holds one text besides the batch.
    """
    spark = docs.sparkSession
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    n = stretches or min(parts * STRETCHES, 100_000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = rows.select("doc_id").where("doc_id is not null")
    # bounds of about equal rows; one number for each stretch reaches the driver
    probs = [k / n for k in range(1, n)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, probs)), F.lit(min(10 * n, 100_000)))).first()[0] or []), reverse=True)
    placed = rows.withColumn("stretch", _placed(bounds)("doc_id"))
    first = {r["stretch"]: r["m"] for r in placed.select("stretch", "doc_id").groupBy("stretch").agg(F.max("doc_id").alias("m")).collect()}
    if not first:
        return spark.createDataFrame([], OUT)
    # the first rows of each stretch (several if they share the id) go to the stretch before too, where the first of them is read
    own = F.struct(F.col("stretch").alias("s"), F.lit(False).alias("l"))
    lent = F.struct(F.col("to").alias("s"), F.lit(True).alias("l"))
    both = placed.withColumn("to", _lent(bounds, first)("doc_id")).withColumn("copy", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    dealt = both.select(F.col("copy.s").alias("stretch"), F.col("copy.l").alias("lends"), "doc_id", "text").repartition(parts, "stretch")
    return dealt.sortWithinPartitions(F.col("stretch"), F.col("lends"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()).mapInArrow(_compare, OUT)

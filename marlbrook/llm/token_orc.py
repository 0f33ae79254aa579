"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marlbrook.llm.units import ROUND_BYTES, WORD_UNITS, balanced, unit_ids
from marlbrook.shared import new_path

SCHEMA = "doc_id long, part int, local_start long, n_tokens int, ids array<int>"
#: Stripes hold about so many bytes and are read in parallel; a row index entry and a Bloom filter stand for each stride of rows.
ORC = {"orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "SPEED", "compression": "lz4"}


def _encoder(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, start = unit_ids(path, WORD_UNITS, fold=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, at = batch.column(0), 0
            for run in balanced([t or "" for t in batch.column(1).to_pylist()], ROUND_BYTES):
                ids, lens = table.encode(run)
                ends = np.cumsum(lens)
                ids, lens = np.insert(ids, ends, end_id).astype(np.int32), lens + 1  # the end id after each text
                ends = np.cumsum(lens)
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()))
                n = len(run)
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), pa.array(np.full(n, part), pa.int32()), pa.array(start + ends - lens, pa.int64()), pa.array(lens, pa.int32()), out], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
                at, start = at + n, start + int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids as ORC under ``target``, files and rows in ascending doc_id order.

    Texts are dealt by ranges of doc_id, sorted inside each range, and encoded
    as they stream by; a task holds one batch. ``part`` numbers the ranges,
    ``local_start`` counts the ids before a document inside its range. A null
    text is written as an empty one (the end id alone); rows with a null
    doc_id come first; rows that share a doc_id stay all, in text order. An
    empty table writes a table without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_encoder(path, end_id), SCHEMA).write.options(**ORC).orc(target)


def read_tokens(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of ``write_tokens``; ``doc_ids`` are looked up through file statistics, row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(target)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


@F.arrow_udf(LongType())
def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unsigned crc32 of each list's ids as little-endian unsigned 32-bit integers."""
    for lists in batches:
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def digest(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    The ids before a range come from one pass over two narrow columns: one
    number for each range reaches the driver, and ranges are as many as the
    partitions of the writing job.
    """
    rows = read_tokens(spark, target)
    sums = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in sums:
        offsets.append((r["part"], before))
        before += r["n"]
    parts = spark.createDataFrame(offsets, "part int, before long")
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))


def write_and_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the ids to the shared folder, read the files back and describe them."""
    target = new_path(docs.sparkSession, "ids.orc")
    write_tokens(docs, target, path, end_id)
    return digest(docs.sparkSession, target)

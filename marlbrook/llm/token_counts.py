"""Token counts of whole texts: lengths only, no ids leave the worker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marlbrook.llm.units import BYTE_UNITS, ROUND_BYTES, balanced, unit_ids


def token_length(text: Column, path: str) -> Column:
    """Tokens of ``text`` under a byte-level BPE file of the tokenizers library; a null text has none.

    An Arrow function over batches of texts. A batch is dealt into rounds of
    about equal bytes, and a text is cut into units where no token can cross
    (see ``units``), so a text of many megabytes needs no more memory than its
    units. Special strings inside a text are handled as the file says.
    """

    @F.arrow_udf(LongType())
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = unit_ids(path, BYTE_UNITS)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            found = [table.lengths(run) for run in balanced(texts, ROUND_BYTES)]
            yield pa.array(np.concatenate(found) if found else [], pa.int64())

    return lengths.asNondeterministic()(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs(doc_id, text)``.

    Null and empty texts: 0 bytes, 0 tokens, within the limit. Repeated rows
    and equal texts are counted each. An empty table gives no rows; other
    columns are left out. No shuffle: one pass over the scan.
    """
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), token_length(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

import random

import pytest
import public_tokenizers

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
#: Names that operators use themselves, for tables with columns that clash.
CLASH = {c: 1 for c in ("score", "size", "bits", "key", "node", "id", "x", "copies", "prob", "row", "component", "_m", "_p", "shard", "slot", "target", "filters", "stretch", "lends", "position", "_quality")}


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_docs(rng: random.Random, n: int = 60) -> list[tuple]:
    """Rows with nulls, empty, blank, very long and equal texts, repeated rows, and sources of one and many rows."""
    rows = [(i, words(rng, rng.randint(1, 60)), "en", f"s{i % 4}" if i % 9 else None, None) for i in range(n)]
    long = words(rng, 30_000)
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s1", 0), (n + 3, long, "en", "s2", 5), (n + 4, long, "en", "s2", 5), (n + 5, "a" * 100_000, "en", "s0", 1), (n + 6, "é日本😀\n" * 50, "xx", "s0", 1)]
    return rows + [rows[3], rows[3], rows[n + 1]]


@pytest.fixture(scope="session")
def docs_rows():
    return odd_docs(random.Random(11))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide_docs(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(v) for c, v in CLASH.items()})

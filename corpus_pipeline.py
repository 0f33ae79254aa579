"""The corpus pipeline: four stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlbrook.llm import mixing, quality_crf, simhash_trie, sp_sample
from marlbrook.llm.queries import table, tokenizer
from marlbrook.shared import new_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier of ``labels`` does not reject."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id: texts whose 5-word shingles are 0.8 or more alike."""
    return simhash_trie.keep_similar(docs, least=0.8, width=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a document of no copies goes."""
    return mixing.mix(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their ids."""
    return sp_sample.sample_pieces(docs, tokenizer("piece_bpe_32k.model"), k=2, with_ids=True)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("mixing sources", mix), ("SentencePiece sampling", segment)]

#: Models, sampling and tokenizers are not SQL; tests hold the pipeline against its parts.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs

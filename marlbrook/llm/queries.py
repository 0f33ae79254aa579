"""One query for each operator of this package, over its whole table and with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.quality_crf import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


@query
def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.token_orc import write_and_digest

    return write_and_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


@query
def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.simhash_trie import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), budget=4)


@query
def op5_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.cws import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op10_sp_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.sp_sample import sample_pieces

    return sample_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), k=2, with_ids=False)


@query
def op9_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.caps import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.95)


@query
def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlbrook.llm.quotes import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


def _oracle() -> None:
    from marlbrook.llm import quotes

    ORACLE["op7_quotes"] = quotes.SQL


_oracle()

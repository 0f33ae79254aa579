"""The corpus model over the driver's tables: skills, notes, usage and their kin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _identifier(c: str):
    return F.concat(F.lit("doc-"), F.lpad(F.col(c).cast("string"), 10, "0"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as bundles; some optional fields are null, as they are in a crawl."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        _identifier("doc_id").alias("identifier"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("name"),
        F.when(i % 7 != 0, F.substring("text", 1, 160)).alias("description"),
        F.when(i % 13 == 0, "unknown").otherwise(F.concat((1 + i % 3).cast("string"), F.lit("."), (i % 4).cast("string"), F.lit("."), (i % 2).cast("string"))).alias("version"),
        F.when(i % 5 != 0, F.col("source")).alias("author"),
        F.when(i % 11 != 0, F.col("lang")).alias("category"),
        F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("tags"),
        F.col("text").alias("skill_md_text"),
        F.col("n_chars").alias("zip_size"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n_entries"),
        F.lit(1).alias("has_skill_md"),
        i.alias("doc_id"),
    )


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``skills`` with the fields that only an index has."""
    i = F.col("doc_id")
    return skills(spark, sf_dir).withColumns({"sha256": F.when(i % 17 != 0, F.sha2("skill_md_text", 256)), "license": F.when(i % 6 == 0, "MIT").when(i % 6 == 1, ""), "homepage": F.when(i % 10 == 0, F.concat(F.lit("https://example.org/"), i.cast("string"))), "discovered_at": F.when(i % 19 != 0, "2024-01-01T00:00:00Z")})


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each document, some without a raw object, some that are no JSON."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, "{}").when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"id":'), i, F.lit("}"))).otherwise(F.concat(F.lit('{"id":'), i, F.lit(',"lang":"'), F.col("lang"), F.lit('"}')))
    return d.select("doc_id", F.when(F.col("doc_id") % 9 == 0, "no json").otherwise(F.concat(F.lit('{"version":"1","raw":'), raw, F.lit("}"))).alias("manifest"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("note_id"), _identifier("conv_id").alias("skill_identifier"), F.col("role").alias("source"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("usage_count"), F.count_if(F.col("event_type") == "purchase").alias("download_count"), F.count_if(F.col("event_type") == "click").alias("click_count")).select(_identifier("user_id").alias("skill_identifier"), "usage_count", "download_count", "click_count")


def scored_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with titles and bodies that hold what the scorers look for, since the plain texts hold none of it."""
    i, n = F.col("doc_id"), F.lit("\n")
    body = F.concat(
        F.when(i % 2 == 0, F.replace("skill_md_text", n, F.lit("\n## "))).otherwise(F.col("skill_md_text")),
        F.when(i % 3 == 0, F.concat(n, F.repeat(F.lit("```\nx\n```\n"), (1 + i % 4).cast("int")))).otherwise(""),
        F.when(i % 5 == 0, F.repeat(F.lit(" {slot} [填入]"), (i % 4).cast("int"))).otherwise(""),
    )
    title = F.concat("name", F.when(i % 9 == 0, " 一键生成 爆款").when(i % 9 == 1, " 3步 5分钟").when(i % 9 == 2, " 独家首发 最强").otherwise(""))
    return skills(spark, sf_dir).withColumns({"body": body, "title": title})


#: The same tables for DuckDB.
SKILLS_SQL = """skills AS (
  SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS identifier, split_part(text, chr(10), 1) AS name,
    CASE WHEN doc_id % 7 <> 0 THEN substr(text, 1, 160) END AS description,
    CASE WHEN doc_id % 13 = 0 THEN 'unknown' ELSE (1 + doc_id % 3) || '.' || (doc_id % 4) || '.' || (doc_id % 2) END AS version,
    CASE WHEN doc_id % 5 <> 0 THEN source END AS author, CASE WHEN doc_id % 11 <> 0 THEN lang END AS category,
    CASE WHEN doc_id % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, source] END AS tags,
    text AS skill_md_text, n_chars AS zip_size, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS n_entries, 1 AS has_skill_md, doc_id
  FROM documents)"""
INDEXED_SQL = (
    SKILLS_SQL
    + """, indexed AS (
  SELECT *, CASE WHEN doc_id % 17 <> 0 THEN sha256(skill_md_text) END AS sha256, CASE doc_id % 6 WHEN 0 THEN 'MIT' WHEN 1 THEN '' END AS license,
    CASE WHEN doc_id % 10 = 0 THEN 'https://example.org/' || doc_id END AS homepage, CASE WHEN doc_id % 19 <> 0 THEN '2024-01-01T00:00:00Z' END AS discovered_at
  FROM skills)"""
)
NOTES_SQL = "notes AS (SELECT conv_id || '-' || turn AS note_id, 'doc-' || lpad(CAST(conv_id AS VARCHAR), 10, '0') AS skill_identifier, role AS source FROM conversations)"
USAGE_SQL = "usage AS (SELECT 'doc-' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS skill_identifier, count(*) AS usage_count, count(*) FILTER (event_type = 'purchase') AS download_count, count(*) FILTER (event_type = 'click') AS click_count FROM events GROUP BY user_id)"
SCORED_SQL = (
    SKILLS_SQL
    + """, scored AS (
  SELECT *, CASE WHEN doc_id % 2 = 0 THEN replace(skill_md_text, chr(10), chr(10) || '## ') ELSE skill_md_text END
    || CASE WHEN doc_id % 3 = 0 THEN chr(10) || repeat('```' || chr(10) || 'x' || chr(10) || '```' || chr(10), 1 + doc_id % 4) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN repeat(' {slot} [填入]', doc_id % 4) ELSE '' END AS body,
    name || CASE doc_id % 9 WHEN 0 THEN ' 一键生成 爆款' WHEN 1 THEN ' 3步 5分钟' WHEN 2 THEN ' 独家首发 最强' ELSE '' END AS title
  FROM skills)"""
)

"""Row-wise scores of titles and bodies: sensational titles, robustness of a bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlbrook.functions.text import version_part, whole
from marlbrook.operators.order import at_rank, ranked_values, with_total

# The word lists, patterns and weights of the scores.
EMOTION_WORDS = ["爆款", "震惊", "必看", "绝了", "一键", "秒变", "神器", "全网首发", "独家", "揭秘", "颠覆", "炸裂", "神级", "天花板", "封神", "绝绝子", "yyds", "救命", "一键生成", "秒杀", "彻底改变", "革命性"]
NUMBER_UNITS = ["步", "分钟", "个", "天", "倍", "招", "款"]
SUPERLATIVES = ["最好", "最强", "全网", "首发", "第一", "顶级", "最全", "最新", "首发", "独家首发"]
PLACEHOLDER = r"(?d)\[填入\]|\[填写\]|\[.*?\]|\{替换\}|\{.*?\}|<.*?>"
WEIGHTS = {"emotional": 0.20, "numbers": 0.15, "superlatives": 0.15, "title_body_ratio": 0.20, "template_placeholder": 0.15, "thin_wrapper": 0.15}


def _found(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (c.contains(w).cast("int") for w in words))


def _capped(n: Column, of: float) -> Column:
    return F.bround(F.least(n / F.lit(of), F.lit(1.0)), 3)


def sensational(texts: DataFrame) -> DataFrame:
    """identifier, name, body_len, title_len, six scores and their weighted sum for ``texts(identifier, title, description, body)``."""
    title, body = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    both = F.concat(title, F.lit(" "), F.coalesce("description", F.lit("")))
    t, b = F.length(title).cast("bigint"), F.length(body).cast("bigint")
    holes = F.regexp_count(body, F.lit(PLACEHOLDER))
    plain = ~body.contains("##")
    scores = {
        "emotional": _capped(_found(both, EMOTION_WORDS), 3.0),
        "numbers": _capped(reduce(lambda x, y: x + y, (both.rlike(rf"(?U)\d+{u}").cast("int") for u in NUMBER_UNITS)) * 0.5, 1.0),
        "superlatives": _capped(_found(both, SUPERLATIVES), 2.0),
        "title_body_ratio": F.when((t > 30) & (b < 200), 1.0).when((t > 25) & (b < 400), 0.5).when((t > 20) & (b < 100), 1.0).otherwise(0.0),
        "template_placeholder": F.when(holes > 5, 1.0).when(holes > 2, 0.5).otherwise(0.0),
        "thin_wrapper": F.when(b < 100, 1.0).when((b < 200) & plain, 0.7).when((b < 300) & plain & ~body.contains("```"), 0.4).otherwise(0.0),
    }
    out = texts.select("identifier", F.col("title").alias("name"), b.alias("body_len"), t.alias("title_len"), *(s.alias(k) for k, s in scores.items()))
    return out.withColumn("composite", F.bround(reduce(lambda x, y: x + y, (F.col(k) * w for k, w in WEIGHTS.items())), 3))


def robustness(texts: DataFrame) -> DataFrame:
    """identifier, name, version, body_len, n_entries, five scores and their mean for ``texts(identifier, title, version, body, n_entries)``."""
    body = F.coalesce("body", F.lit(""))
    n, b = F.coalesce(F.nullif("n_entries", F.lit(0)), F.lit(1)), F.length(body).cast("bigint")
    heads, fences = F.regexp_count(body, F.lit(r"(?mdU)^##\s+")), F.floor(F.regexp_count(body, F.lit("```")) / 2)
    major = whole(version_part(F.col("version"), 0))
    minor = F.when(version_part(F.col("version"), 1).isNull(), F.lit(0)).otherwise(whole(version_part(F.col("version"), 1)))
    scores = {
        "sections": F.when(heads >= 5, 1.0).when(heads >= 3, 0.7).when(heads >= 1, 0.3).otherwise(0.0),
        "code_examples": F.when(fences >= 3, 1.0).when(fences >= 1, 0.5).otherwise(0.0),
        "body_length": F.when(b > 5000, 1.0).when(b > 2000, 0.6).when(b > 1000, 0.3).otherwise(0.0),
        "zip_complexity": F.when(n > 10, 1.0).when(n > 5, 0.7).when(n > 1, 0.3).otherwise(0.0),
        "version_maturity": F.when(major.isNull() | minor.isNull(), 0.0).when(major > 1, 1.0).when((major == 1) & (minor > 0), 0.5).otherwise(0.0),
    }
    out = texts.select("identifier", F.col("title").alias("name"), "version", b.alias("body_len"), n.alias("n_entries"), *(s.alias(k) for k, s in scores.items()))
    return out.withColumn("composite", F.bround(reduce(lambda x, y: x + y, map(F.col, scores)) / len(scores), 3))


def score_distribution(scores: DataFrame, column: str = "composite") -> DataFrame:
    """One row: n, mean, upper median, max, and how many are at least 0.5 and 0.7."""
    r = with_total(ranked_values(scores, column))
    at_least = lambda x: F.coalesce(F.sum(F.when(F.col("value") >= x, F.col("n"))), F.lit(0))
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), 4).alias("mean"), at_rank(r, F.expr("total div 2")).alias("median"), F.max("value").alias("max"), at_least(0.5).alias("ge_05"), at_least(0.7).alias("ge_07"))


def by_entries(scores: DataFrame) -> DataFrame:
    """bucket, n, min, q1, median, q3, max of the composite by number of files."""
    n = F.col("n_entries")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("11+")
    q = F.expr("percentile(composite, array(0.0D, 0.25D, 0.5D, 0.75D, 1.0D))")
    out = scores.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), q.alias("q"))
    return out.select("bucket", "n", *(F.round(F.col("q")[i], 4).alias(name) for i, name in enumerate(("min", "q1", "median", "q3", "max"))))


def trend(scores: DataFrame) -> DataFrame:
    """n, slope, intercept of the composite over log10 of the body length, cut at 50 000."""
    x = F.log10(F.least(F.col("body_len"), F.lit(50000)).cast("double"))
    return scores.where("body_len > 0").agg(F.count("*").alias("n"), F.round(F.regr_slope("composite", x), 4).alias("slope"), F.round(F.regr_intercept("composite", x), 4).alias("intercept"))

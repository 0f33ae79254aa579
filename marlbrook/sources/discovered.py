"""What a crawl has found: a JSON object keyed by identifier, seed lists, and their merging."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<identifier:string,name:string,description:string,version:string,tags:array<string>,author:string>"
#: What is swept with by default. The words are fixed values: fewer would find fewer bundles.
SWEEP_CHARACTERS = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [str(d) for d in range(10)]
SWEEP_WORDS = [
    "写", "画", "做", "学", "看", "用", "找", "买", "玩", "聊",
    "ai", "gpt", "文案", "写作", "绘画", "设计", "工具", "助手",
    "小红书", "营销", "运营", "爆款", "笔记", "翻译", "总结",
    "代码", "编程", "效率", "模板", "攻略", "教程", "测评",
]
SWEEP_KEYWORDS = SWEEP_CHARACTERS + SWEEP_WORDS
PAGE_ROWS, MAX_PAGES, MAX_ROUNDS, LEAST_GROWTH = 100, 50, 3, 10


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of a JSON object of records."""
    raw = spark.read.text(path, wholetext=True)
    entries = raw.select(F.explode(F.from_json("value", f"map<string,{RECORD}>")).alias("key", "r"))
    return entries.select(F.coalesce("r.identifier", "key").alias("identifier"), "r.name", "r.description", "r.version", "r.tags", "r.author")


def write_discovered(rows: DataFrame, path: str) -> None:
    """The records as lines of JSON, which any number of tasks can write; ``read.json`` reads them."""
    rows.write.mode("overwrite").json(path)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """identifier of each string of a JSON array."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("identifier")).where("identifier is not null")


def first_wins(*sources: DataFrame) -> DataFrame:
    """Rows of all sources, of each identifier that of the first source that has it."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return rows.groupBy("identifier").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "_rank"]), "_rank").alias("r")).select("r.*")


def pages(fetch: Callable[[int], list[dict]], stop_after_empty: int = 1, most: int | None = MAX_PAGES) -> Iterable[dict]:
    """Rows of a paged listing until a page is not full or ``stop_after_empty`` pages in a row are empty; at most ``most`` pages, None for no bound."""
    empty = 0
    for page in count(1) if most is None else range(1, most + 1):
        rows = fetch(page)
        yield from rows
        empty = empty + 1 if not rows else 0
        if empty >= stop_after_empty or rows and len(rows) < PAGE_ROWS:
            return


def sweep(keywords: list[str], search: Callable[[str, int], list[dict]], found: dict[str, dict] | None = None) -> dict[str, dict]:
    """Search every keyword, round after round, until a round adds fewer than LEAST_GROWTH identifiers."""
    found = dict(found or {})
    for _ in range(MAX_ROUNDS):
        before = len(found)
        for word in keywords:
            for row in pages(lambda p, w=word: search(w, p)):
                if row.get("identifier"):
                    found.setdefault(row["identifier"], row)
        if len(found) - before < LEAST_GROWTH:
            break
    return found

#: A listing of fewer rows is swept as well.
FEW = 100


class CookieInvalid(RuntimeError):
    """The service refuses the cookie."""


def refused(message: str) -> bool:
    """Whether an error's text says that the cookie is not accepted."""
    return any(s in message for s in ("401", "403", "无登录", "未登录"))


def listed(fetch: Callable[[int], list[dict]]) -> dict[str, dict]:
    """All rows of a listing by identifier, the first of each; a refused cookie raises, another error ends the listing with what it has."""
    found: dict[str, dict] = {}
    try:
        for row in pages(fetch, stop_after_empty=2, most=None):
            if row.get("identifier"):
                found.setdefault(row["identifier"], row)
    except Exception as e:
        if refused(str(e)):
            raise CookieInvalid(str(e)) from e
    return found


def discover(listing: Callable[[int], list[dict]] | None, search: Callable[[str, int], list[dict]], keywords: list[str] | None = None) -> dict[str, dict]:
    """The listing if there is one and its cookie holds, merged with a sweep if it is short; else the sweep alone."""
    found: dict[str, dict] = {}
    if listing is not None:
        try:
            found = listed(listing)
        except CookieInvalid:
            found = {}
    return found if len(found) >= FEW else sweep(keywords or SWEEP_KEYWORDS, search, found)

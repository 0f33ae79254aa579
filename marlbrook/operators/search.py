"""Full-text search over bundles: trigram matching, BM25 ranking, substring fallback, filters, engagement."""

from __future__ import annotations

import itertools
import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlbrook.functions.text import filled, like, like_part, occurrences, trigrams
from marlbrook.plans.match import MatchSyntaxError, Node, Phrase, parse, phrases

#: Column of the index -> column of the table.
COLUMNS = {"name": "name", "description": "description", "body": "skill_md_text"}
#: Fixed values of the ranking function.
K1, B = 1.2, 0.75


def _folded(table: DataFrame) -> DataFrame:
    return table.withColumns({f"_{c}": F.lower(F.coalesce(F.col(t), F.lit(""))) for c, t in COLUMNS.items()})


def _columns(p: Phrase) -> list[str]:
    return [c for c in COLUMNS if p.columns is None or c in p.columns]


def _holds(p: Phrase, c: str) -> Column:
    """A column holds a phrase, or starts with it if that is asked for."""
    folded = F.col(f"_{c}")
    return folded.startswith(p.text.lower()) if p.initial else folded.contains(p.text.lower())


def predicate(tree) -> Column | None:
    """Rows that a query matches, over ``_folded``; None if nothing of it can be looked for."""
    if isinstance(tree, Phrase):
        hits = [_holds(tree, c) for c in _columns(tree)]
        return reduce(or_, hits, F.lit(False)) if tree.searchable else None
    if tree.op == "near":
        terms = [p for p in tree.parts if p.searchable]
        if len(terms) < 2:
            return predicate(terms[0]) if terms else None
        gap = f".{{0,{max(0, tree.distance - 2)}}}"
        pattern = "(?s)" + "|".join(gap.join(re.escape(p.text.lower()) for p in order) for order in itertools.permutations(terms))
        return reduce(or_, (F.col(f"_{c}").rlike(pattern) for c in _columns(terms[0])), F.lit(False))
    parts = [predicate(t) for t in tree.parts]
    if tree.op == "not":
        return parts[0] if parts[0] is None or parts[1] is None else parts[0] & ~parts[1]
    known = [p for p in parts if p is not None]
    return reduce(and_ if tree.op == "and" else or_, known) if known else None


def _counts(ps: list[Phrase]) -> dict[str, Column]:
    return {f"_f{i}": reduce(lambda a, b: a + b, (_holds(p, c).cast("int") if p.initial else occurrences(F.col(f"_{c}"), p.text.lower()) for c in _columns(p)), F.lit(0)) for i, p in enumerate(ps)}


def match(table: DataFrame, query: str) -> DataFrame:
    """Rows that match, with ``score``: the BM25 rank, lower is better.

    One pass gathers the number of rows, their mean length and how many rows
    hold each phrase (a few numbers); a second scans, filters and scores. A
    query of which nothing can be looked for matches no row.
    """
    tree = parse(query, tuple(COLUMNS))
    keep, wanted = predicate(tree), list(dict.fromkeys(phrases(tree)))
    if keep is None:
        return table.withColumn("score", F.lit(0.0)).where(F.lit(False))
    length = reduce(lambda a, b: a + b, (F.greatest(F.length(f"_{c}") - 2, F.lit(0)) for c in COLUMNS))
    rows = _folded(table).withColumn("_dl", length)
    counts = _counts(wanted)
    holds = [reduce(or_, (_holds(p, c) for c in _columns(p)), F.lit(False)) for p in wanted]
    n, mean, *df = rows.agg(F.count("*"), F.avg("_dl"), *(F.count_if(h) for h in holds)).first()
    score = F.lit(0.0)
    for f, k in zip(counts, df):
        idf = max(math.log((n - k + 0.5) / (k + 0.5)), 1e-6) if n else 0.0
        if idf == 1e-6 or n and math.log((n - k + 0.5) / (k + 0.5)) <= 0:
            idf = 1e-6
        tf = F.col(f).cast("double")
        score = score - F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.lit(mean or 1.0)))
    found = rows.where(keep).withColumns(counts).withColumn("score", score)
    return found.drop("_dl", *counts, *(f"_{c}" for c in COLUMNS))


def fallback(table: DataFrame, query: str) -> DataFrame:
    """Rows with the query as a substring of name, description or identifier; ``rank`` says where it was found first."""
    hit = {c: F.coalesce(like_part(F.col(c), query), F.lit(False)) for c in ("identifier", "name", "description")}
    rank = F.when(hit["identifier"], 0).when(hit["name"], 1).otherwise(2)
    return table.where(reduce(or_, hit.values())).withColumn("score", F.lit(0.0)).withColumn("rank", rank)


def with_metrics(rows: DataFrame, notes: DataFrame, usage: DataFrame) -> DataFrame:
    """``rows`` with note_count (0 without notes) and usage_count (null without usage). Notes are counted before the join."""
    counted = notes.groupBy(F.col("skill_identifier").alias("identifier")).agg(F.count("*").alias("note_count"))
    used = usage.select(F.col("skill_identifier").alias("identifier"), "usage_count")
    return rows.join(counted, "identifier", "left").join(used, "identifier", "left").withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def tag_like(tag: str) -> Column:
    """The tag in the JSON text of the tags: ASCII case does not matter, % and _ are wildcards."""
    return like(F.to_json("tags"), f'%"{tag}"%')


class Search:
    """``Search(skills).text(...).author(...).tag(...).limit(...).run()``: text and filters compose."""

    def __init__(self, table: DataFrame, notes: DataFrame | None = None, usage: DataFrame | None = None):
        self.table, self.notes, self.usage = table, notes, usage
        self.query, self.n, self.conditions = None, 20, []

    def text(self, query: str) -> Search:
        self.query = query.strip()
        return self

    def author(self, part: str) -> Search:
        self.conditions.append(like_part(F.col("author"), part))
        return self

    def category(self, part: str) -> Search:
        self.conditions.append(like_part(F.col("category"), part))
        return self

    def tag(self, tag: str, exact: bool = False) -> Search:
        self.conditions.append(F.array_contains("tags", tag) if exact else tag_like(tag))
        return self

    def identifier(self, identifier: str) -> Search:
        self.conditions.append(F.col("identifier") == identifier)
        return self

    def limit(self, n: int) -> Search:
        self.n = n
        return self

    def run(self) -> DataFrame:
        """The best rows in order. Three characters and more are matched, ranks being those of the whole corpus; what is no query, or is shorter, is a substring."""
        fields = ["identifier", "name", "description", "author", "category", "version", "zip_size", "score"]
        kept = reduce(and_, self.conditions, F.lit(True))
        order = [F.col("name").asc_nulls_first(), F.col("identifier")]
        if self.query is None:
            found = self.table.withColumn("score", F.lit(0.0))
        else:
            try:
                if len(self.query) < 3:
                    raise MatchSyntaxError("too short for the index")
                found, order = match(self.table, self.query), [F.col("score"), F.col("identifier")]
            except MatchSyntaxError:
                found, order = fallback(self.table, self.query), [F.col("rank"), F.length("description").asc_nulls_first(), F.col("identifier")]
        top = found.where(kept).orderBy(*order).limit(self.n)
        if self.notes is None:
            return top.select(*fields)
        return with_metrics(top, self.notes, self.usage).orderBy(*order).select(*fields, "note_count", "usage_count")


class TrigramIndex:
    """Postings (gram, identifier) on disk, sorted by gram, for corpora that are searched again and again."""

    def __init__(self, path: str):
        self.path = path

    def build(self, table: DataFrame) -> None:
        grams = F.array_distinct(F.flatten(F.array(*(trigrams(F.coalesce(F.col(c), F.lit(""))) for c in COLUMNS.values()))))
        table.select("identifier", F.explode(grams).alias("gram")).repartitionByRange("gram", "identifier").sortWithinPartitions("gram", "identifier").write.mode("overwrite").parquet(self.path)

    def candidates(self, spark, query: str) -> DataFrame:
        """Identifiers that hold all trigrams of a plain word or phrase: a superset of its matches, found without reading texts."""
        q = query.lower()
        grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
        hits = spark.read.parquet(self.path).where(F.col("gram").isin(grams))
        return hits.groupBy("identifier").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("identifier")


def named(table: DataFrame) -> DataFrame:
    return table.where(filled(F.col("name")))


__all__ = ["COLUMNS", "Node", "Search", "TrigramIndex", "fallback", "match", "named", "predicate", "tag_like", "with_metrics"]

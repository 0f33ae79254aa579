"""Data-quality sections: coverage, duplicates, versions, lengths, authors, tags, entries, manifests, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlbrook.functions.text import filled, or_null, percent, strip, version_part, whole
from marlbrook.operators.order import at_rank, prefix_sums, ranked_values, with_total


def field_coverage(skills: DataFrame) -> DataFrame:
    """field, filled, pct of nine fields in one pass."""
    tests: dict[str, Column] = {c: filled(F.col(c)) for c in ("name", "description", "version", "author", "category", "skill_md_text")}
    tests |= {"tags": F.size("tags") > 0, "zip_size": F.col("zip_size") > 0, "n_entries": F.col("n_entries") > 0}
    one = skills.agg(F.count("*").alias("total"), *(F.count_if(t).alias(c) for c, t in tests.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in tests)))
    return one.select("total", pairs.alias("p")).select("p.field", "p.filled", percent(F.col("p.filled"), F.col("total")).alias("pct"))


def name_duplicates(skills: DataFrame, limit: int = 50) -> DataFrame:
    """Names that several bundles share, with their identifiers; the most frequent first. Texts are joined for the reported names only."""
    counts = skills.where(filled(F.col("name"))).groupBy("name").agg(F.count("*").alias("cnt")).where("cnt > 1").orderBy(F.desc("cnt"), "name").limit(limit)
    ids = skills.join(F.broadcast(counts), "name").groupBy("name", "cnt").agg(F.array_join(F.array_sort(F.collect_list("identifier")), ", ").alias("identifiers"))
    return ids.select("name", "cnt", "identifiers")


def name_duplicate_total(skills: DataFrame) -> DataFrame:
    """n_names and n_skills that share a name."""
    return skills.where(filled(F.col("name"))).groupBy("name").agg(F.count("*").alias("cnt")).where("cnt > 1").agg(F.count("*").alias("n_names"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_skills"))


def distribution(df: DataFrame, column: str, as_name: str | None = None) -> DataFrame:
    """Each value of a column, how often it occurs, and its share in percent."""
    counts = df.where(filled(F.col(column).cast("string"))).groupBy(column).agg(F.count("*").alias("cnt"))
    total = F.broadcast(df.where(filled(F.col(column).cast("string"))).agg(F.count("*").alias("total")))
    return counts.crossJoin(total).select(F.col(column).alias(as_name or column), "cnt", percent(F.col("cnt"), F.col("total")).alias("pct"))


def version_major(skills: DataFrame) -> DataFrame:
    """Bundles whose major version is above 1, and their share."""
    major = whole(version_part(F.col("version"), 0))
    return skills.agg(F.count_if(F.coalesce(major > 1, F.lit(False))).alias("n_above_one"), F.count("*").alias("total")).select("n_above_one", percent(F.col("n_above_one"), F.col("total")).alias("pct"))


def version_category(skills: DataFrame) -> DataFrame:
    """1.0.0, 1.0.x, 1.x, 2.x+ or other (a part is no number), and how many bundles each has."""
    v = F.col("version")
    parts = [F.when(version_part(v, i).isNull(), F.lit(0)).otherwise(whole(version_part(v, i))) for i in range(3)]
    a, b, c = parts
    name = F.when(a.isNull() | b.isNull() | c.isNull(), "other").when((a == 1) & (b == 0) & (c == 0), "1.0.0").when((a == 1) & (b == 0), "1.0.x").when(a == 1, "1.x").when(a >= 2, "2.x+").otherwise("other")
    return skills.where(filled(v)).groupBy(name.alias("category")).agg(F.count("*").alias("cnt"))


def body_lengths(skills: DataFrame) -> DataFrame:
    return skills.where(filled(F.col("skill_md_text"))).select("identifier", F.length("skill_md_text").alias("len"))


def body_length_stats(skills: DataFrame) -> DataFrame:
    """One row: count, min, upper median, max, mean cut to an integer, total, and how many are thin (below 200) or rich (above 2000)."""
    r = with_total(ranked_values(body_lengths(skills), "len"))
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.min("value").alias("min"), at_rank(r, F.expr("total div 2")).alias("median"), F.max("value").alias("max"), F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).cast("bigint").alias("mean"), F.sum(F.col("value").cast("bigint") * F.col("n")).alias("total"), F.coalesce(F.sum(F.when(F.col("value") < 200, F.col("n"))), F.lit(0)).alias("thin"), F.coalesce(F.sum(F.when(F.col("value") > 2000, F.col("n"))), F.lit(0)).alias("rich"))


def body_length_deciles(skills: DataFrame) -> DataFrame:
    """decile, low, high, cnt: the values at ranks n*i/10, and the rows between two of them, both ends counted."""
    r = with_total(ranked_values(body_lengths(skills), "len"))
    rank = lambda i: F.least(F.floor(F.col("total") * i / 10), F.col("total") - 1)
    ends = r.agg(*(at_rank(r, rank(i)).alias(f"v{i}") for i in range(11)))
    rows = ends.select(F.explode(F.array(*(F.struct(F.lit(i + 1).alias("decile"), F.col(f"v{i}").alias("low"), F.col(f"v{i + 1}").alias("high")) for i in range(10)))).alias("d")).select("d.*")
    # ten rows against the distinct lengths
    return r.join(F.broadcast(rows), (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))).groupBy("decile", "low", "high").agg(F.sum("n").alias("cnt"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """n and the element n div 2 of the sorted values: the upper of two middle ones."""
    r = with_total(ranked_values(df, column))
    return r.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), at_rank(r, F.expr("total div 2")).alias("median"))


def gini(counts: DataFrame, column: str = "cnt") -> DataFrame:
    """Concentration of a column's sum over its rows, 0 to 1; 0 for nothing."""
    r = ranked_values(counts, column)
    places = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    s = r.agg(F.sum(F.col("value") * places).alias("w"), F.sum(F.col("value") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return s.select(F.coalesce(F.round(F.try_divide(2 * F.col("w").cast("double"), F.col("n") * F.col("s").cast("double")) - (F.col("n") + 1) / F.col("n"), 4), F.lit(0.0)).alias("gini"), F.coalesce("n", F.lit(0)).alias("n"))


def top_share(counts: DataFrame, tops: tuple[int, ...] = (5, 10, 20, 50), column: str = "cnt") -> DataFrame:
    """top_n, cnt and share in percent of the largest rows. Only as many rows as the largest report wants are ordered."""
    best = counts.orderBy(F.desc(column)).limit(max(tops)).select(column)
    rows = best.withColumn("rn", F.row_number().over(Window.orderBy(F.desc(column))))
    total = counts.agg(F.sum(column).alias("total"))
    sums = rows.agg(*(F.coalesce(F.sum(F.when(F.col("rn") <= n, F.col(column))), F.lit(0)).alias(f"t{n}") for n in tops)).crossJoin(F.broadcast(total))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("top_n"), F.col(f"t{n}").alias("cnt")) for n in tops)))
    return sums.select("total", each.alias("e")).select("e.top_n", "e.cnt", percent(F.col("e.cnt"), F.col("total"), 2).alias("share"))


def lorenz(counts: DataFrame, key: str, column: str = "cnt") -> DataFrame:
    """key, cnt, x_ref ((i-1)/(n-1)), x_correct (i/n) and y (cumulative share), rows ordered by count, then key."""
    rows = prefix_sums(counts.withColumn("_one", F.lit(1)), [F.col(column), F.col(key)], {"before": "_one", "sum_before": column})
    total = F.broadcast(counts.agg(F.count("*").alias("n"), F.sum(column).alias("total")))
    i = F.col("before") + 1
    return rows.crossJoin(total).select(key, column, F.round(F.coalesce(F.try_divide((i - 1).cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0)), 6).alias("x_ref"), F.round(i / F.col("n"), 6).alias("x_correct"), F.round((F.col("sum_before") + F.col(column)) / F.col("total"), 6).alias("y"))


def tag_frequency(skills: DataFrame) -> DataFrame:
    """tag, cnt of the tags, stripped; blank ones are left out."""
    return skills.select(F.explode("tags").alias("t")).select(or_null(strip(F.col("t"))).alias("tag")).where("tag is not null").groupBy("tag").agg(F.count("*").alias("cnt"))


def tag_coverage(skills: DataFrame) -> DataFrame:
    """One row: bundles with tags and their share, different tags, and the most frequent tag."""
    base = skills.agg(F.count("*").alias("total"), F.count_if(F.size("tags") > 0).alias("tagged"))
    f = tag_frequency(skills)
    best = f.agg(F.count("*").alias("unique_tags"), F.min_by("tag", F.struct(-F.col("cnt"), F.col("tag"))).alias("top_tag"), F.max("cnt").alias("top_cnt"))
    return base.crossJoin(F.broadcast(best)).select("tagged", percent(F.col("tagged"), F.col("total")).alias("pct"), "unique_tags", "top_tag", "top_cnt")


def key_frequency(docs: DataFrame, column: str) -> DataFrame:
    """key, cnt over the top-level keys of a JSON column; what is no object has none."""
    return docs.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("cnt"))


def note_coverage(skills: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: notes, bundles with notes, all bundles, and the share."""
    a = notes.agg(F.count("*").alias("n_notes"), F.count_distinct("skill_identifier").alias("n_mapped"))
    return a.crossJoin(F.broadcast(skills.agg(F.count("*").alias("n_skills")))).select("n_notes", "n_mapped", "n_skills", percent(F.col("n_mapped"), F.col("n_skills")).alias("pct"))


def unmapped(skills: DataFrame, notes: DataFrame) -> DataFrame:
    """Bundles without a note."""
    return skills.join(notes.select(F.col("skill_identifier").alias("identifier")).distinct(), "identifier", "left_anti")


def index_stats(skills: DataFrame) -> DataFrame:
    return skills.agg(F.count("*").alias("n_skills"), F.count_if(F.col("has_skill_md") == 1).alias("with_md"), F.coalesce(F.sum("zip_size"), F.lit(0)).alias("total_size"), F.count_distinct("author").alias("n_authors"), F.count_distinct("category").alias("n_categories"))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """bin, cnt of equal-width bins from the least to the greatest value, the last one closed."""
    ends = F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") == F.col("lo"), F.lit(bins // 2)).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1)))
    return df.crossJoin(ends).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


def verify(files: DataFrame, manifests: DataFrame, discovered: DataFrame) -> DataFrame:
    """status, cnt: archives whose sha256 agrees with the manifest's, differs, or has none, and identifiers without an archive.

    ``files(identifier, sha256)``, ``manifests(identifier, sha256)``, ``discovered(identifier)``.
    """
    m = manifests.select("identifier", F.lower("sha256").alias("want"))
    state = F.when(F.col("want").isNull(), "missing_manifest").when(F.col("sha256") == F.col("want"), "ok").otherwise("mismatch")
    have = files.join(m, "identifier", "left").select(state.alias("status"))
    lost = discovered.select("identifier").join(files, "identifier", "left_anti").select(F.lit("missing_zip").alias("status"))
    return have.unionByName(lost).groupBy("status").agg(F.count("*").alias("cnt"))


def coverage(skills: DataFrame) -> DataFrame:
    """place, field, filled, pct of the twelve fields of the index, in one pass; texts count if they are not empty, the others if they are not null."""
    tests: dict[str, Column] = {c: filled(F.col(c)) for c in ("author", "category", "description", "version")}
    tests |= {"tags_json": F.size("tags") > 0, "skill_md_text": filled(F.col("skill_md_text")), "sha256": F.col("sha256").isNotNull()}
    tests |= {c: filled(F.col(c)) for c in ("license", "homepage")}
    tests |= {c: F.col(c).isNotNull() for c in ("n_entries", "zip_size", "discovered_at")}
    one = skills.agg(F.count("*").alias("total"), *(F.count_if(t).alias(c) for c, t in tests.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), F.col(c).alias("filled")) for i, c in enumerate(tests))))
    return one.select("total", pairs.alias("p")).select("p.place", "p.field", "p.filled", percent(F.col("p.filled"), F.col("total")).alias("pct"))


def lowest_coverage(skills: DataFrame, n: int = 3) -> DataFrame:
    """The n fields that fewest bundles fill, the first of equal ones first."""
    return coverage(skills).orderBy("pct", "place").limit(n)


def raw_coverage(skills: DataFrame, manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """One row: manifests, those with a raw object that is not empty, and bundles with a sha256. What is no JSON counts as a manifest without raw."""
    raw = F.get_json_object(column, "$.raw")
    has = F.coalesce(F.size(F.json_object_keys(raw)) > 0, F.lit(False))
    m = manifests.agg(F.count("*").alias("n_manifests"), F.count_if(has).alias("has_raw"))
    k = skills.agg(F.count("*").alias("total"), F.count_if(F.col("sha256").isNotNull()).alias("with_sha"))
    return m.crossJoin(F.broadcast(k))


def raw_fields(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """field, cnt: how many manifests have each key of the raw object."""
    keys = F.explode(F.json_object_keys(F.get_json_object(column, "$.raw")))
    return manifests.select(keys.alias("field")).groupBy("field").agg(F.count("*").alias("cnt"))


def engagement_coverage(skills: DataFrame, notes: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: total, bundles with notes and with usage, and their shares in percent."""
    one = skills.agg(F.count("*").alias("total")).crossJoin(F.broadcast(notes.agg(F.count_distinct("skill_identifier").alias("with_notes")))).crossJoin(F.broadcast(usage.agg(F.count_if(F.col("usage_count").isNotNull()).alias("with_usage"))))
    return one.select("*", percent(F.col("with_notes"), F.col("total")).alias("notes_pct"), percent(F.col("with_usage"), F.col("total")).alias("usage_pct"))


def digest(skills: DataFrame, notes: DataFrame, usage: DataFrame) -> DataFrame:
    """The audit's digest as one row: lowest fields, duplicates of names, author Gini, versions, bodies, tags, engagement, single-file bundles."""
    low = lowest_coverage(skills).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pct", "place", "field"))), lambda x: x["field"]), ",").alias("lowest_fields"))
    length = F.length("skill_md_text")
    base = skills.agg(F.count_if(length < 200).alias("thin_bodies"), F.count_if(length > 2000).alias("rich_bodies"), F.count_if(F.col("n_entries") == 1).alias("single_file"))
    author = gini(skills.where(filled(F.col("author"))).groupBy("author").agg(F.count("*").alias("cnt"))).select(F.col("gini").alias("author_gini"))
    parts = [base, low, name_duplicate_total(skills).select(F.col("n_skills").alias("name_duplicates")), author, version_major(skills).select("n_above_one"), tag_coverage(skills).select("tagged", "unique_tags"), engagement_coverage(skills, notes, usage).select("total", "with_notes", "with_usage")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out

"""Answers of a service: unwrapping, aliases of keys, note ids and usage counts. Built-in JSON expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys that answers use for the same thing, in the order they are tried.
LIST_KEYS = ["results", "items", "list", "skills"]
NOTE_KEYS = ["note_id", "noteId", "note_ids", "post_id", "postId", "post_ids", "related_notes"]
NOTE_ID_KEYS = ["note_id", "id", "post_id", "noteId", "postId"]
USAGE_KEYS = ["usage_count", "usageCount", "use_count", "download_count", "click_count", "call_count", "popularity"]
ALIASES = {"identifier": ["identifier", "id", "skill_id"], "name": ["name", "title"], "description": ["description", "desc"], "author": ["author", "creator"]}


def _get(j: Column, key: str) -> Column:
    return F.get_json_object(j, f"$.{key}")


def unwrap(j: Column) -> tuple[Column, Column]:
    """(inner JSON object, error or null): what stands under data if the answer has data and a code or success; an error if these say so."""
    wrapped = _get(j, "data").isNotNull() & (_get(j, "code").isNotNull() | _get(j, "success").isNotNull())
    bad = wrapped & ((F.coalesce(_get(j, "code"), F.lit("0")) != "0") | (F.coalesce(_get(j, "success"), F.lit("true")) == "false"))
    inner = F.when(wrapped, _get(j, "data")).otherwise(j)
    inner = F.when(inner.startswith("{"), inner).otherwise("{}")
    return F.when(~bad, inner), F.when(bad, F.coalesce(_get(j, "msg"), _get(j, "message"), F.lit("backend error")))


def results(j: Column) -> Column:
    """The first list under results, items, list or skills, of the answer or of its data, as JSON texts of its elements."""
    paths = [k for k in LIST_KEYS] + [f"data.{k}" for k in LIST_KEYS]
    lists = [F.when(_get(j, p).startswith("["), F.from_json(_get(j, p), "array<string>")) for p in paths]
    return F.coalesce(*lists, F.array().cast("array<string>"))


def _first(j: Column, keys: list[str]) -> Column:
    return F.coalesce(*(F.nullif(_get(j, k), F.lit("")) for k in keys), F.lit(""))


def summary(j: Column) -> Column:
    """struct(identifier, name, description, author, tags, version): empty values count as missing."""
    tags = F.coalesce(*(F.nullif(F.from_json(_get(j, k), "array<string>"), F.array().cast("array<string>")) for k in ("tags", "categories")), F.array().cast("array<string>"))
    return F.struct(*(_first(j, keys).alias(name) for name, keys in ALIASES.items()), tags.alias("tags"), _first(j, ["version"]).alias("version"))


def note_ids(j: Column) -> Column:
    """All note ids under the known keys in order: a scalar is one, a list gives its scalars and the first id of its objects. Repeats stay."""
    def of(key: str) -> Column:
        v = _get(j, key)
        many = F.transform(F.from_json(v, "array<string>"), lambda x: F.when(x.startswith("{"), F.coalesce(*(F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in NOTE_ID_KEYS))).otherwise(x))
        one = F.when(v.startswith("["), many).when(v.isNotNull() & (v != "") & ~v.startswith("{"), F.array(v)).otherwise(F.array().cast("array<string>"))
        return F.filter(one, lambda x: x.isNotNull() & (x != ""))

    return F.concat(*(of(k) for k in NOTE_KEYS))


def usage(j: Column) -> Column:
    """map of the usage keys that are present to whole numbers (null: no number)."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), F.try_to_number(_get(j, k), F.lit("999999999999999999")).cast("bigint").alias("v"), _get(j, k).isNotNull().alias("has")) for k in USAGE_KEYS))
    return F.map_from_entries(F.transform(F.filter(entries, lambda e: e["has"]), lambda e: F.struct(e["k"], e["v"])))


def coalesced_usage(u: Column) -> dict[str, Column]:
    """usage_count, download_count, click_count of a usage map: zero counts as missing, but the last alias is taken as it is."""
    def pick(*keys: str) -> Column:
        vs = [F.try_element_at(u, F.lit(k)) for k in keys]
        return reduce(lambda acc, v: F.coalesce(F.nullif(v, F.lit(0)), acc), reversed(vs[:-1]), vs[-1])

    return {"usage_count": pick("usage_count", "usageCount", "use_count"), "download_count": pick("download_count"), "click_count": pick("click_count", "call_count")}


def presence(j: Column, keys: list[str]) -> Column:
    """map of each key to whether a JSON object has it."""
    have = F.json_object_keys(j)
    return F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(F.coalesce(F.array_contains(have, k), F.lit(False)) for k in keys)))

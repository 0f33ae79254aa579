"""Strings as the corpus tools treat them: Unicode strip, ASCII-folding LIKE, trigrams, versions, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; ``trim`` would take blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def or_null(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def fold_ascii(c: Column) -> Column:
    """A to Z in lower case and nothing else, which is what LIKE folds."""
    return F.translate(c, UPPER, LOWER)


def like(c: Column, pattern: str) -> Column:
    """LIKE with ASCII folding; % and _ in the pattern are wildcards and \\ is not an escape."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return fold_ascii(c).like(folded)


def like_part(c: Column, part: str) -> Column:
    return like(c, f"%{part}%")


def trigrams(c: Column, fold: bool = True) -> Column:
    """All overlapping runs of three code points, in order; none for shorter strings."""
    return F.regexp_extract_all(F.lower(c) if fold else c, F.lit(r"(?s)(?=(...))(?=[^\x{DC00}-\x{DFFF}])"), F.lit(1))


def gram_hash(g: Column) -> Column:
    """A hash below 2^31 that every engine with md5 can compute."""
    return F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(2147483647))


def occurrences(c: Column, term: str) -> Column:
    """Overlapping occurrences of a literal."""
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(c, F.lit(f"(?={quoted})"))


def percent(n: Column, total: Column, places: int = 1) -> Column:
    """n of total in percent; 0 of nothing."""
    return F.round(F.coalesce(F.try_divide(n.cast("double") * 100, total.cast("double")), F.lit(0.0)), places)


def percent_text(n: Column, total: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(F.try_divide(n.cast("double") * 100, total.cast("double")), F.lit(0.0)))


def human_size(n: Column) -> Column:
    """Bytes with a unit, ties to even; a question mark for nothing."""
    x = n.cast("double")
    out = F.when(n.isNull() | (n == 0), "?").when(n < 1024, F.format_string("%.0fB", x))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(x / float(1024**power), 1)))
    return out.otherwise(F.format_string("%.1fTB", F.bround(x / float(1024**4), 1)))


def size_in_kb(n: Column) -> Column:
    """Bytes below 1,024, from there on always KB, ties to even; null for nothing."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n >= 1024, F.format_string("%.1fKB", F.bround(n.cast("double") / 1024.0, 1)))


def whole(c: Column) -> Column:
    """A string as an integer, null if it is none; white space around it does not matter."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def version_part(version: Column, i: int) -> Column:
    """Part i of a dotted version, without any v."""
    return F.get(F.split(F.replace(version, F.lit("v"), F.lit("")), "[.]"), F.lit(i))


def safe_name(c: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen; anything else becomes an underscore."""
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}._-]", "_")


def heading_name(text: Column) -> Column:
    """The first line that starts with a single # and a blank, without its marks, at most 200 code points; null if it is empty or there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), strip), lambda x: x.startswith("# "))
    return or_null(F.substring(F.regexp_replace(strip(F.substring(F.get(lines, F.lit(0)), 3, 2**30)), "^[# ]+", ""), 1, 200))


FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n?(.*)\z"


def front_matter(text: Column) -> tuple[Column, Column]:
    """(YAML block or null, body): the block between two lines of three hyphens at the very start."""
    has = text.rlike(FRONT_MATTER)
    return F.when(has, F.regexp_extract(text, FRONT_MATTER, 1)), F.when(has, F.regexp_extract(text, FRONT_MATTER, 2)).otherwise(text)


def find_entry(entries: Column) -> Column:
    """The skill.md of an archive, any case: the one with fewest slashes, then the shortest, then the first."""
    fit = F.filter(entries, lambda n: n.rlike(r"(?i)(^|/)skill\.md$") & ~n.startswith("__MACOSX"))
    ranked = F.transform(fit, lambda n, i: F.struct((F.length(n) - F.length(F.replace(n, F.lit("/"), F.lit("")))).alias("depth"), F.length(n).alias("size"), i.alias("at"), n.alias("name")))
    return F.array_min(ranked)["name"]


def archive_identifier(file_name: Column) -> Column:
    """What stands before the first @ of an archive's name, without .zip."""
    return F.split_part(F.regexp_replace(file_name, r"\.zip$", ""), F.lit("@"), F.lit(1))


def archive_version(file_name: Column) -> Column:
    """What stands between the first @ and the last .zip; null if there is none."""
    return or_null(F.regexp_extract(file_name, r"^[^@]*@(.*)\.zip", 1))

"""``python -m marlbrook.cli --skills PATH [query]``: search a catalogue from the shell."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from marlbrook.operators import audit
from marlbrook.operators.search import Search
from marlbrook.session import session
from marlbrook.sources.sinks import console, markdown


def main(argv: list[str] | None = None) -> str:
    """The first that is given wins: --stats, --list-tags, --show, --identifier, filters, the query."""
    p = argparse.ArgumentParser()
    p.add_argument("query", nargs="?")
    p.add_argument("--skills", required=True, help="Parquet table of the catalogue")
    p.add_argument("--notes")
    p.add_argument("--usage")
    p.add_argument("--author")
    p.add_argument("--category")
    p.add_argument("--tag")
    p.add_argument("--identifier")
    p.add_argument("--show")
    p.add_argument("--list-tags", action="store_true")
    p.add_argument("--stats", action="store_true")
    p.add_argument("-n", "--limit", type=int, default=20)
    a = p.parse_args(argv)
    spark = session()
    skills = spark.read.parquet(a.skills)
    notes, usage = ((spark.read.parquet(x) if x else None) for x in (a.notes, a.usage))
    if a.stats:
        return markdown("Index", {"totals": audit.index_stats(skills), "largest": skills.orderBy(F.desc("zip_size"), "identifier").limit(5).select("identifier", "name", "zip_size")})
    if a.list_tags:
        return "\n".join(f"{r['cnt']:6d}  {r['tag']}" for r in audit.tag_frequency(skills).orderBy(F.desc("cnt"), "tag").toLocalIterator())
    if a.show:
        row = skills.where(F.col("identifier") == a.show).select("skill_md_text").first()
        return row[0] or "" if row else "(no such bundle)"
    s = Search(skills, notes, usage).limit(a.limit)
    if a.identifier:
        return console(s.identifier(a.identifier).run(), a.limit)
    if a.author or a.category or a.tag:
        for name in ("author", "category", "tag"):
            if getattr(a, name):
                getattr(s, name)(getattr(a, name))
        return console(s.run(), a.limit)
    return console(s.text(a.query or "").run(), a.limit)


if __name__ == "__main__":
    print(main())

"""The index as one job: a folder of bundles to the catalogue and its postings, with tallies."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlbrook.operators.search import TrigramIndex
from marlbrook.shared import cut, drop
from marlbrook.sources.bundles import catalogue, read_bundles, read_manifests
from marlbrook.sources.discovered import RECORD, read_discovered
from marlbrook.sources.sinks import current, upsert

STATUSES = ("ok", "no_skill_md", "error")


def build_index(spark: SparkSession, path: str, out: str, found: str | None = None, force: bool = False, limit: int | None = None) -> dict[str, int]:
    """Index the bundles under ``path`` and return the tallies of the run and of the index.

    Each archive is read once, into a table of the shared folder; archives that
    can't be read are tallied and leave the catalogue as it was. Of several
    archives of one identifier the last by path stays. ``found`` is a map of
    what a crawl has found, ``limit`` takes the first archives by path, and
    ``force`` leaves out whatever the index held before. Without archives
    nothing is written.

    A run writes a version of its own, catalogue and postings, so searches of
    the version before go on and a lost run leaves none.
    """
    empty = spark.createDataFrame([], RECORD.removeprefix("struct<").removesuffix(">").replace(":", " "))
    read = cut(read_bundles(spark, path, limit), "bundles")
    counts = {r["status"]: r["count"] for r in read.groupBy("status").count().collect()}
    tally = {"bundles": sum(counts.values()), **{s: counts.get(s, 0) for s in STATUSES}}
    if not tally["bundles"]:
        return tally | {"total": 0, "with_md": 0, "postings": 0}
    rows = catalogue(read, read_manifests(spark, path), read_discovered(spark, found) if found else empty)
    version = upsert(spark, f"{out}/skills", rows.where("status <> 'error'").drop("status", "error"), order="zip_path", fresh=force)
    drop(read)
    table = spark.read.parquet(version)
    postings = TrigramIndex(f"{out}/grams/{version.rpartition('/')[2]}")
    postings.build(table)
    held = table.agg(F.count("*").alias("total"), F.coalesce(F.sum("has_skill_md"), F.lit(0)).alias("with_md")).first()
    return tally | held.asDict() | {"postings": spark.read.parquet(postings.path).count()}


def newest(spark: SparkSession, out: str) -> tuple[DataFrame, TrigramIndex]:
    """The catalogue and the postings of the newest version under ``out``."""
    version = f"v{current(spark, f'{out}/skills'):08d}"
    return spark.read.parquet(f"{out}/skills/{version}"), TrigramIndex(f"{out}/grams/{version}")


def main(argv: list[str] | None = None) -> str:
    """``python -m marlbrook.sources.index FOLDER OUT [--found FILE] [--force] [--limit N]``."""
    from marlbrook.session import session

    p = argparse.ArgumentParser()
    p.add_argument("folder")
    p.add_argument("out")
    p.add_argument("--found")
    p.add_argument("--force", action="store_true")
    p.add_argument("--limit", type=int)
    a = p.parse_args(argv)
    return json.dumps(build_index(session(), a.folder, a.out, a.found, a.force, a.limit or None))


if __name__ == "__main__":
    print(main())

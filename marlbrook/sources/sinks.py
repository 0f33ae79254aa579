"""Writers: upsert, CSV, JSON, Markdown and LaTeX."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlbrook.functions.text import human_size


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "identifier", order: str | None = None, fresh: bool = False) -> str:
    """Write ``new`` and the rows of the newest version under ``path`` that it does not replace as the next version; returns its path.

    Of several rows of ``new`` with one key the last by ``order`` stays
    (without it the last by all columns), a partial aggregate. ``fresh`` leaves
    all old rows out.

    A version is a folder of its own and is there once its _SUCCESS file is, so
    readers of the one before are never disturbed and a lost job leaves none.
    """
    old, whole = current(spark, path), F.struct(*new.columns)
    new = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(order, whole) if order else whole).alias("r")).select("r.*")
    rows = new if old is None or fresh else new.unionByName(spark.read.parquet(f"{path}/v{old:08d}").join(new.select(key), key, "left_anti"), allowMissingColumns=True)
    out = f"{path}/v{0 if old is None else old + 1:08d}"
    rows.write.mode("overwrite").parquet(out)
    return out


def current(spark: SparkSession, path: str) -> int | None:
    """The number of the newest whole version."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    mark = lambda s: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")
    whole = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v") and fs.exists(mark(s))]
    return max(whole, default=None)


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header, quotes where needed, by falling ``order``."""
    rows = df.orderBy(F.desc(order), *[c for c in ("identifier",) if c in df.columns]) if order else df
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def to_json(small: DataFrame) -> str:
    """A report as indented JSON, all rows."""
    return json.dumps([json.loads(r) for r in small.toJSON().toLocalIterator()], ensure_ascii=False, indent=2)


def write_document(path: str, sections: dict[str, DataFrame | object]) -> None:
    """A nested JSON report in one file of the driver: each section a list of rows, or a plain value."""
    whole = {k: [json.loads(r) for r in v.toJSON().toLocalIterator()] if isinstance(v, DataFrame) else v for k, v in sections.items()}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, ensure_ascii=False, indent=2)


def read_document(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """The rows of one section of a nested JSON report; a section that is one object is one row, a missing one none."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", f"$.{section}").alias("s"))
    rows = F.when(F.col("s").startswith("["), F.from_json("s", f"array<struct<{schema}>>")).otherwise(F.array(F.from_json("s", f"struct<{schema}>")))
    return raw.where("s is not null").select(F.explode(rows).alias("r")).select("r.*")


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A report: each section a table with all its rows."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in df.toLocalIterator()] + [""]
    return "\n".join(out)


_TEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}"}


def latex(caption: str, df: DataFrame) -> str:
    """A table in LaTeX, all rows."""
    def cell(v) -> str:
        return "".join(_TEX.get(c, c) for c in ("" if v is None else str(v)))

    head = " & ".join(map(cell, df.columns)) + r" \\"
    rows = [" & ".join(map(cell, r)) + r" \\" for r in df.toLocalIterator()]
    return "\n".join([r"\begin{table}[h]", rf"\caption{{{cell(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *rows, r"\hline", r"\end{tabular}", r"\end{table}"])


def console(rows: DataFrame, limit: int = 50) -> str:
    """Search results as text."""
    shown = rows.withColumn("_size", human_size(F.col("zip_size"))).take(limit)
    out = [f"[{r['identifier']}] {r['name'] or '(unnamed)'}\n  {r['author'] or '-'} | {r['category'] or '-'} | {r['version'] or '-'} | {r['_size']}\n  {(r['description'] or '')[:160]}{'…' if len(r['description'] or '') > 160 else ''}" for r in shown]
    return "\n".join(out) or "(no results)"

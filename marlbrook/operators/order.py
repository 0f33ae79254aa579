"""Orders over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marlbrook.shared import cut


def prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each name -> column, the sum of the column over all rows before this one in ``order``.

    Rows are dealt by ranges of the order and written; each range is summed by
    itself and raised by the sums of those before it, of which the driver gets
    one row for each range.
    """
    spark = df.sparkSession
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_m", 33))
    totals = placed.groupBy("_p").agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy("_p").collect()
    held, rows = dict.fromkeys(sums, 0), []
    for r in totals:
        rows.append((r["_p"], *(held[n] for n in sums)))
        held = {n: held[n] + (r[n] or 0) for n in sums}
    kinds = {n: placed.select(F.sum(c).alias("x")).dtypes[0][1] for n, c in sums.items()}
    base = spark.createDataFrame(rows, "_p long" + "".join(f", _base_{n} {kinds[n]}" for n in sums))
    w = Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(base), "_p")
    for n, c in sums.items():
        out = out.withColumn(n, F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_base_{n}"))
    return out.drop("_m", "_p", *(f"_base_{n}" for n in sums))


def ranked_values(df: DataFrame, value: str, by: dict[str, Column] | None = None) -> DataFrame:
    """(value, n, before): each distinct value, how often it occurs, and how many rows have a smaller one; nulls are left out.

    ``by`` adds counts of rows that meet conditions, n_<name>, and before_<name>.
    """
    by = by or {}
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{k}") for k, c in by.items()))
    return prefix_sums(counts, [F.col("value")], {"before": "n"} | {f"before_{k}": f"n_{k}" for k in by})


def at_rank(ranked: DataFrame, k: Column | int) -> Column:
    """Aggregate over ``ranked_values``: the value of 0-based rank k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))


def with_total(ranked: DataFrame) -> DataFrame:
    """``ranked`` with the number of all rows, total."""
    return ranked.crossJoin(F.broadcast(ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))))

"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry_point

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry_point.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if hasattr(v, "is_finite") else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry_point.queries()[name](spark, SF_SMALL)
    rel = duck.sql(entry_point.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry_point.entry(spark).count() == 20


def test_sizes_of_empty_unknown_and_long_texts(spark, tmp_path):
    sizes = [None, 0, 1, -5, 1023, 1024, 1280, 1331, 1048575, 1048576, 5 << 20, 3 << 30, (7 << 40) + 768]
    rows = [(i, "x" if i % 2 else None, n) for i, n in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in entry_point.queries()["sha256_and_size"](spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(entry_point.oracle_sql()["sha256_and_size"]).fetchall())

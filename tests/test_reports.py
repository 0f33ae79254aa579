"""The statistics, audits, reports and query forms that came second."""

import itertools
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlbrook.operators import audit, search, stats
from marlbrook.sources import discovered, sinks


@pytest.mark.parametrize("n, m", [(1, 5), (2, 7), (3, 4), (4, 4), (5, 6)])
def test_exact_law_against_all_orders(n, m):
    us = [sum(1 for i, a in enumerate(at) for b in range(n + m) if b not in at and b < a) for at in itertools.combinations(range(n + m), n)]
    for u in set(us):
        low = min(u, n * m - u)
        want = min(1.0, 2 * sum(x <= low for x in us) / len(us))
        assert stats.mann_whitney_p(n, m, u, 0) == pytest.approx(want) == pytest.approx(stats.mann_whitney_p(m, n, u, 0))


def test_exact_law_of_large_groups(monkeypatch):
    for n, m, z in ((1, 30_000, 0.1), (3, 4000, 0.2), (8, 3000, 0.3)):
        u = int(n * m * z)
        exact = stats.mann_whitney_p(n, m, u, 0)
        monkeypatch.setattr(stats, "LAW_SIZE", 10)
        assert stats.mann_whitney_p(n, m, u, 0) == pytest.approx(exact, rel=0.02)
        monkeypatch.undo()


def test_spearman_p_and_words(spark):
    rows = [(float(i), float(-i if i % 4 else i)) for i in range(1, 30)]
    r = stats.spearman_test(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    t = r.rho * ((r.n - 2) / (1 - r.rho**2)) ** 0.5
    assert r.n == 29 and r.p == pytest.approx(stats.student_p(t, 27)) and r.significant == (r.p < 0.05)
    assert r.interpretation == ("significant negative correlation" if r.rho < -0.3 and r.p < 0.05 else "weak/no correlation")
    assert stats.student_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)  # a tabled value
    none = stats.spearman_test(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert none.n == 0 and none.p is None and not none.significant


def test_bootstrap_of_any_statistic(spark):
    rng = random.Random(2)
    values = [rng.gauss(5, 2) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    mean = stats.bootstrap_of(df, "v", lambda v, w: F.sum(v * w) / F.sum(w), replicates=400).first()
    assert mean.estimate == pytest.approx(sum(values) / 400) and mean.low < mean.estimate < mean.high
    assert mean.high - mean.low == pytest.approx(2 * 1.96 * 2 / 20, rel=0.3)
    median = stats.bootstrap_of(df, "v", lambda v, w: F.percentile(v, 0.5, w), replicates=200).first()
    assert median.low <= median.estimate <= median.high


def test_comparison_with_intervals(spark):
    df = spark.createDataFrame([(i % 2, float(i % 7 + 3 * (i % 2))) for i in range(300)], "g int, v double")
    r = stats.compare_with_intervals(df, "v", F.col("g") == 0, F.col("g") == 1, "a", "b", replicates=500).first()
    assert r.mean_a_low < r.mean_a < r.mean_a_high and r.mean_b_low < r.mean_b < r.mean_b_high and r.difference_low < r.mean_a - r.mean_b < r.difference_high
    assert stats.compare_with_intervals(df, "v", F.col("g") == 0, F.col("g") == 5, "a", "b", replicates=10).count() == 0


@pytest.mark.parametrize("query", ["^world", "^world OR cup", "^\"the w\"", "name : ^world", "cup NOT ^world", "^wor"])
def test_phrases_at_the_start_as_in_fts5(spark, query):
    rows = [("world cup", "a big game"), ("the world", "world news"), ("cup of tea", "the world cup"), ("World", "")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, description, body, tokenize='trigram')")
    db.executemany("insert into t values (?, ?, '')", rows)
    want = {r[0] - 1 for r in db.execute("select rowid from t where t match ?", (query,))}
    df = spark.createDataFrame([(i, n, d, "") for i, (n, d) in enumerate(rows)], "identifier int, name string, description string, skill_md_text string")
    assert {r.identifier for r in search.match(df, query).collect()} == want


def test_upsert_keeps_the_last_row_of_a_key(spark, tmp_path):
    new = spark.createDataFrame([("a", "a@1.zip"), ("a", "a@2.zip"), ("b", "b@1.zip")], "identifier string, zip_path string")
    path = sinks.upsert(spark, f"file://{tmp_path}/t", new, order="zip_path")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "a@2.zip"), ("b", "b@1.zip")]
    path = sinks.upsert(spark, f"file://{tmp_path}/t", spark.createDataFrame([("b", "b@3.zip")] * 2, new.schema))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "a@2.zip"), ("b", "b@3.zip")]


def test_nested_report(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), ("y", None)], "field string, n long")
    sinks.write_document(str(tmp_path / "audit.json"), {"coverage": rows, "total": 7, "one": {"field": "z", "n": 2}})
    assert json.loads((tmp_path / "audit.json").read_text())["total"] == 7
    read = lambda s: sorted(map(tuple, sinks.read_document(spark, f"file://{tmp_path}/audit.json", s, "field string, n long").collect()))
    assert read("coverage") == [("x", 1), ("y", None)] and read("one") == [("z", 2)] and read("none") == []


def test_raw_coverage_of_odd_manifests(spark):
    m = spark.createDataFrame([('{"raw": {"a": 1}}',), ('{"raw": {}}',), ('{"raw": 3}',), ("no",), (None,), ("{}",)], "manifest string")
    s = spark.createDataFrame([("x",), (None,)], "sha256 string")
    assert tuple(audit.raw_coverage(s, m).first()) == (6, 1, 2, 1)
    assert list(map(tuple, audit.raw_fields(m).collect())) == [("a", 1)]


def test_all_keywords_are_swept():
    assert len(discovered.SWEEP_KEYWORDS) == len(set(discovered.SWEEP_KEYWORDS)) == 68
    seen = []
    discovered.sweep(discovered.SWEEP_KEYWORDS, lambda w, p: seen.append(w) or [])
    assert set(seen) == set(discovered.SWEEP_KEYWORDS)

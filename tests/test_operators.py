import math
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from marlbrook.functions import text as T
from marlbrook.operators import audit, scoring, similarity, stats
from marlbrook.operators.graph import connected_components


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7), (5000, 5000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_a_star_and_strings(spark):
    edges = [("m", f"n{i}") for i in range(500)] + [(None, "x")]
    got = connected_components(spark.createDataFrame(edges, "src string, dst string"))
    assert got.count() == 501 and {r.component for r in got.collect()} == {"m"}


def test_upper_median_deciles_gini(spark):
    df = spark.createDataFrame([(i,) for i in (4, 1, 3, 2)], "x long")
    assert audit.upper_median(df, "x").first().median == 3
    assert audit.gini(spark.createDataFrame([(3,)] * 5, "cnt long")).first().gini == 0
    assert audit.gini(spark.createDataFrame([], "cnt long")).first().gini == 0
    skills = spark.createDataFrame([("a", "x" * n) for n in (1, 2, 3)], "identifier string, skill_md_text string")
    assert [(r.low, r.high) for r in audit.body_length_deciles(skills).orderBy("decile").collect()][0] == (1, 1)


@pytest.mark.parametrize("title, body, want", [("x" * 31, "y" * 199, 1.0), ("x" * 28, "y" * 50, 0.5), ("x" * 22, "y" * 99, 1.0), ("x" * 22, "y" * 100, 0.0)])
def test_title_ratio_in_order(spark, title, body, want):
    df = spark.createDataFrame([("a", title, None, body)], "identifier string, title string, description string, body string")
    assert scoring.sensational(df).first().title_body_ratio == want


def test_sensational_words(spark):
    df = spark.createDataFrame([("a", "一键生成 首发 ３步", None, "[a] [b] [c]"), ("b", None, None, None), ("c", "t", "d", "[x\ny] [z w] <i> <b>")], "identifier string, title string, description string, body string")
    r = {x.identifier: x for x in scoring.sensational(df).collect()}
    assert (r["a"].emotional, r["a"].superlatives, r["a"].numbers, r["a"].template_placeholder) == (0.667, 1.0, 0.5, 0.5)
    assert r["b"].thin_wrapper == 1.0 and r["c"].template_placeholder == 0.5


@pytest.mark.parametrize("version, want", [("v2.0", 1.0), ("1.1", 0.5), ("1.x", 0.0), ("unknown", 0.0), ("", 0.0), ("1.10", 0.5), ("0.9", 0.0), ("2", 1.0), (None, 0.0)])
def test_version_maturity(spark, version, want):
    df = spark.createDataFrame([("a", "t", version, "## a\n###b\n##　c", 0)], "identifier string, title string, version string, body string, n_entries long")
    r = scoring.robustness(df).first()
    assert r.version_maturity == want and r.n_entries == 1 and r.sections == 0.3


def test_minhash_threshold(spark):
    texts = [("a", ""), ("b", "x"), ("c", "abcdefghijklmnop" * 20), ("d", "abcdefghijklmnop" * 20), ("e", None), ("f", "something else altogether")]
    pairs = {(r.ident1, r.ident2) for r in similarity.minhash_pairs(spark.createDataFrame(texts, "identifier string, text string")).collect()}
    assert pairs == {("a", "b"), ("a", "e"), ("b", "e"), ("c", "d")}
    comp = {r.identifier: (r.component, r["size"]) for r in similarity.duplicate_components(spark.createDataFrame(texts, "identifier string, text string")).collect()}
    assert comp == {"a": ("a", 3), "b": ("a", 3), "e": ("a", 3), "c": ("c", 2), "d": ("c", 2)}


@pytest.mark.parametrize("min_samples", [2, 3])
def test_dbscan(spark, min_samples):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((4, 8))
    x = np.concatenate([c + 0.1 * rng.standard_normal((6, 8)) for c in centres] + [rng.standard_normal((10, 8)), [centres[0] + 0.3]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (1 - u @ u.T) <= 0.05
    core = near.sum(1) >= min_samples
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = k
                    if core[j]:
                        todo += np.flatnonzero(near[j]).tolist()
            k += 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.id: r.cluster for r in similarity.dbscan(df, 0.05, min_samples).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist()


def test_rank_test_and_p(spark):
    a, b = [1.0, 2.0, 2.0, 3.0, 9.0], [2.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(x, "a") for x in a] + [(x, "b") for x in b], "x double, g string")
    s = stats.rank_sums(df, "x", F.col("g") == "a", F.col("g") == "b").first()
    assert s.u_a == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert stats.cliffs_delta(df, "x", F.col("g") == "a", F.col("g") == "z").first().delta == 0
    assert stats.mann_whitney_p(3, 3, 0, 0) == pytest.approx(0.1)
    assert stats.mann_whitney_p(100, 100, 5000, 0) == pytest.approx(1.0)
    assert stats.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-6)
    assert stats.compare_groups(df, "x", F.col("g") == "q", F.col("g") == "b", "q", "b").count() == 0


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(2000)], "x double")
    r = stats.bootstrap_ci(df, "x", replicates=500).first()
    half = 1.96 * 2 / math.sqrt(2000)
    assert r.low == pytest.approx(r.mean - half, abs=0.03) and r.high == pytest.approx(r.mean + half, abs=0.03)


def test_strings(spark):
    assert one(spark, "　 a \n", "string", T.strip) == "a"
    assert one(spark, "x\n# # Title ##\nb", "string", T.heading_name) == "Title ##"
    assert one(spark, "# \nb", "string", T.heading_name) is None
    assert [one(spark, n, "long", T.human_size) for n in (None, 0, 1023, 1280, 5 << 20, 3 << 40)] == ["?", "?", "1023B", "1.2KB", "5.0MB", "3.0TB"]
    assert one(spark, ["a/skill.md", "SKILL.MD", "__MACOSX/SKILL.md"], "array<string>", T.find_entry) == "SKILL.MD"
    assert one(spark, "a@1.0@2.zip", "string", T.archive_version) == "1.0@2"
    assert one(spark, "日本語x😀y", "string", T.trigrams) == ["日本語", "本語x", "語x😀", "x😀y"]


def test_bootstrap_queries_draw_as_many_replicates_as_the_operator(spark, monkeypatch):
    from marlbrook.plans import queries

    asked, means = [], stats.bootstrap_means

    def counted(df, value, replicates=10_000, seed=42):
        asked.append(replicates)
        return means(df, value, 20, seed)

    monkeypatch.setattr(stats, "bootstrap_means", counted)
    for name in ("bootstrap_ci", "bootstrap_difference"):
        queries.QUERIES[name](spark, SF_SMALL)
    assert asked == [10_000] * 3

import itertools
import random
import zlib

import numpy as np
import pytest
from conftest import SF, SF_SMALL

from marlbrook.llm import quality_crf, queries
from marlbrook.llm.quality_crf import N_FEATURES, fit, forward_backward, line_features, score_texts

from .conftest import words


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5, 2])
    emit, trans = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs, log_z = forward_backward(emit, counts, trans)
    want, seen, total, at = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        z, m, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e for e, s in zip(emit[at : at + n], y) if s) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += w
            m += w * np.array(y)
            for a, b in zip(y, y[1:]):
                p[a, b] += w
        want += (m / z).tolist()
        seen += p / z
        total += np.log(z)
        at += n
    assert good == pytest.approx(want) and pairs == pytest.approx(seen) and log_z == pytest.approx(total)


def test_scores_are_those_of_the_wide_table():
    rng = random.Random(1)
    texts = ["", "\n\n", "A!! B!!\nplain words here", "x | y | z", "é\n" * 30] + [words(rng, 50).replace(" ", "\n", 3) for _ in range(5)]
    x, weight, counts = line_features(texts)
    model = {"w": np.random.default_rng(2).normal(size=N_FEATURES) / 5, "trans": np.array([[0.5, -0.5], [-0.3, 0.4]]), "curve": None}
    good, _, _ = forward_backward(x.astype(float) @ model["w"], counts, model["trans"])
    starts = np.cumsum(counts) - counts
    want = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
    assert score_texts(texts, model) == pytest.approx(want, abs=1e-5)
    assert [score_texts([t], model)[0] for t in texts] == pytest.approx(score_texts(texts, model), abs=1e-6)
    assert score_texts([], model).size == 0


@pytest.mark.parametrize("labels", [[], [1, 1], [0]])
def test_no_contrast(labels):
    texts = ["a b c"] * len(labels)
    x, w, n = line_features(texts) if texts else (np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(0, int))
    s = score_texts(["anything", ""], fit(x.astype(float), w, n, np.array(labels, int)))
    assert ((0 <= s) & (s <= 1)).all()


def test_held_out(spark, docs, docs_rows):
    got = {r.doc_id: r.h for r in docs.select("doc_id", quality_crf.held_out(docs["doc_id"]).alias("h")).collect()}
    assert got == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in docs_rows}


def test_labels_of_held_out_rows_do_not_matter(spark, docs, docs_rows):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(docs_rows)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_crf.train(docs, t) for t in (labels, turned))
    assert np.allclose(a["w"], b["w"]) and a["curve"] == b["curve"]


def test_odd_tables(spark, docs, wide_docs, docs_rows, empty_docs):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (4, 1), (4, 0), (999, 1)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    rows = quality_crf.score_documents(wide_docs, model).collect()
    assert len(rows) == len(docs_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert quality_crf.score_documents(empty_docs, quality_crf.train(empty_docs, labels)).count() == 0
    assert quality_crf.keep_good(wide_docs, labels).columns == wide_docs.columns


@pytest.mark.parametrize("sf, least", [(SF_SMALL, 0.85), (SF, 0.93)])
def test_accuracy_on_held_out_rows(spark, sf, least):
    rows = queries.QUERIES["op1_quality_crf"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, _, t in held) / len(held) >= least
    bad, good = [s for _, s, t in held if not t], [s for _, s, t in held if t]
    assert sum((a < b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) > 0.97

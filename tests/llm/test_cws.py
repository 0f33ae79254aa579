import hashlib
import random

import numpy as np
import pytest
from conftest import SF_SMALL

from marlbrook.llm import cws, queries
from marlbrook.llm.cws import edited, fingerprint_documents, likeness, sampler, to_text

from .conftest import words


def jaccard(a, b):
    (ha, na), (hb, nb) = sampler().terms(a), sampler().terms(b)
    x, y = dict(zip(ha.tolist(), na.tolist())), dict(zip(hb.tolist(), nb.tolist()))
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


@pytest.mark.parametrize("repeats", [1, 4])
def test_rate_of_equal_samples_is_the_likeness(repeats):
    rng, errors = random.Random(repeats), []
    for _ in range(250):
        base = words(rng, 40)
        a = " ".join([base] * rng.randint(1, repeats) + [words(rng, rng.randint(0, 60))])
        b = " ".join([base] * rng.randint(1, repeats) + [words(rng, rng.randint(0, 60))])
        errors.append(likeness(sampler().signature(a), sampler().signature(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.07


@pytest.mark.parametrize("a, b, want", [("", " \n", 1.0), ("one two", "one two", 1.0), ("one two three four five", "six seven eight nine ten", 0.0)])
def test_short_texts(a, b, want):
    assert likeness(sampler().signature(a), sampler().signature(b)) == want


def expected(rows):
    order = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    out = []
    for (k, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        e = edited(t or "", nxt or "")
        s = [sampler().signature(x) for x in (t or "", e, nxt or "")]
        out.append((k, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), to_text(s[0]), to_text(s[1]), likeness(s[0], s[1]), likeness(s[0], s[2])))
    return sorted(out)


@pytest.mark.parametrize("stretches", [1, 4, 50])
def test_order_over_stretches(spark, docs_rows, wide_docs, stretches):
    rows = [r[:2] for r in docs_rows if r[0] != 3]  # rows that share an id are ordered by text
    got = fingerprint_documents(wide_docs.where("doc_id <> 3"), stretches).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_odd_tables(spark, docs, docs_rows, empty_docs):
    assert fingerprint_documents(docs).count() == len(docs_rows)
    assert fingerprint_documents(empty_docs).count() == 0
    one = fingerprint_documents(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    nulls = spark.createDataFrame([(None, "a b"), (1, "c d"), (None, None)], "doc_id long, text string")
    assert fingerprint_documents(nulls, 3).count() == 3


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op5_cws"](spark, SF_SMALL).collect())) == expected(rows)
    assert cws.SAMPLES == 64

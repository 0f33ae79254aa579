import os
import subprocess
import sys
import zlib
from collections import Counter

import pytest
from conftest import SF_SMALL

import corpus_pipeline
from marlbrook.llm import mixing, quality_crf, simhash_trie


def test_stages_are_their_operators(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4 and len(set(names)) == 4
    rejected = {r.doc_id for r in quality_crf.score_documents(docs, quality_crf.train(docs, labels)).where("predicted = 0").collect()}
    good = corpus_pipeline.quality(spark, docs, SF_SMALL).localCheckpoint()  # a test on one machine
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected and rejected
    comp = simhash_trie.similar_components(good, least=0.8, width=5).collect()
    one = corpus_pipeline.near_duplicates(spark, good, SF_SMALL).localCheckpoint()
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in comp})
    mixed = corpus_pipeline.mix(spark, one, SF_SMALL)
    copies, words = Counter(r.doc_id for r in mixed.collect()), Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").split())
    want, largest = {}, Counter()
    for r in mixing.mix_copies(one).collect():
        want[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    # within a row of the target, which is what pivotal rounding promises
    assert mixed.columns == columns and all(abs(words[s] - want[s]) <= largest[s] for s in want)
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r.doc_id for r in out if r["rank"] == 1) == copies
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in out)


def test_every_stage_takes_odd_tables(spark, docs, wide_docs, empty_docs, tmp_path):
    spark.createDataFrame([(1, 0), (2, 1), (5, 0), (7, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, wide_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).columns == table.columns
            stage(spark, table, str(tmp_path)).count()
        last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert last.where("rank = 1").count() == table.count()


@pytest.mark.parametrize("code", ["import __spark_entry__ as e; assert 'fts_and' in e.queries() and not any(k.startswith('op') for k in e.queries())"])
def test_the_rest_imports_without_the_package(tmp_path, code):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    os.makedirs(tmp_path / "marlbrook")
    for name in os.listdir(f"{root}/marlbrook"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{root}/marlbrook/{name}", tmp_path / "marlbrook" / name)
    with open(f"{root}/__spark_entry__.py") as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)

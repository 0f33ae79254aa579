import sqlite3

import pytest

from marlbrook.operators.search import Search, TrigramIndex, fallback, match
from marlbrook.plans.match import MatchSyntaxError, parse

ROWS = [("a", "爆款标题生成器", "写作工具", "正文 小红花 内容"), ("b", "PPT maker", None, "make a ppt, PPT and pptx"), ("c", "world cup", "the world of football", "cup of the world"), ("d", "café", "É", "aaaa"), ("e", None, "world", ""), ("f", "foo-bar", "a b", "C++ and foo bar")]
QUERIES = ["world", "ppt", "小红花", "world cup", "world AND cup", "world OR ppt", "world NOT cup", '"cup of"', "name:world", "{name description}: world", "AI ppt", "aaa", "foot*", "(world OR ppt) AND mak*", "CAFÉ"]
BAD = ["foo-bar", "C++", "it's", "(world", "world AND", '"open', "nocolumn:x", "", "AND"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, n, d, b, "me", "cat", "1.0", 5, ["x"]) for i, n, d, b in ROWS], "identifier string, name string, description string, skill_md_text string, author string, category string, version string, zip_size long, tags array<string>")


@pytest.fixture(scope="module")
def lite():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(id unindexed, name, description, body, tokenize='trigram')")
    c.executemany("insert into t values(?,?,?,?)", [(i, n or "", d or "", b) for i, n, d, b in ROWS])
    return c


@pytest.mark.parametrize("q", QUERIES)
def test_ranks_like_sqlite(table, lite, q):
    got = {r.identifier: r.score for r in match(table, q).select("identifier", "score").collect()}
    want = dict(lite.execute("select id, bm25(t, 0, 1, 1, 1) from t where t match ?", (q,)).fetchall())
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("q", BAD)
def test_no_query(q):
    with pytest.raises(MatchSyntaxError):
        parse(q)


def test_short_words_match_nothing(table):
    assert match(table, "a b").count() == 0


def test_fallback_folds_ascii_only(table):
    assert [r.identifier for r in fallback(table, "ppT").collect()] == ["b"]
    assert [r.identifier for r in fallback(table, "É").collect()] == ["d"]
    assert fallback(table, "é").where("identifier = 'd' and description = 'É'").count() == 1  # by its name only


def test_search_composes(table):
    assert [r.identifier for r in Search(table).text("world").author("ME").limit(1).run().collect()]
    assert [r.identifier for r in Search(table).text("C++").run().collect()] == []
    assert [r.identifier for r in Search(table).text("foo-bar").run().collect()] == ["f"]
    assert Search(table).tag("X").run().count() == 6 and Search(table).tag("X", exact=True).run().count() == 0


def test_index_finds_a_superset(spark, table, tmp_path):
    index = TrigramIndex(str(tmp_path / "grams"))
    index.build(table)
    assert {r.identifier for r in index.candidates(spark, "World").collect()} == {"c", "e"}

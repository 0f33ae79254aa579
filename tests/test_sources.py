import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlbrook.sources import bundles, checkpoint, discovered, envelope, service, sinks
from marlbrook.streaming import event_counts, follow_log


@pytest.fixture()
def crawl(tmp_path):
    def pack(name, files):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)

    pack("a@1.0@2.zip", {"x/SKILL.md": "deep", "SKILL.md": "---\nname: Alpha\nversion: 1.10\nmetadata:\n  category: tools\ntags: one\n---\nbody"})
    pack("b@3.zip", {"skill.MD": "# Heading here\ntext"})
    pack("c@1.zip", {"__MACOSX/SKILL.md": "no", "other.txt": "x"})
    pack("e@1.zip", {"SKILL.md": "---\n: [broken\n---\nbody"})
    (tmp_path / "d@1.zip").write_bytes(b"no zip")
    (tmp_path / "a.manifest.json").write_text(json.dumps({"identifier": "a", "sha256": "ABC", "raw": {"k": "v"}}))
    (tmp_path / "b.manifest.json").write_text("{broken")
    (tmp_path / "found.json").write_text(json.dumps({"b": {"identifier": "b", "name": "B", "description": "from the crawl", "tags": ["t"]}, "c": {"name": "C"}}))
    return str(tmp_path)


def test_catalogue(spark, crawl):
    b = bundles.read_bundles(spark, crawl)
    rows = {r.identifier: r for r in bundles.catalogue(b, bundles.read_manifests(spark, crawl), discovered.read_discovered(spark, f"{crawl}/found.json")).collect()}
    assert {k: r.status for k, r in rows.items()} == {"a": "ok", "b": "ok", "c": "no_skill_md", "d": "error", "e": "ok"}
    a = rows["a"]
    assert (a.name, a.version, a.category, a.tags, a.skill_md_text, a.sha256, a.n_entries) == ("Alpha", "1.1", "tools", ["one"], "body", "abc", 2)
    assert (rows["b"].name, rows["b"].description, rows["b"].version, rows["b"].tags) == ("Heading here", "from the crawl", "3", ["t"])
    assert rows["c"].name == "C" and rows["c"].has_skill_md == 0 and rows["e"].skill_md_text.startswith("---")
    assert bundles.read_bundles(spark, crawl, limit=1).first().identifier == "a"


@pytest.mark.parametrize("text, meta, body", [("plain", {}, "plain"), ("---\n---\nx", {}, "---\n---\nx"), ("---\r\nname: a\r\n---\r\nb", {"name": "a"}, "b"), ("﻿---\nname: a\n---\nb", {}, None), ("---\n- a\n---\nb", {}, "b")])
def test_front_matter(text, meta, body):
    assert bundles.parse_front_matter(text) == (meta, text if body is None else body)


def test_upsert_twice(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "identifier string, v int"
    sinks.upsert(spark, path, spark.createDataFrame([("a", 1), ("b", 1)], kind))
    out = sinks.upsert(spark, path, spark.createDataFrame([("b", 2), ("c", 2)], kind))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_log_last_wins(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text('{"identifier":"a","status":"failed"}\n\n{broken\n{"identifier":"a","status":"downloaded"}\n{"identifier":"b","status":"failed"}\n')
    assert {r.identifier: r.status for r in checkpoint.read_log(spark, str(log)).collect()} == {"a": "downloaded", "b": "failed"}
    checkpoint.append_log(spark.createDataFrame([("c", "failed")], "identifier string, status string"), str(log))
    assert checkpoint.read_log(spark, str(log)).count() == 3


def test_stream_of_the_log(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"identifier":"a","status":"failed","timestamp":"1"}\n{"identifier":"a","status":"downloaded","timestamp":"2"}\n')
    for more in (None, '{"identifier":"b","status":"failed","timestamp":"3"}\n'):
        if more:
            (src / "2.json").write_text(more)
        follow_log(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    n = sinks.current(spark, str(tmp_path / "out"))
    assert {r.identifier: r.status for r in spark.read.parquet(f"{tmp_path}/out/v{n:08d}").collect()} == {"a": "downloaded", "b": "failed"}


def test_windows(spark):
    e = spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:06:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert event_counts(e).count() == 2


def test_envelope(spark):
    def f(j, c):
        return spark.createDataFrame([(json.dumps(j),)], "j string").select(*c(F.col("j"))).first()

    assert f({"code": 0, "data": {"x": 1}}, envelope.unwrap)[0] == '{"x":1}'
    assert f({"code": 5, "data": {}, "msg": "no"}, envelope.unwrap)[1] == "no"
    assert f({"items": [{"id": 1}]}, lambda j: [envelope.results(j)])[0] == ['{"id":1}']
    s = f({"skill_id": "i", "title": "t", "name": "", "categories": ["c"]}, lambda j: [envelope.summary(j).alias("s")]).s
    assert (s.identifier, s.name, s.tags) == ("i", "t", ["c"])
    assert f({"noteId": "n", "post_ids": ["p", {"id": "q"}], "related_notes": ["p"]}, lambda j: [envelope.note_ids(j)])[0] == ["n", "p", "q", "p"]
    u = f({"usage_count": 0, "use_count": 7, "call_count": 0}, lambda j: list(envelope.coalesced_usage(envelope.usage(j)).values()))
    assert tuple(u) == (7, None, 0)


def test_paging_and_sweep():
    data = {w: [{"identifier": f"{w}{i}"} for i in range(n)] for w, n in (("a", 150), ("b", 3))}
    search = lambda w, p: data[w][(p - 1) * 100 : p * 100]
    assert len(discovered.sweep(["a", "b"], search)) == 153


def test_get_retries():
    class Answer:
        def __init__(self):
            self.parts = [b"x", b""]

        def read(self, _):
            return self.parts.pop(0)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    calls = []

    def opener(req, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return Answer()

    assert service.get("http://x", opener=opener, wait=lambda s: None) == b"x" and len(calls) == 3
    assert service.cookie_header("Cookie: a=b\r\n") == "a=b"


def test_pending(spark):
    ids = spark.createDataFrame([(c,) for c in "abcd"], "identifier string")
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "identifier string, sha256 string")
    want = spark.createDataFrame([("a", "1"), ("b", "x")], "identifier string, sha256 string")
    log = spark.createDataFrame([("b", "downloaded")], "identifier string, status string")
    get = lambda trust: {r.identifier: r.decision for r in service.pending(ids, have, want, log, trust).collect()}
    assert get(True) == {"a": "skip", "b": "skip", "c": "skip", "d": "fetch"} and get(False)["b"] == "fetch"


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a_b", 0.5), ('q"', 0.7)], "identifier string, score double")
    assert r"a\_b" in sinks.latex("T", df) and "| a_b | 0.5 |" in sinks.markdown("R", {"s": df}) and json.loads(sinks.to_json(df))[0]["score"] == 0.5
    sinks.write_csv(df, str(tmp_path / "c"), order="score")
    assert [r.identifier for r in sinks.read_csv(spark, str(tmp_path / "c"), "identifier string, score double").collect()] == ['q"', "a_b"]


def _zip(text):
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("SKILL.md", text)
    return out.getvalue()


def test_download(spark):
    import hashlib

    body = _zip("# Fetched\nx")

    def fetch(key):
        if key == "bad":
            raise TimeoutError("no answer")
        return {"identifier": key, "version": "1/0", "zip_url": "u", "sha256": hashlib.sha256(body).hexdigest().upper() if key == "a" else "0"}

    rows = service.download(spark.createDataFrame([("a",), ("bad",), ("c",), ("a",)], "identifier string"), fetch, lambda url: body)
    got = {r.identifier: r for r in rows.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "downloaded", "bad": "failed", "c": "failed"} and got["a"].path == "a@1_0.zip" and "mismatch" in got["c"].error
    b = bundles.unpack(rows.where("status = 'downloaded'")).first()
    assert (b.identifier, b.zip_version, b.status) == ("a", "1_0", "ok")


def test_discovery_policy():
    full = [{"identifier": f"l{i}"} for i in range(120)]
    search = lambda w, p: [{"identifier": "s"}] if p == 1 else []
    assert len(discovered.discover(lambda p: full[(p - 1) * 100 : p * 100], search)) == 120
    assert set(discovered.discover(lambda p: [{"identifier": "l"}] if p == 1 else [], search)) == {"l", "s"}

    def refuse(p):
        raise RuntimeError("HTTP 401")

    assert set(discovered.discover(refuse, search)) == {"s"}


def test_a_long_listing_is_read_to_its_end():
    full = [{"identifier": f"l{i}"} for i in range(5_230)]
    fetch = lambda p: full[(p - 1) * 100 : p * 100]
    assert len(discovered.listed(fetch)) == 5_230
    assert len(discovered.discover(fetch, lambda w, p: [])) == 5_230
    assert len(discovered.listed(lambda p: fetch(p) if p <= 52 else [])) == 5_200  # all pages full: two empty ones end it
    assert len(discovered.sweep(["a"], lambda w, p: fetch(p))) == 5_000  # a sweep keeps its bound


def test_reports_hold_all_rows(spark, tmp_path):
    from marlbrook import cli

    rows = spark.range(10_050)
    assert len(json.loads(sinks.to_json(rows))) == 10_050
    assert sinks.markdown("t", {"s": rows.limit(250)}).count("\n| ") == 252
    assert sinks.latex("t", rows.limit(250)).count(r"\\") == 251
    rows.limit(1_200).selectExpr("concat('i', id) identifier", "array(concat('t', id)) tags").write.parquet(f"{tmp_path}/skills")
    assert len(cli.main(["--skills", f"{tmp_path}/skills", "--list-tags"]).splitlines()) == 1_200

import json
import zipfile

import pytest

from marlbrook.sources import index


@pytest.fixture()
def crawl(tmp_path):
    folder = tmp_path / "crawl"
    folder.mkdir()

    def pack(name, files):
        with zipfile.ZipFile(folder / name, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)

    pack("a@1.zip", {"SKILL.md": "---\nname: Old\n---\nfirst words"})
    pack("a@2.zip", {"SKILL.md": "---\nname: New\n---\nsecond words"})
    pack("b@1.zip", {"skill.md": "# Heading\ntext"})
    pack("c@1.zip", {"other.txt": "x"})
    (folder / "d@1.zip").write_bytes(b"no zip")
    for n in ("a", "a@1"):  # two manifests of one bundle
        (folder / f"{n}.manifest.json").write_text(json.dumps({"identifier": "a", "sha256": "ABC"}))
    return folder, pack


def test_build_index(spark, crawl, tmp_path):
    folder, pack = crawl
    out = str(tmp_path / "index")
    assert index.build_index(spark, str(tmp_path / "crawl"), out, limit=1)["bundles"] == 1
    got = index.build_index(spark, str(folder), out)
    assert {k: got[k] for k in ("bundles", "ok", "no_skill_md", "error", "total", "with_md")} == {"bundles": 5, "ok": 3, "no_skill_md": 1, "error": 1, "total": 3, "with_md": 2}
    table, postings = index.newest(spark, out)
    rows = {r.identifier: r for r in table.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"].name == "New" and rows["a"].sha256 == "abc" and got["postings"] > 0
    assert [r[0] for r in postings.candidates(spark, "second").collect()] == ["a"]
    assert postings.candidates(spark, "first").count() == 0


def test_updates_and_force(spark, crawl, tmp_path):
    folder, pack = crawl
    out, more = str(tmp_path / "index"), tmp_path / "more"
    index.build_index(spark, str(folder), out)
    more.mkdir()
    with zipfile.ZipFile(more / "e@1.zip", "w") as z:
        z.writestr("SKILL.md", "# E\nbody")
    assert index.build_index(spark, str(more), out)["total"] == 4
    assert index.build_index(spark, str(more), out, force=True)["total"] == 1
    assert [r.identifier for r in index.newest(spark, out)[0].collect()] == ["e"]


def test_no_bundles(spark, tmp_path):
    (tmp_path / "none").mkdir()
    got = index.build_index(spark, str(tmp_path / "none"), str(tmp_path / "index"))
    assert set(got.values()) == {0} and not (tmp_path / "index").exists()

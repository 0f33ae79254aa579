"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from tokenizers import Tokenizer

from marlbrook.llm import queries, token_counts, token_orc, units
from marlbrook.llm.units import BYTE_UNITS, WORD_UNITS, UnitIds

from .conftest import BYTE, WORD

ODD = ["", " ", "  a", "a\n\nb", "don't I'LL they're", "x <|endoftext|> y<|endoftext|>", "ΣΑΣ İstanbul ǅ", "é É", "a\x1c b", "a b c", "123 45.6 x²", "́a ́", "日本語 テスト", "a\t\n b", "ﬁ ŉ ß ẞ", "\r\n x\r\n"]


@pytest.mark.parametrize("path, pattern, fold", [(BYTE, BYTE_UNITS, False), (WORD, WORD_UNITS, True)])
def test_units_agree_with_the_library(path, pattern, fold, monkeypatch):
    monkeypatch.setattr(units, "HELD_UNITS", 300)  # so that units are dropped and learnt again
    rng = random.Random(2)
    alphabet = list(" \n\t'.,#|aAbBéÉßsStT1²́  Σ") + ["<|endoftext|>", "'s", "'ll", "  "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    tok, table = Tokenizer.from_file(path), UnitIds(path, pattern, fold)
    for a in range(0, len(texts), 200):
        part = texts[a : a + 200]
        ids, n = table.encode(part)
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_added_tokens_in_other_case_are_plain_text():
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> B", "x<|ENDOFTEXT|> <|endoftext|>Y", "<|STARTOFTEXT|>", "<|startoftext|>Ab <|endoftext|>", "É <|endofText|>", "Σ <|ENDOFTEXT|>"]
    tok, table = Tokenizer.from_file(WORD), UnitIds(WORD, WORD_UNITS, True)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    ids, n = table.encode(texts)
    assert 49407 not in want[0] and n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


LETTERS = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
CASES = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<|startoftext|>", "<|endoftext|>", "<|endoftext", "endoftext|>"]


@pytest.mark.parametrize("path, pattern, fold", [(BYTE, BYTE_UNITS, False), (WORD, WORD_UNITS, True)])
def test_letters_before_signs_and_special_strings_in_any_case(path, pattern, fold):
    rng = random.Random(5)
    texts = [f"x{a}{b}y {a}{b}" for a in LETTERS for b in ".,;:!?#$%&*|()\"'<>-_5"] + ["ŞEHİRLERİ. yeni", "x <|ENDOFTEXT|> y"]
    parts = ["İ", "İ.", "ı", "ß", "Å", "Σ", " ", "\n", ".", ",", "'", "'S", "a", "日本", "。", "7", *CASES]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(4000)]
    tok, table = Tokenizer.from_file(path), UnitIds(path, pattern, fold)
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        for t, w, n in zip(part, want, table.encode(part)[1].tolist()):
            assert n == len(w), t
        assert table.encode(part)[0].tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("path, pattern, fold", [(BYTE, BYTE_UNITS, False), (WORD, WORD_UNITS, True)])
def test_long_units_are_split_where_no_token_crosses(path, pattern, fold, monkeypatch):
    monkeypatch.setattr(units, "PIECE_CHARS", 40)
    rng = random.Random(9)
    kinds = ["abcdeABCDE", "日本語中文字漢한글テスト", "a1b2,;.#|'", "日本。，、é́İ", "aaaaaa"]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(41, 900))) for k in kinds for _ in range(60)]
    texts += ["".join(rng.choice(CASES + ["ab", "日"]) for _ in range(60)), "a" * 3000, "=" * 3000]
    tok, table = Tokenizer.from_file(path), UnitIds(path, pattern, fold)
    for t in texts:
        assert table.encode([t])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("path, pattern, fold", [(BYTE, BYTE_UNITS, False), (WORD, WORD_UNITS, True)])
def test_texts_without_blanks_leave_nothing_behind(path, pattern, fold):
    rng = np.random.default_rng(3)
    table, held = UnitIds(path, pattern, fold), []
    for _ in range(5):
        table.lengths(["".join(map(chr, rng.integers(0x4E00, 0x9F00, 100_000)))])
        table.lengths(["a b"])
        held.append(len(table.flat))
    assert held == [held[0]] * 5 and held[0] < 100


def test_twenty_megabytes_without_a_blank():
    rng = np.random.default_rng(3)
    text = rng.choice(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8), 20 << 20).tobytes().decode()
    table = UnitIds(WORD, WORD_UNITS, True)
    assert max(len(p) for p, _ in table.splitter.pieces(text[: 1 << 20])) < units.PIECE_CHARS + 100
    ids, n = table.encode([text])
    assert n[0] == len(ids) > 10_000_000
    head = Tokenizer.from_file(WORD).encode(text[:10_000], add_special_tokens=False).ids
    assert ids[: len(head) - 10].tolist() == head[:-10]
    table.lengths(["a b"])
    assert len(table.flat) < 100 and len(table.row) == 2


def test_held_ids_are_bounded(monkeypatch):
    monkeypatch.setattr(units, "HELD_IDS", 2000)
    table, rng = UnitIds(BYTE, BYTE_UNITS, False), np.random.default_rng(4)
    tok = Tokenizer.from_file(BYTE)
    for _ in range(20):
        texts = [" ".join("".join(map(chr, rng.integers(0x4E00, 0x9F00, 30))) for _ in range(20))]
        assert table.encode(texts)[0].tolist() == tok.encode(texts[0], add_special_tokens=False).ids
        assert table.kept[1] < 2000 + 20 * 30 * 3


def test_a_long_text_is_read_in_slices(monkeypatch):
    monkeypatch.setattr(units, "ROUND_BYTES", 100)
    rng = random.Random(8)
    for path, pattern, fold in ((BYTE, BYTE_UNITS, False), (WORD, WORD_UNITS, True)):
        tok, table = Tokenizer.from_file(path), UnitIds(path, pattern, fold)
        for _ in range(200):
            t = "".join(rng.choice(["a", "bc.", " ", "  ", "\n", "\t", "d'll", "日本", "\x1c"]) for _ in range(rng.randint(50, 400)))
            ids, n = table.encode([t])
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids and n.tolist() == table.lengths([t]).tolist() == [len(ids)]


def test_batches_are_balanced_by_bytes():
    runs = list(units.balanced(["日" * 10] * 10 + ["a" * 10] * 10, 60))
    assert [len(r) for r in runs] == [2] * 5 + [6, 4]


def test_counts(docs, docs_rows, wide_docs, empty_docs):
    tok = Tokenizer.from_file(BYTE)
    want = sorted((r[0], len((r[1] or "").encode()), len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in docs_rows)
    for table in (docs, wide_docs.repartition(5)):
        got = token_counts.count_tokens(table, BYTE).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(empty_docs, BYTE).count() == 0


def brute_ids(rows):
    tok, start, out = Tokenizer.from_file(WORD), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


def test_files(docs, docs_rows, empty_docs):
    got = sorted(map(tuple, token_orc.write_and_digest(docs, WORD).collect()))
    assert got == brute_ids([r[:2] for r in docs_rows])
    assert token_orc.write_and_digest(empty_docs, WORD).count() == 0


def test_files_are_in_order_and_are_looked_up(spark, docs, tmp_path):
    import pyarrow.orc

    path = f"file://{tmp_path}/t.orc"
    token_orc.write_tokens(docs, path, WORD, 2)
    files = sorted((tmp_path / "t.orc").glob("part-*.orc"))
    ids = [i for f in files for i in pyarrow.orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids)
    row = token_orc.read_tokens(spark, path, [5]).first()
    assert row.doc_id == 5 and row.ids[-1] == 2


def test_queries_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op2_token_orc"](spark, SF_SMALL).collect())) == brute_ids(rows)
    tok = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op8_token_counts"](spark, SF_SMALL).collect()}
    assert got == {k: len(tok.encode(t, add_special_tokens=False).ids) for k, t in rows}

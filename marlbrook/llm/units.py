"""Tokenizers of the ``tokenizers`` library, asked once for each distinct unit of text.

A unit is a stretch of text whose tokens do not depend on what stands around
it: texts are cut only where no token can cross. A worker keeps what the
library said of the units it has met, within a bound, and asks it for the
others in batches of about equal bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Units and ids held by one worker, and the longest unit that is held.
HELD_UNITS, HELD_IDS, HELD_CHARS = 450_000, 4_000_000, 64
#: Bytes that one call of the library gets, and that one round of texts holds.
CALL_BYTES, ROUND_BYTES = 1 << 20, 1 << 20
#: Characters of a unit that the library gets at once; longer ones are split further where no token can cross.
PIECE_CHARS, PIECE_LOOK = 1 << 16, 4096

_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r".,;:!?#$%&*|()\""
#: White space and the word after it. Cut where a character that is no white
#: space meets a blank or a line feed (a byte-level BPE joins the last blank to
#: the word and looks at most at the run of white space before it), and where
#: letters meet a sign, which its first split never joins.
BYTE_UNITS = re.compile(rf"\s*[{_LETTERS}]+(?=[{_SIGNS} \n]|$)|\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
#: For tokenizers that drop white space and lower case: what stands between blanks and line feeds, letters apart from the
#: signs after them. The dotted capital I is no such letter: in lower case it ends in a mark, which a sign after it joins.
_LOWERED = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
WORD_UNITS = re.compile(rf"[{_LOWERED}]+(?=[{_SIGNS}' \n]|$)|[^ \n]+")


#: Words that are one word to any tokenizer that splits letters from the rest.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def folded(text: str) -> str:
    """A text in lower case if all of it is Latin-1, where the case of a letter does not depend on its neighbours; else as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_LOADED: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once for each worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def n_bytes(text: str) -> int:
    """UTF-8 bytes of a text."""
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def balanced(texts: list[str], most: int):
    """Runs of ``texts`` of about ``most`` bytes each; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        n = n_bytes(t)
        if run and held + n > most:
            yield run
            run, held = [], 0
        run.append(t)
        held += n
    if run:
        yield run


def slices(text: str, chars: int):
    """A text in slices of about ``chars`` characters, cut before a blank or line feed that follows something else: a boundary of units."""
    at = 0
    while len(text) - at > chars:
        m = _SLICE.search(text, at + chars - 1)
        if m is None:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


_SLICE = re.compile(r"\S(?=[ \n])")


class Rows(dict):
    """unit -> row; a unit asked for the first time gets the next row and is noted. Units too long to be held get numbers below 0, for one round."""

    def __init__(self, units=(), at: int = 0):
        super().__init__(units)
        self.at, self.new, self.long = at, [], []

    def __missing__(self, unit: str) -> int:
        if len(unit) > HELD_CHARS:
            self.long.append(unit)
            return -len(self.long)
        row = self[unit] = self.at
        self.at += 1
        self.new.append(unit)
        return row


class Splitter:
    """Splits a unit without blanks where no token can cross.

    Two kinds of places: between a letter and a digit or sign, which the first
    split of both tokenizer families never joins; and, inside a stretch of
    letters, where no entry of the vocabulary that the text holds lies across.
    """

    def __init__(self, tok, suffix: str | None):
        self.tok, self.suffix = tok, suffix
        self.barred = set("'").union(*(t.content for t in tok.get_added_tokens_decoder().values()))
        self.vocab: set[bytes] | None = None

    def _words(self) -> set[bytes]:
        if self.vocab is None:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            # how byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on in order
            byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
            words = (w.removesuffix(self.suffix or "") for w in self.tok.get_vocab())
            self.vocab = {bytes(map(byte_of.__getitem__, w)) for w in words if all(c in byte_of for c in w)}
            self.longest = max(map(len, self.vocab))
        return self.vocab

    def _between(self, text: str, p: int) -> bool:
        a, b = text[p - 1], text[p]
        return a.isalpha() and a.lower().isalpha() and b not in self.barred and (b in "0123456789" or unicodedata.category(b)[0] in "PS")

    def _inside(self, text: str, p: int) -> bool:
        a, b = text[p - 1], text[p]
        if not (a.isalpha() and b.isalpha()):
            return False
        words, w = self._words(), self.longest
        left, right = text[max(0, p - w) : p], text[p : p + w]
        if self.tok.normalizer is not None:
            whole, left, right = (self.tok.normalizer.normalize_str(x) for x in (left + right, left, right))
            if whole != left + right or not left[-1:].isalpha() or not right[:1].isalpha():
                return False
        left, right = left.encode("utf-8", "surrogatepass")[-w:], right.encode("utf-8", "surrogatepass")[:w]
        return not any(left[i:] + right[:j] in words for i in reversed(range(len(left))) for j in range(1, w - len(left) + i + 1))

    def pieces(self, unit: str) -> list[tuple[str, str]]:
        """(piece, letter that follows it inside a word or "") of about PIECE_CHARS characters; longer where no place is found."""
        out, at = [], 0
        p = PIECE_CHARS
        while p < len(unit):
            till = min(len(unit), p + PIECE_LOOK)
            cut = next((q for q in range(p, till) if self._between(unit, q)), None)
            tail = ""
            if cut is None:
                cut = next((q for q in range(p, min(till, p + 256)) if self._inside(unit, q)), None)
                tail = unit[cut] if cut is not None else ""
            if cut is None:
                p = till
                continue
            out.append((unit[at:cut], tail))
            at, p = cut, cut + PIECE_CHARS
        return [*out, (unit[at:], "")]


class UnitIds:
    """unit -> its ids, as rows of a flat array."""

    def __init__(self, path: str, pattern: re.Pattern, fold: bool):
        self.tok, self.pattern, self.fold = load(path), pattern, fold
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.suffix = json.loads(self.tok.to_str())["model"].get("end_of_word_suffix")
        self.splitter = Splitter(self.tok, self.suffix)
        self.ends = self._end_ids()
        self.row = Rows()
        self.starts, self.lens, self.hits, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.kept = 0, 0  # units and ids that outlive a round

    def _end_ids(self) -> np.ndarray | None:
        """Which ids end a word, if the model marks the last piece of each."""
        if not (suffix := self.suffix):
            return None
        vocab = self.tok.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        return out

    def _shrink(self) -> None:
        """Keep the units that were met most often, up to half of what may be held."""
        units = list(self.row)
        at = np.fromiter(self.row.values(), np.int64, len(units))
        often = np.argsort(-self.hits[at], kind="stable")[: HELD_UNITS // 2]
        keep = np.sort(often[np.cumsum(self.lens[at[often]]) <= HELD_IDS // 2])
        at = at[keep]
        self.row = Rows(zip((units[k] for k in keep.tolist()), range(len(keep))), len(keep))
        starts, lens = self.starts[at], self.lens[at]
        ends = np.cumsum(lens)
        self.flat = self.flat[np.arange(int(lens.sum())) + np.repeat(starts - (ends - lens), lens)]
        self.starts, self.lens, self.hits = ends - lens, lens, np.zeros(len(at), np.int64)

    def _learn(self, units: list[str]) -> None:
        """Ask the library for new units. Plain words of a model that marks word ends are asked for in one text: each is a word to it."""
        plain = [i for i, u in enumerate(units) if len(u) <= HELD_CHARS and _PLAIN.fullmatch(u)] if self.ends is not None else []
        lens, starts, flat = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), self.flat
        if plain:
            texts = [" ".join(run) for run in balanced([units[i] for i in plain], 1 << 16)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                lens[plain], starts[plain] = np.diff(stops, prepend=0), len(flat) + np.concatenate([[0], stops[:-1]])
                flat = np.concatenate([flat, ids])
            else:  # not one word each after all
                plain = []
        known = set(plain)
        other = [i for i in range(len(units)) if i not in known]
        got = [self._whole(u) if len(u) > PIECE_CHARS else ids for u, ids in self._asked([units[i] for i in other])]
        if other:
            lens[other] = list(map(len, got))
            starts[other] = len(flat) + np.cumsum(lens[other]) - lens[other]
            long = any(isinstance(g, np.ndarray) for g in got)
            flat = np.concatenate([flat, *(np.asarray(g, np.uint32) for g in got)] if long else [flat, np.fromiter(chain.from_iterable(got), np.uint32)])
        self.flat, self.starts, self.lens = flat, np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.hits = np.concatenate([self.hits, np.zeros(len(units), np.int64)])

    def _asked(self, units: list[str]):
        """(unit, its ids) for each unit, with none for those that are too long for one call."""
        short = [u if len(u) <= PIECE_CHARS else "" for u in units]
        return zip(units, (e.ids for run in balanced(short, CALL_BYTES) for e in self.tok.encode_batch_fast(run, add_special_tokens=False)))

    def _whole(self, unit: str) -> np.ndarray:
        """The ids of a very long unit, asked for in pieces. A piece that ends inside a word of a model that marks word ends is asked for with the next letter, whose ids are dropped."""
        got = []
        for piece, tail in self.splitter.pieces(unit):
            tail = tail if self.suffix else ""
            ids = np.array(self.tok.encode_batch_fast([piece + tail], add_special_tokens=False)[0].ids, np.uint32)
            got.append(ids[: len(ids) - len(self.tok.encode(tail, add_special_tokens=False).ids)] if tail else ids)
        return np.concatenate(got)

    def _folded(self, text: str) -> str:
        """The text in lower case where that changes no token: the library looks for added tokens before it lowers case."""
        low = folded(text)
        return text if any(low.count(c) != text.count(c) for c in self.added) else low

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each unit of all texts in order, and the number of units of each text; rows of long units are forgotten by the next call."""
        n, ids = self.kept
        self.starts, self.lens, self.hits, self.flat = self.starts[:n], self.lens[:n], self.hits[:n], self.flat[:ids]
        if n > HELD_UNITS or ids > HELD_IDS:
            self._shrink()
        units = [self.pattern.findall(self._folded(t) if self.fold else t) for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        new, long, self.row.new, self.row.long = self.row.new, self.row.long, [], []
        if new:
            self._learn(new)
        self.kept = len(self.starts), len(self.flat)
        if long:
            rows = np.where(rows < 0, len(self.starts) - 1 - rows, rows)
            self._learn(long)
        self.hits += np.bincount(rows, minlength=len(self.hits))
        return rows, counts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(texts) == 1 and len(texts[0]) > ROUND_BYTES and len(parts := list(slices(texts[0], ROUND_BYTES))) > 1:
            return sum(self.lengths([p]) for p in parts)
        rows, counts = self.rows(texts)
        total = np.concatenate([[0], np.cumsum(self.lens[rows])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and the number of ids of each text."""
        if len(texts) == 1 and len(texts[0]) > ROUND_BYTES and len(parts := list(slices(texts[0], ROUND_BYTES))) > 1:
            ids = np.concatenate([self.encode([p])[0] for p in parts])
            return ids, np.array([len(ids)], np.int64)
        rows, counts = self.rows(texts)
        lens = self.lens[rows]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - lens), lens)
        total, last = np.concatenate([[0], ends]), np.cumsum(counts)
        return self.flat[at], total[last] - total[last - counts]


_UNITS: dict[tuple[str, str], UnitIds] = {}


def unit_ids(path: str, pattern: re.Pattern, fold: bool = False) -> UnitIds:
    """The worker's table for a tokenizer file. ``fold``: the tokenizer lowers case itself, so units may be met in lower case."""
    key = (path, pattern.pattern)
    if key not in _UNITS:
        _UNITS[key] = UnitIds(path, pattern, fold)
    return _UNITS[key]

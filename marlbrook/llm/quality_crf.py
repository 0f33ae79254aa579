"""Quality classifier: a linear-chain conditional random field over the lines of a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marlbrook.shared import cut

#: Labelled documents that a model is fitted on at most, and lines of all of them together; whole documents in the order of a hash.
FIT_DOCS, FIT_LINES = 3000, 60_000
#: Characters of the texts that are scored together.
ROUND_CHARS = 2 << 20

_UPPER, _LOWER, _DIGIT, _BLANK, _STOP, _SHOUT, _BAR, _SIGN, _REST = range(9)
_CLASS = np.full(256, _REST, np.uint8)
_CLASS[list(range(0x80, 0x100))] = _LOWER
for _c, _s in ((_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_BLANK, b" \t\r\v\f"), (_STOP, b".,;:'\"()-"), (_SHOUT, b"!?"), (_BAR, b"|"), (_SIGN, b"#$%&*@^~<>[]{}=+\\/_`")):
    _CLASS[list(_s)] = _c
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Ratios of a line that become features: each as it is, and as steps.
_STEPS = (0.02, 0.1, 0.3, 0.6)
N_RATIOS = 11
N_OWN = N_RATIOS * (1 + len(_STEPS)) + 4
#: bias, the line's own features, those of the line before and after, and whether these exist
N_FEATURES = 1 + 3 * N_OWN + 2


def lines_of(text: str) -> list[str]:
    """The lines of a text; an empty text is one empty line."""
    return text.split("\n")


def _own(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines, bytes of each line, and lines of each text."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    kinds = _CLASS[data]
    kinds[ends] = _BLANK
    n = [np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(9)]
    n[_BLANK] -= 1
    marks = np.add.reduceat(_CONT[data], starts, dtype=np.int64)
    chars = np.maximum(size - marks, 1)
    words, echo, kinds_of_word, seen_line, counts = [], [], [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        before: set[str] = set()
        lines = lines_of(t)
        counts[i] = len(lines)
        for line in lines:
            w = _WORD.findall(line)
            words.append(len(w))
            echo.append(sum(map(eq, w, w[1:])))
            kinds_of_word.append(len(set(w)))
            seen_line.append(line in before and len(line) > 0)
            before.add(line)
    words, echo, kinds_of_word = np.array(words, float), np.array(echo, float), np.array(kinds_of_word, float)
    letters = np.maximum(n[_UPPER] + n[_LOWER], 1)
    some = np.maximum(words, 1)
    long = np.minimum(chars / some / 40, 1)
    ratios = [n[_UPPER] / letters, n[_DIGIT] / chars, n[_SHOUT] / chars * 3, n[_BAR] / some, n[_SIGN] / chars * 3, n[_STOP] / chars * 3, n[_REST] / chars * 3, echo / some, np.where(words > 8, 1 - kinds_of_word / some, 0), np.array(seen_line, float), long]
    r = np.minimum(np.stack(ratios, 1), 1)
    flags = np.stack([words == 0, words <= 3, words <= 10, words > 60], 1)
    return np.concatenate([r, *(r > s for s in _STEPS), flags], 1).astype(np.float32), size, counts


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours, weight of each line, and lines of each text."""
    own, size, counts = _own(texts)
    total = len(own)
    first = np.zeros(total, bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last = np.zeros(total, bool)
    last[ends - 1] = True
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    x = np.concatenate([np.ones((total, 1), np.float32), own, before, after, first[:, None], last[:, None]], 1)
    return x.astype(np.float32), size + 1.0, counts


def forward_backward(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the log of the partition functions' product.

    emit: scores of the state "good" over "bad" for each line, chains one after
    the other. All chains step together; ``counts`` says how long each is.
    """
    n = len(emit)
    order = np.argsort(-counts, kind="stable")
    ends = np.cumsum(counts)
    starts = (ends - counts)[order]
    longest = int(counts.max()) if len(counts) else 0
    alive = np.searchsorted(-counts[order], -np.arange(longest), side="left")
    e = np.ones((n, 2))
    top = np.maximum(emit, 0)
    e[:, 1] = np.exp(emit - top)
    e[:, 0] = np.exp(-top)
    t = np.exp(trans)
    alpha, scale = np.empty((n, 2)), np.empty(n)
    for k in range(longest):
        at = starts[: alive[k]] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        z = a.sum(1)
        alpha[at], scale[at] = a / z[:, None], z
    beta = np.ones((n, 2))
    pairs = np.zeros((2, 2))
    for k in range(longest - 1, 0, -1):
        at = starts[: alive[k]] + k
        right = e[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = right @ t.T
        pairs += (alpha[at - 1].T @ right) * t
    good = alpha * beta
    return good[:, 1] / good.sum(1), pairs, float(np.log(scale).sum() + top.sum())


def fit(x: np.ndarray, weight: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 200, penalty: float = 3.0) -> dict:
    """Weights that maximise the chains' likelihood; every line of a document carries its label.

    L2-penalised, by L-BFGS. A logistic curve then maps a document's mean
    marginal to the share of good documents. One class only, or no document: the prior alone.
    """
    y = np.repeat(labels, counts).astype(float)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or share in (0.0, 1.0):
        w = np.zeros(N_FEATURES)
        w[0] = np.log((share * len(labels) + 1) / ((1 - share) * len(labels) + 1)) if len(labels) else 0.0
        return {"w": w, "trans": np.zeros((2, 2)), "curve": None}
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    state = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[:-1][inner[1:]], state[1:][inner[1:]]), 1)

    def loss(p):
        w, trans = p[:-4], p[-4:].reshape(2, 2)
        emit = x @ w
        good, pairs, log_z = forward_backward(emit, counts, trans)
        value = log_z - float(emit @ y) - float((seen * trans).sum())
        grad = np.concatenate([x.T @ (good - y), (pairs - seen).ravel()])
        pen = np.full(len(p), penalty)
        pen[0] = 0.01
        pen[-4:] = 10.0
        return (value + 0.5 * float(pen @ (p * p))) / len(y), (grad + pen * p) / len(y)

    p = _lbfgs(loss, np.zeros(N_FEATURES + 4), rounds)
    model = {"w": p[:-4], "trans": p[-4:].reshape(2, 2)}
    model["curve"] = _curve(_mean_marginal(x @ model["w"], weight, counts, model), labels)
    return model


def _lbfgs(f, p: np.ndarray, rounds: int, held: int = 10) -> np.ndarray:
    value, g = f(p)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            kept.append(a)
            q -= a * d
        if steps:
            s, d = steps[-1]
            q *= (s @ d) / (d @ d)
        for (s, d), a in zip(steps, reversed(kept)):
            q += (a - (d @ q) / (s @ d)) * s
        size, slope = 1.0 if steps else min(1.0, 1 / (np.abs(g).sum() + 1e-12)), -(g @ q)
        if slope >= 0:
            break
        while True:
            new, grad = f(p - size * q)
            if new <= value + 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, d = -size * q, grad - g
        p, done = p - size * q, abs(value - new) < 1e-7 * max(1, abs(value))
        value, g = new, grad
        if s @ d > 1e-12:
            steps = [*steps[1 - held :], (s, d)]
        if done:
            break
    return p


def _curve(mean: np.ndarray, labels: np.ndarray, rounds: int = 40, penalty: float = 0.02) -> list[float]:
    """slope and offset of P(label 1 | mean marginal), by Newton's method; the slope is never negative."""
    a, m = np.array([4.0, -2.0]), np.stack([mean, np.ones(len(mean))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m @ a))
        grad = m.T @ (p - labels) + penalty * a
        a = a - np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + penalty * np.eye(2), grad)
    return [float(max(a[0], 0.0)), float(a[1])] if np.isfinite(a).all() else [4.0, -2.0]


def _mean_marginal(emit: np.ndarray, weight: np.ndarray, counts: np.ndarray, model: dict) -> np.ndarray:
    good, _, _ = forward_backward(emit, counts, model["trans"])
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    """Quality of each whole text: the mean of its lines' P(good), weighted by their length, on the fitted curve."""
    if not texts:
        return np.zeros(0)
    own, size, counts = _own(texts)
    # the same sums as line_features(texts) @ w, without its wide table
    w = model["w"]
    part = own @ w[1 : 1 + 3 * N_OWN].reshape(3, N_OWN).T.astype(np.float32)
    emit = w[0] + part[:, 0].astype(float)
    ends = np.cumsum(counts)
    first, last = ends - counts, ends - 1
    before, after = np.roll(part[:, 1], 1), np.roll(part[:, 2], -1)
    before[first], after[last] = 0, 0
    emit += before + after
    emit[first] += w[-2]
    emit[last] += w[-1]
    mean = _mean_marginal(emit, size + 1.0, counts, model)
    if model["curve"] is None:
        return np.clip(mean, 0, 1)
    slope, offset = model["curve"]
    return 1 / (1 + np.exp(-(slope * mean + offset)))


def _rounds(texts: list[str]) -> Iterator[list[str]]:
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > ROUND_CHARS:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t) + 1
    if run:
        yield run


def quality(text: Column, model: dict) -> Column:
    """Score of whole texts, 0 to 1; a null text scores as an empty one."""

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [score_texts(run, model) for run in _rounds([t or "" for t in batch.to_pylist()])]
            yield pa.array(np.concatenate(found) if found else [], pa.float64())

    return score.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 0 by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _fit_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            x, weight, _ = line_features([text or ""])
            x = np.concatenate([weight[:, None].astype(np.float32), x], 1)
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["label", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> dict:
    """A model from at most ``fit_docs`` labelled documents, those whose id has the least hash, each with its whole text.

    Held-out rows are never learnt from. A label that is null is no label; of
    several labels of a document the least counts; rows with one id are rows of
    their own, up to twice the documents. Together they have at most
    ``fit_lines`` lines: in the order of a hash a document that would pass that
    is left out whole and the next is tried. So what reaches the driver is
    bounded: about 700 bytes for each line. Without a labelled row the score is
    0.5.
    """
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "label", F.xxhash64("doc_id", "text").alias("h"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(1))
    sized = cut(rows.withColumn("lines", F.greatest(lines, F.lit(1))).orderBy("h").limit(2 * fit_docs), "sample")
    chosen, held = [], 0
    for h, n in sorted(tuple(r) for r in sized.select("h", "lines").collect()):
        if held + n <= fit_lines:
            chosen.append(h)
            held += n
    picked = sized.join(F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in set(chosen)], "h long")), "h") if chosen else sized.limit(0)
    got = sorted(picked.select("text", "label").mapInArrow(_fit_features, "label int, n int, x binary").collect(), key=lambda r: (bytes(r["x"]), r["label"]))
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(r["n"], 1 + N_FEATURES) for r in got]) if got else np.zeros((0, 1 + N_FEATURES), np.float32)
    return fit(x[:, 1:].astype(float), x[:, 0].astype(float), np.array([r["n"] for r in got], int), np.array([r["label"] for r in got], int))


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs(doc_id, text)``.

    The score sees the text only. Empty and null texts are one empty line. A
    null doc_id is not held out and stays null. Repeated rows and equal texts get equal scores. An empty table gives no
    rows; other columns are left out.
    """
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, that a model of ``labels`` does not reject.

    Equal texts have one fate, so repeated rows stay or go together; a null
    text is judged as an empty one. Columns of ``docs`` may have any name. An
    empty table gives no rows.
    """
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, quality(F.col("text"), train(docs, labels))).where(F.col(name) >= threshold).drop(name)

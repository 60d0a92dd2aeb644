"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad, judged by features of itself and of the lines next to it, and by the state of the line before. The
field is trained on a bounded sample of labelled texts: lines take the label of their text, and after a first
fit the lines of bad texts that look good are relabelled, since a bad text need not be bad in every line. Forward-backward
marginals of being good, weighted by line length, give a text's quality, which is then calibrated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import held_out, map_texts, text_bytes
from tactus.llm.quality_rules import find_lines, repeats
from tactus.llm.training import class_weights, fit_platt, labelled_sample, sigmoid
from tactus.llm.words import find_words, hash_words, mix

#: Labelled texts of each class that are sampled for training, at most.
SAMPLE_PER_CLASS = 1000
FOLDS, HELD_OUT = 5, 0
GOOD_FROM = 0.3
BLOCK_BYTES = 1 << 20
_SYMBOLS = b"#*$%&|<>=_{}[]\\^~@+/"
_STOPS = b".,;:!?"


def _shares(per_line: np.ndarray, of: np.ndarray) -> np.ndarray:
    return per_line / np.maximum(of, 1)


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, bytes, features) of each line, in order; every text has one line at least."""
    doc, first, end = find_lines(data, at)
    size = (end - first).astype(float)
    n = len(doc)

    def count(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (c[end] - c[first]).astype(float)

    def among(chars: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(chars)] = True
        return t[data]

    upper = count((data >= 0x41) & (data <= 0x5A))
    lower = count((data >= 0x61) & (data <= 0x7A))
    digit, symbol, stop, bang = count((data >= 0x30) & (data <= 0x39)), count(among(_SYMBOLS)), count(among(_STOPS)), count(among(b"!"))
    wdoc, wfirst, wend = find_words(data, at, "space")
    h = hash_words(data, wfirst, wend, lower=True)
    # line of each word: no word crosses a line break
    line = np.searchsorted(first, wfirst, "right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    letters = np.bincount(line, wend - wfirst, minlength=n)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    several, lead = repeats(h ^ mix(line.astype(np.uint64) + np.uint64(1)))
    last = data[np.maximum(wend - 1, 0)] if len(wend) else np.zeros(0, np.uint8)
    sym_last = np.zeros(256, bool)
    sym_last[list(_SYMBOLS)] = True
    one = (wend - wfirst) == 1
    lh = hash_words(data, first, end, lower=False)
    _, fresh = repeats(lh ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    per_word = lambda mask: _shares(np.bincount(line[mask], minlength=n), words)
    own = np.stack(
        [
            np.minimum(np.log1p(size) / 6, 1.5),
            _shares(upper, upper + lower),
            _shares(digit, size),
            np.sqrt(_shares(symbol, size)),
            _shares(stop, words),
            _shares(bang, words),
            per_word(again),
            1 - per_word(lead),
            per_word(sym_last[last]),
            per_word(one),
            _shares(letters, words) / 10,
            (words == 0).astype(float),
            (words <= 3).astype(float),
            (~fresh & (words > 0)).astype(float),
        ],
        axis=1,
    )
    start = np.ones(n, bool)
    start[1:] = doc[1:] != doc[:-1]
    finish = np.append(start[1:], True) if n else start
    near = own[:, [1, 3, 5, 6, 7, 8]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[start], after[finish] = 0, 0
    return doc, size, np.concatenate([own, before, after, start[:, None], finish[:, None], np.ones((n, 1))], axis=1)


def _lanes(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, lines, texts by falling number of lines)."""
    lines = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    return first, lines, order


@dataclass
class LineField:
    weights: np.ndarray  # features: score of good against bad
    trans: np.ndarray  # 2 x 2: score of state (row) followed by state (column)
    slope: float = 1.0
    offset: float = 0.0

    def marginals(self, doc: np.ndarray, x: np.ndarray, n_docs: int, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each line is good; with pairs also the expected number of each transition for each line after a first one."""
        u = np.clip(x @ self.weights, -30, 30)
        local = np.stack([sigmoid(-u), sigmoid(u)], axis=1)
        t = np.exp(self.trans - self.trans.max())
        first, lines, order = _lanes(doc, n_docs)
        ahead, behind = local.copy(), np.ones_like(local)
        steps = int(lines.max()) if len(lines) else 0
        alive = np.searchsorted(-lines[order], -np.arange(steps + 1), "left")  # texts with more than k lines
        base = first[order]
        for k in range(1, steps):
            i = base[: alive[k]] + k
            a = (ahead[i - 1] @ t) * local[i]
            ahead[i] = a / a.sum(axis=1, keepdims=True)
        length = lines[order]
        for k in range(1, steps):
            m = alive[k]
            i = base[:m] + length[:m] - 1 - k
            b = (behind[i + 1] * local[i + 1]) @ t.T
            behind[i] = b / b.sum(axis=1, keepdims=True)
        both = ahead * behind
        good = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
        joint = np.zeros((2, 2))
        if pairs:
            inner = np.ones(len(doc), bool)
            inner[first[lines > 0]] = False
            i = np.flatnonzero(inner)
            j = ahead[i - 1][:, :, None] * t[None] * (local[i] * behind[i])[:, None, :]
            j /= j.sum(axis=(1, 2), keepdims=True)
            joint = j
        return good, joint

    def quality(self, doc: np.ndarray, size: np.ndarray, x: np.ndarray, n_docs: int) -> np.ndarray:
        """Logit of the mean marginal of a text's lines, weighted by their bytes (each one more, so that empty texts have a value)."""
        good, _ = self.marginals(doc, x, n_docs)
        w = size + 1
        mean = np.bincount(doc, good * w, minlength=n_docs) / np.maximum(np.bincount(doc, w, minlength=n_docs), 1e-300)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, *a) -> np.ndarray:
        return sigmoid(self.slope * self.quality(*a) + self.offset)


def _fit(doc, x, state, weight, n_docs, rounds: int, field: LineField) -> LineField:
    """Maximum likelihood of the given line states by Adam."""
    inner = np.zeros(len(doc), bool)
    inner[1:] = doc[1:] == doc[:-1]
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[i - 1], state[i]), weight[i])
    w, t = field.weights.copy(), field.trans.copy()
    total = weight.sum()
    m, v, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for k in range(1, rounds + 1):
        good, joint = LineField(w, t).marginals(doc, x, n_docs, pairs=True)
        g = (x.T @ (weight * (good - state))) / total + 1e-4 * w
        gt = ((joint * weight[i][:, None, None]).sum(axis=0) - seen) / total + 1e-3 * t if len(i) else 0 * t
        m, v, mt, vt = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt * gt
        a, b = 0.2 / (1 - 0.9**k), 1 - 0.99**k
        w -= a * m / (np.sqrt(v / b) + 1e-8)
        t -= a * mt / (np.sqrt(vt / b) + 1e-8)
    return LineField(w, t)


def train(sample: list[tuple[int, str, int]], counts: dict[int, int], rounds: int = 60) -> LineField:
    """Fit on four fifths of the sample and calibrate on all of it, weighted to the label shares of all labelled rows."""
    width = line_features(np.zeros(0, np.uint8), np.array([0, 0]))[2].shape[1]
    field = LineField(np.zeros(width), np.zeros((2, 2)))
    y = np.array([s[2] for s in sample], int)
    if len(set(y.tolist())) < 2:
        return LineField(field.weights, field.trans, 1.0, 2.0 if not len(y) or y[0] else -2.0)
    raw = [s[1].encode("utf-8", "replace") for s in sample]
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    doc, size, x = line_features(data, at)
    share = (size + 1) / np.bincount(doc, size + 1)[doc]  # a text counts once, whatever its length
    fit = np.arange(len(y)) % 5 != 0
    weight = share * (fit * class_weights(y, {0: 1, 1: 1}))[doc]
    state = y[doc]
    for _ in range(3):
        field = _fit(doc, x, state, weight, len(y), rounds, field)
        good, _ = field.marginals(doc, x, len(y))
        worst = np.full(len(y), 2.0)
        np.minimum.at(worst, doc, good)
        state = np.where((y[doc] == 0) & ((good < 0.5) | (good <= worst[doc])), 0, 1)
    z = field.quality(doc, size, x, len(y))
    slope, offset = fit_platt(z, y, class_weights(y, counts))
    return LineField(field.weights, field.trans, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> LineField:
    """Train on labelled rows outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "quality", per_class, held_out(F.col("doc_id"), FOLDS, HELD_OUT)))


def classify(docs: DataFrame, field: LineField, good_from: float = GOOD_FROM, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): the columns named in keep (doc_id by default), held_out, score, predicted, n_lines.

    Null and empty texts have one empty line and a score like any other. Repeated rows score alike; an empty table
    gives an empty result; other columns are ignored.
    """
    keep = keep or ["doc_id"]
    packed = docs.sparkSession.sparkContext.broadcast(field)  # a few dozen weights

    def block():
        def score(texts: pa.Array) -> dict:
            doc, size, x = line_features(*text_bytes(texts))
            return {"score": packed.value.score(doc, size, x, len(texts)), "n_lines": np.bincount(doc, minlength=len(texts))}

        return score

    out = map_texts(docs, keep, block, "score double, n_lines long", BLOCK_BYTES)
    return out.select(*keep, held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= good_from).cast("int").alias("predicted"), "n_lines")

"""Quality rules: counted base rules, then a hashed n-gram logistic regression.

Features are hashed words and word pairs, and hashed n-grams of characters (code points), each as its share of the text's words, pairs
or n-grams, so a score is a mean of weights and the length of a text doesn't matter. The model is trained on a bounded sample of labelled
rows, calibrated on a part of it that training doesn't see, and applied to whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import row_blocks, text_bytes
from tactus.llm.training import class_weights, fit_platt, labelled_sample, sigmoid
from tactus.llm.words import find_words, hash_words, mix, windows

#: Labelled rows of each class that are sampled for training, at most.
SAMPLE_PER_CLASS = 1500
HASH_BITS = 16
GRAM = 3
#: A text is kept if its calibrated probability of good quality is this or more.
KEEP_AT = 0.5
#: Base rules: fewest words, and most percent of words in repeated 5-word windows.
LEAST_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
BLOCK_BYTES = 2 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[at])


def find_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first byte, end) of each \\n-separated line; an empty text has one empty line."""
    n = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    doc = np.searchsorted(at, breaks, "right") - 1
    docs = np.concatenate([np.arange(n), doc])
    first = np.concatenate([at[:-1], breaks + 1])
    end = np.concatenate([at[1:], breaks])
    o = np.lexsort((first, docs))
    docs, first = docs[o], first[o]
    # the i-th line of a text ends at its i-th break, the last one at the text's end
    ends = np.concatenate([breaks, at[1:]])
    e = np.lexsort((np.concatenate([np.zeros(len(breaks)), np.ones(n)]), ends, np.concatenate([doc, np.arange(n)])))
    return docs, first, ends[e]


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is one of several equal values, is the first or only one) for each value."""
    o = np.argsort(key, kind="stable")
    s = key[o]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    several, lead = np.empty(len(key), bool), np.empty(len(key), bool)
    several[o], lead[o] = same[1:] | same[:-1], ~same[:-1]
    return several, lead


def base_counts(data: np.ndarray, at: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base counts of each text, and its words as (document number, hash)."""
    n = len(at) - 1
    doc, first, end = find_words(data, at, "space")
    h = hash_words(data, first, end, lower=False)
    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64)}
    lead = (data & 0xC0) != 0x80  # first bytes of code points
    in_word = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    out["word_chars"] = np.bincount(doc, in_word[end] - in_word[first], minlength=n).astype(np.int64)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = _sums(symbol[data], at)
    ldoc, lfirst, lend = find_lines(data, at)
    worded = np.searchsorted(first, lfirst) < np.searchsorted(first, lend)
    ldoc, lfirst, lend = ldoc[worded], lfirst[worded], lend[worded]
    lh = hash_words(data, lfirst, lend, lower=False)
    _, fresh = repeats(lh ^ mix(ldoc.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(ldoc[~fresh], minlength=n).astype(np.int64)
    i, w = windows(doc, h, REPEAT_WINDOW)
    several, _ = repeats(w ^ mix(doc[i].astype(np.uint64) + np.uint64(1)))
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, i[several], 1)
    np.add.at(step, i[several] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=n).astype(np.int64)
    return out, doc, h


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, each as its bytes in one number, and offsets of the texts among them."""
    lead = (data & 0xC0) != 0x80
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(data)))
    out = data[first].astype(np.uint32)
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] = out[more] << np.uint32(8) | data[first[more] + i]
    return out, np.concatenate([[0], np.cumsum(lead)])[at]


def gram_slots(chars: np.ndarray) -> np.ndarray:
    """Hash slot of the n-gram of characters that starts at each character (the last GRAM-1 have none)."""
    n = max(0, len(chars) - GRAM + 1)
    g = np.zeros(n, np.uint32)
    for i in range(GRAM):
        g = (g ^ chars[i : n + i]) * np.uint32(0x9E3779B1)
        g ^= g >> np.uint32(15)
    return (g * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)


def word_slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


#: Kinds of features: words, pairs of neighbouring words, n-grams of characters.
KINDS = 3


def feature_slots(data: np.ndarray, at: np.ndarray, doc: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document number, slot) of the features of each kind."""
    i, pairs = windows(doc, h, 2)
    chars, of = characters(data, at)
    grams = gram_slots(chars)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(of))
    whole = np.flatnonzero(owner[: len(grams)] == owner[GRAM - 1 :])
    return [(doc, word_slots(h)), (doc[i], word_slots(pairs)), (owner[whole], grams[whole].astype(np.int64))]


@dataclass
class NgramModel:
    weights: np.ndarray  # kind, slot
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        out = np.full(n, self.bias)
        for weights, (owner, slots) in zip(self.weights, feature_slots(data, at, doc, h), strict=True):
            out += np.bincount(owner, weights[slots], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
        return out

    def probability(self, *a) -> np.ndarray:
        return sigmoid(self.slope * self.logit(*a) + self.offset)


def train(sample: list[tuple[int, str, int]], counts: dict[int, int], rounds: int = 120, ridge: float = 1e-6) -> NgramModel:
    """Fit by Adam on the whole sample's sparse feature matrix; every fifth row calibrates instead."""
    size = 1 << HASH_BITS
    if not sample or len({y for *_, y in sample}) < 2:  # nothing to learn from: keep everything that the base rules keep
        return NgramModel(np.zeros((KINDS, size), np.float32), 10.0)
    y = np.array([s[2] for s in sample])
    rows, cols, vals = [], [], []
    for r, (_, text, _) in enumerate(sample):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        at = np.array([0, len(data)])
        doc, first, end = find_words(data, at, "space")
        for kind, (_, slots) in enumerate(feature_slots(data, at, doc, hash_words(data, first, end, False))):
            u, c = np.unique(slots, return_counts=True)
            rows.append(np.full(len(u), r))
            cols.append(u + kind * size)
            vals.append(c / max(1, len(slots)))
    rows, cols, vals = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    fit = np.arange(len(sample)) % 5 != 0
    use = fit[rows]
    fr, fc, fv = rows[use], cols[use], vals[use]
    balance = class_weights(y, {0: 1, 1: 1}) * fit
    w, b = np.zeros(KINDS * size), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(fr, fv * w[fc], minlength=len(y)) + b
        d = balance * (sigmoid(z) - y) / fit.sum()
        g = np.bincount(fc, fv * d[fr], minlength=KINDS * size) + ridge * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a = 1.0 / (1 - 0.9**t)
        w -= a * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        b -= 0.1 * a * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-7)
    z = np.bincount(rows, vals * w[cols], minlength=len(y)) + b
    held = ~fit
    slope, offset = fit_platt(z[held], y[held], class_weights(y, counts)[held])
    return NgramModel(w.reshape(KINDS, size).astype(np.float32), b, slope, offset)


_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", p_good double"


def _scorer(packed):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = packed.value
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                data, at = text_bytes(b.column("text"))
                counts, doc, h = base_counts(data, at)
                p = model.probability(data, at, doc, h)
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | counts | {"p_good": p})

    return score


def fit_rules(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> NgramModel:
    return train(*labelled_sample(docs, labels, "quality", per_class))


def apply_rules(docs: DataFrame, model: NgramModel, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per row of docs (doc_id, text): the base counts, base_failed, p_good and kept.

    Null and empty texts have zero counts and fail the base rules. Repeated rows are judged alike; an empty
    table gives an empty result; very long texts are scored whole; other columns are ignored.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)  # 2**HASH_BITS weights of each kind
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(packed), _SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_good") >= keep_at))

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each document becomes a fixed row of statistics of its bytes, words and lines. Trees
of one depth are boosted on binned statistics of a bounded sample of labelled
documents and flattened into arrays: of each inner node its feature and threshold, in
heap order, and of each leaf its value. A batch walks all trees together, one step of
numpy indexing for each level. Statistics and scores take one pass without a shuffle.

Defined results: a null text counts as empty and has its own score like any text; texts
are read whole; repeated rows get equal scores; without labels of both kinds every
score is the share of label 1 (0.5 without labels); an empty table gives an empty table.
A null id is not held out. Only doc_id and text are read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import map_rows, raw_texts
from chatpack.llm.labelled import is_held_out, sample

#: Labelled documents that the trees are fitted on, about.
MAX_ROWS = 40_000
HELD_OUT = (5, 0)
CUT = 0.3

_UPPER, _LOWER, _DIGIT, _SPACE, _MARK, _SYMBOL, _HIGH, _CONT = range(8)


def _classes() -> np.ndarray:
    """A row for each byte with its classes."""
    out = np.zeros((256, 8))
    out[65:91, _UPPER] = out[97:123, _LOWER] = out[48:58, _DIGIT] = out[128:, _HIGH] = out[128:192, _CONT] = 1
    out[[9, 10, 11, 12, 13, 32], _SPACE] = 1
    out[[ord(c) for c in ".,;:!?'\"()-"], _MARK] = 1
    out[[ord(c) for c in "#*$%&|<>@^_=+~{}[]\\/`"], _SYMBOL] = 1
    return out


CLASSES = _classes()
FEATURES = 27


def statistics(text: bytes) -> list[float]:
    """The row of one document."""
    n = len(text)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    c = counts @ CLASSES
    chars = n - c[_CONT]
    p = counts[counts > 0] / n
    words = text.split()
    k = max(len(words), 1)
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    ends = sum(x.endswith((b".", b"!", b"?")) for x in lines)
    upper = sum(map(bytes.isupper, words))
    alpha = sum(map(bytes.isalpha, words))
    marked = sum(w[-1] in b"#*$%&!|" for w in words)
    capital = sum(w[0] in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" for w in words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        np.log1p(chars), np.log1p(len(words)), np.log1p(len(lines)),
        *(c[:7] / n), -float((p * np.log(p)).sum()),
        size.mean(), size.std(), size.max(),
        len(seen) / k, max(seen.values(), default=0) / k, pairs / max(len(words) - 1, 1), same / k,
        upper / k, alpha / k, marked / k, capital / k,
        len(words) / m, ends / m, len(set(lines)) / m, counts[124] / n, counts[33] / n,
    ]


def statistics_of(texts) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows, np.float64).reshape(-1, FEATURES)


@dataclass
class Trees:
    """Complete trees of one depth: (tree, node) features and thresholds, (tree, leaf) values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values that each row reaches, all trees together."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None], np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        while len(self.feature) and len(x) and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.start + (self.value[tree, at - inner].sum(axis=1) if len(self.feature) else np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, ridge: float = 2.0, least: float = 5.0) -> Trees:
    """Boosted trees of the logistic loss; splits are searched in histograms of ``bins`` quantile bins."""
    inner, leaves, d = 2**depth - 1, 2**depth, x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    if not len(y) or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(d)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(d)], axis=1)
    raw, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best, choice = np.full(width, 1e-6), [None] * width
            for f in range(d):
                slot = (at - first) * bins + code[:, f]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least / 4) | (ht - hl < least / 4)] = 0
                gain[:, len(cuts[f]) :] = 0
                k = gain.argmax(axis=1)
                for node in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[node], choice[node] = gain[node, k[node]], (f, k[node])
            for node, c in enumerate(choice):
                if c:
                    feature[first + node], threshold[first + node] = c[0], cuts[c[0]][c[1]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        trees.append((feature, threshold, value))
    f, t, v = (np.stack(z) for z in zip(*trees))
    return Trees(f, t, v, start)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Trees:
    """Trees for label quality from at most about ``most`` rows outside the held-out part."""
    rows = sample(docs, labels, "quality", *HELD_OUT, most)
    table = map_rows(
        rows, lambda: lambda b: [pa.array(list(statistics_of(raw_texts(b, "text")))), b.column("label")], "x array<double>, y int", ["x", "y"]
    ).toArrow()
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # rows come in any order
    return fit(x[order], table.column("y").to_numpy().astype(np.float64)[order])


def classify(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        model = shared.value

        def step(batch):
            score = model.score(statistics_of(raw_texts(batch, "text")))
            return [batch.column("doc_id"), score, (score >= cut).astype(np.int32)]

        return step

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int", ["doc_id", "score", "predicted"])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return classify(docs, train(docs, labels)).select("doc_id", is_held_out(*HELD_OUT).alias("held_out"), "score", "predicted")

"""Toxicity by compression distance: windows of text under a toxic and an ordinary dictionary.

Two zstandard dictionaries are trained, each by zstandard's trainer. The ordinary one comes from ordinary
documents. The toxic one comes from what stands out in toxic documents: the stretches of their text whose
byte n-grams far more toxic than ordinary documents hold, in enough different contexts (copies of a document repeat
theirs; of whole toxic documents the trainer takes what is common, which is ordinary). Toxic text is mostly ordinary, so a window is compressed under the ordinary dictionary,
and under the ordinary one followed by the toxic one; what it gains is its distance. A document's score is a calibrated
(logistic) function of its best windows' differences and of how many exceed thresholds.

Everything is fitted on a bounded sample of labelled documents. Its counts are Spark
aggregations; the driver gets the n-grams that toxic documents share (up to a fixed number), fixed numbers of ordinary texts
of bounded size and of toxic documents' different stretches for the trainers, and a row of numbers for each sampled document.
Lengths, ratio and dictionary sizes were chosen by cross-validation inside the rows that are not held out.
Scoring is one pass without a shuffle.

Defined results: a null text counts as empty: it has one empty window and a low score;
texts are read whole; repeated rows get equal scores; without labels of both kinds
every score is the share of label 1 (0 without labels); an empty table gives an
empty table. A null id is not held out. Only doc_id and text are read for a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import map_rows, raw_texts
from chatpack.llm.components import stored
from chatpack.llm.labelled import is_held_out, sample

#: Labelled documents that everything is fitted on, about.
MAX_ROWS = 30_000
HELD_OUT = (4, 2)
CUT = 0.3
#: Bytes of a window and between windows, of the shortest matches, and of the two dictionaries.
WINDOW, STEP, MATCH, DICTIONARY, TOXIC_DICTIONARY = 64, 32, 6, 24_000, 1_000
#: Bytes of the n-grams, and of the contexts before and after them that are told apart.
GRAMS, BEFORE, AFTER = (6, 7, 8), 4, 6
#: N-grams that the driver takes, ordinary texts and toxic documents of the trainers' sample, and characters of the sample's longest ordinary text.
MAX_GRAMS, TRAINER_TEXTS, TRAINER_TOXIC, TRAINER_LONGEST = 200_000, 400, 4_000, 50_000
#: Log ratio of shares from which an n-gram stands out, and the least share of toxic documents and least number of contexts for each of them.
LOG_RATIO, LEAST_SHARE = 4.0, 1 / 50
#: Byte differences whose windows are counted; the last counts windows nearer to ordinary text.
THRESHOLDS = (3, 4, 5, 6, 8)
NEARER = -3
#: Numbers of a document: three best windows, counts by threshold, nearer ones, windows, constant.
NUMBERS = 3 + len(THRESHOLDS) + 3


def normal(text: bytes) -> bytes:
    """A-Z lower-cased, and single spaces between and around words."""
    return b" " + b" ".join(text.lower().split()) + b" "


def word_grams(text: bytes, known: set[bytes] | None = None) -> Iterator[tuple[bytes, int, bytes]]:
    """(n-gram, place, text) of the byte n-grams that lie in one word, or start with the space before it."""
    t = normal(text)
    for n in GRAMS:
        for k in range(len(t) - n + 1):
            g = t[k : k + n]
            if (known is None or g in known) and b" " not in g[1:]:
                yield g, k, t


def stretches(text: bytes, grams: set[bytes]) -> bytes:
    """The different stretches of a text that the given n-grams cover, each after a space."""
    marks = sorted((k, k + len(g)) for g, k, _ in word_grams(text, grams))
    t, out, end = normal(text), {}, -1
    for a, b in marks:
        if a > end:
            if end >= 0:
                out[t[start:end]] = None
            start = a
        end = max(end, b)
    if marks:
        out[t[start:end]] = None
    return b"".join(x if x[:1] == b" " else b" " + x for x in out)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Longer matches only, so that chance matches of short syllables cost nothing."""
    params = zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=16, chain_log=16, search_log=6, min_match=MATCH, target_length=16,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


class Windows:
    """Statistics of the differences in compressed size over a text's windows."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = _packer(ordinary).compress, _packer(toxic).compress

    def row(self, text: bytes) -> list[float]:
        t = normal(text)
        plain, toxic = self.plain, self.toxic
        d = np.array([len(plain(w)) - len(toxic(w)) for w in (t[k : k + WINDOW] for k in range(0, max(1, len(t) - WINDOW + STEP), STEP))])
        top = np.sort(np.concatenate([d, [0, 0, 0]]))[::-1][:3]
        return [*top, *(np.log1p((d >= x).sum()) for x in THRESHOLDS), np.log1p((d <= NEARER).sum()), np.log(len(d)), 1.0]

    def rows(self, texts) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(-1, NUMBERS)


def _shared_grams(toxic_rows: DataFrame, least: float) -> DataFrame:
    """(item, toxic): n-grams and the documents that hold them, of at least ``least``; summed by task first."""

    def run(batches):
        n: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["item", "toxic"])

        for batch in batches:
            for text in raw_texts(batch, "text"):
                n.update({g for g, _, _ in word_grams(text)})
                if len(n) > 500_000:
                    yield from out()
                    n.clear()
        yield from out()

    return toxic_rows.select("text").mapInArrow(run, "item binary, toxic long").groupBy("item").agg(F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)


def _contexts(rows: DataFrame, grams) -> DataFrame:
    """(item, contexts, ordinary): in how many contexts toxic documents have an n-gram, and how many ordinary documents have it."""

    def run(batches):
        known, ordinary, contexts = grams.value, Counter(), set()
        for batch in batches:
            for text, label in zip(raw_texts(batch, "text"), batch.column("label").to_pylist()):
                if label:
                    contexts.update((g, xxhash.xxh64_intdigest(t[max(0, k - BEFORE) : k] + b"\0" + t[k + len(g) : k + len(g) + AFTER]) >> 1) for g, k, t in word_grams(text, known))
                else:
                    ordinary.update({g for g, _, _ in word_grams(text, known)})
        items = [*ordinary, *(g for g, _ in contexts)]
        n = pa.array([*ordinary.values(), *[0] * len(contexts)], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.binary()), n, pa.array([*[None] * len(ordinary), *(c for _, c in contexts)], pa.int64())], names=["item", "ordinary", "context"])

    found = rows.mapInArrow(run, "item binary, ordinary long, context long")
    return found.groupBy("item").agg(F.count_distinct("context").alias("contexts"), F.sum("ordinary").alias("ordinary"))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Model:
    rows = stored(sample(docs, labels, "toxic", *HELD_OUT, most))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, plain = n.get(1, 0), n.get(0, 0)
    flat = np.zeros(NUMBERS)
    if not toxic or not plain:
        flat[-1] = 30.0 if toxic else -30.0
        return Model(b"ordinary", b"toxic", flat)
    context = docs.sparkSession.sparkContext
    least = max(3, toxic * LEAST_SHARE)
    common = _shared_grams(rows.where("label = 1"), least).orderBy(F.desc("toxic"), "item").limit(MAX_GRAMS).collect()
    known = context.broadcast({bytes(r["item"]) for r in common})
    ratio = F.log((F.col("contexts") + 0.5) / (toxic + 1)) - F.log((F.col("ordinary") + 0.5) / (plain + 1))
    chosen = _contexts(rows, known).where((F.col("contexts") >= least) & (ratio >= LOG_RATIO)).collect()
    shared = docs.sparkSession.sparkContext.broadcast({bytes(r["item"]) for r in chosen})

    def cut_out():
        grams = shared.value
        return lambda b: [pa.array([stretches(t, grams) for t in raw_texts(b, "text")], pa.binary())]

    marked = map_rows(rows.where("label = 1"), cut_out, "part binary", ["part"]).where("length(part) > 0")
    parts = [bytes(r["part"]) for r in marked.distinct().orderBy(F.xxhash64("part"), "part").limit(TRAINER_TOXIC).collect()]
    texts = [normal(r["text"].encode()) for r in rows.where(f"label = 0 and length(text) between 1 and {TRAINER_LONGEST}").orderBy(F.xxhash64("text")).select("text").limit(TRAINER_TEXTS).collect()]
    ordinary = _trained(texts, DICTIONARY)
    model = Model(ordinary, ordinary + _trained(parts, TOXIC_DICTIONARY), flat)
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w = Windows(shared_model.value.ordinary, shared_model.value.toxic)
        return lambda b: [pa.array(list(w.rows(raw_texts(b, "text")))), b.column("label")]

    got = map_rows(rows, make, "x array<double>, y int", ["x", "y"]).toArrow()
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(-1, len(flat))
    order = np.lexsort(x.T)  # rows come in any order
    model.weights = calibrated(x[order], got.column("y").to_numpy().astype(np.float64)[order])
    return model


def _trained(texts: list[bytes], size: int) -> bytes:
    """A dictionary of ``size`` bytes; of small sets of texts, which the trainer refuses, the texts as they are."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:size] or b"nothing"


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def classify(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        m = shared.value
        windows = Windows(m.ordinary, m.toxic)

        def step(batch):
            score = 1 / (1 + np.exp(-np.clip(windows.rows(raw_texts(batch, "text")) @ m.weights, -30, 30)))
            return [batch.column("doc_id"), score, (score >= cut).astype(np.int32)]

        return step

    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int", ["doc_id", "score", "predicted"])


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return classify(docs, train(docs, labels)).select("doc_id", is_held_out(*HELD_OUT).alias("held_out"), "score", "predicted")

"""Quality rules: plain counts, and a log-likelihood ratio of hashed word n-grams.

Two multinomials over hashed word unigrams and bigrams are counted over the whole
table: one of all documents, one of the trusted documents (the target). A document's
score is the mean of log(p_target / p_raw) over its n-grams, and documents whose
score is under a threshold are rejected, besides those that the plain rules reject.

The threshold is calibrated: it is ``MARGIN`` under the score below which ``REJECTED`` of the trusted documents lie, each
scored with counts that leave it out. Trusted documents that the plain rules reject have no say in it.

All documents are in the raw counts and all trusted ones in the target's, whatever their number. Up to
``MAX_BROADCAST`` trusted ids are broadcast. Of more of them a bit map of fixed size is, which thins the
documents before the rest are joined by a shuffle, with the same counts.

The number of hash buckets grows with the square root of the text, as vocabularies do. Counting is one
pass. Each task adds up its documents and emits the buckets it has seen. Models of up to ``DENSE`` buckets
are broadcast. Larger ones stay tables: documents are scored in blocks, each joined with the buckets that its texts need.

Defined results: a null or empty text has no words, all its counts are 0 and it is
rejected by the plain rules; texts are read whole; repeated rows count as often as
they occur; without a trusted document every
score is 0 and the plain rules decide; an empty table
gives an empty table. Documents without a label, or with a null id, are raw only;
ids may be of any type, and are compared as text unless all are integers; other columns may have any names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatpack.llm.arrow import pieces, raw_texts
from chatpack.llm.components import stored

#: Hash buckets for each square root of the table's bytes, and at least.
BUCKETS_PER_ROOT, LEAST_BUCKETS = 16, 1 << 12
#: Buckets of a model that is broadcast, at most.
DENSE = 1 << 22
#: Documents that are scored together with a model that is not broadcast.
BLOCK_ROWS = 20_000
#: Prior count of every bucket in both multinomials, on the target's scale.
SMOOTHING = 10.0
#: Share of the trusted documents that lie below the calibrated score, how far the threshold is below
#: it (texts that only the raw counts hold, copies above all, score lower), and the bins and range of scores.
REJECTED, MARGIN, BINS, RANGE = 0.002, 0.1, 20_000, 10.0
#: Ids of trusted documents that are broadcast at most, and bits of the map that is broadcast of more of them.
MAX_BROADCAST, BITS = 400_000, 1 << 26
#: N-grams of a task that are counted together.
WAITING = 1 << 20
#: Words that a task remembers with their hash.
CACHED_WORDS = 200_000

# Fixed values of the plain rules.
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20


class _Hashes(dict):
    """Words with a 32-bit hash; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        out = self[word] = zlib.crc32(word)
        return out


def grams(words: list[bytes], known: _Hashes, buckets: int) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    mix = np.uint64(0x9E3779B97F4A7C15)
    top = np.uint64(64 - (buckets.bit_length() - 1))
    one = (h + np.uint64(1)) * mix >> top
    two = ((h[:-1] + np.uint64(1)) * mix + h[1:] + np.uint64(1)) * mix >> top
    return np.concatenate([one, two]).astype(np.int64)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that stand in the text at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    code = w[:n].copy()
    size = len(ids)
    for k in range(1, window):  # exact codes: renumbered before they could overflow
        if int(code.max()) + 1 > (1 << 62) // size:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * size + w[k : n + k]
    _, where, times = np.unique(code, return_inverse=True, return_counts=True)
    twice = times[where] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def plain_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    solid = text.translate(None, WHITE)
    chars = int(((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80).sum())
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def buckets_for(docs: DataFrame) -> int:
    """A power of two that grows with the square root of the text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 << max(LEAST_BUCKETS, int(BUCKETS_PER_ROOT * size**0.5)).bit_length()


def _free(name: str, *tables: DataFrame) -> str:
    """``name``, with signs after it until no table has such a column."""
    while any(name in t.columns for t in tables):
        name += "_"
    return name


def _ids(docs: DataFrame, trusted: DataFrame, name: str) -> tuple[Column, DataFrame]:
    """The documents' ids, and the distinct trusted ones in a column ``name``, of a type that both have."""
    whole = all(isinstance(t.schema["doc_id"].dataType, T.IntegralType) for t in (docs, trusted))
    own = F.col("doc_id").cast("long" if whole else "string")
    return own, trusted.select(own.alias(name)).where(F.col(name).isNotNull()).distinct()


def marked(docs: DataFrame, trusted: DataFrame, most: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame | None]:
    """(text, target) of documents, whether each is one of ``trusted`` by its doc_id; and (text) of more trusted ones, beyond a broadcast."""
    own, ids = _ids(docs, trusted, "__id")
    rows = docs.select("text", own.alias("__doc"))
    if ids.count() <= most:
        marks = F.broadcast(ids.withColumn("target", F.lit(True)))
        return rows.join(marks, F.col("__doc") == F.col("__id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target")), None
    return rows.select("text", F.lit(False).alias("target")), targets(docs.select("doc_id", "text"), trusted, most).select("text")


def targets(docs: DataFrame, trusted: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs`` whose doc_id is one of ``trusted``."""
    key, mark = _free("__id", docs), _free("__bit", docs)
    own, ids = _ids(docs, trusted, key)
    same = own == F.col(key)
    if ids.count() <= most:
        return docs.join(F.broadcast(ids), same, "left_semi")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    words = ids.select(bit(key).alias("k")).groupBy(F.floor(F.col("k") / 32).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(k % 32 as int)))").alias("bits")).toArrow()
    found = np.zeros(BITS // 32, np.uint32)
    found[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def some(batches):
        for batch in batches:
            k = batch.column(mark).to_numpy()
            hit = shared.value[k // 32] >> (k % 32).astype(np.uint32) & 1
            yield batch.filter(pa.array(hit.astype(bool))).drop_columns([mark])

    thinned = docs.where("doc_id is not null").withColumn(mark, bit(own)).mapInArrow(some, docs.schema)
    return thinned.join(ids, same, "left_semi")


def count_grams(docs: DataFrame, trusted: DataFrame, buckets: int, most: int = MAX_BROADCAST, dense: int = DENSE) -> DataFrame:
    """(bucket, raw_n, target_n) over all documents; ``trusted`` has the doc_id of the target's."""

    def emitted(k, *n):
        for at in range(0, len(k), 10_000):
            s = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[s]), *(pa.array(x[s]) for x in n)], names=["bucket", "raw_n", "target_n"])

    def counter(of_raw: bool):
        def run(batches):
            known, few = _Hashes(), buckets <= dense
            sums = np.zeros((2, buckets if few else 0), np.int64)
            waiting, n = ([], []), 0

            def joined(mark):
                out = np.concatenate([np.zeros(0, np.int64), *waiting[mark]])
                waiting[mark].clear()
                return out

            def flushed():
                """Adds what waits to the sums, or emits it if there are too many buckets for them."""
                raw, target = joined(0), joined(1)
                k = None if few else np.unique(np.concatenate([raw, target]))
                tally = lambda g: np.bincount(g, minlength=buckets) if few else np.bincount(np.searchsorted(k, g), minlength=len(k))
                both = tally(target)
                raw = tally(raw) + both if of_raw else np.zeros_like(both)
                if few:
                    sums[0] += raw
                    sums[1] += both
                else:
                    yield from emitted(k, raw, both)

            for batch in batches:
                marks = batch.column("target").to_pylist() if of_raw else [True] * batch.num_rows
                for text, mark in zip(raw_texts(batch, "text"), marks):
                    if words := text.split():
                        waiting[mark].append(grams(words, known, buckets))
                        n += len(waiting[mark][-1])
                    if n > WAITING:
                        yield from flushed()
                        n = 0
            yield from flushed()
            seen = np.flatnonzero(sums[0] + sums[1])
            yield from emitted(seen, sums[0][seen], sums[1][seen])

        return run

    kind = "bucket long, raw_n long, target_n long"
    all_rows, more = marked(docs, trusted, most)
    found = all_rows.mapInArrow(counter(True), kind)
    if more is not None:
        found = found.union(more.mapInArrow(counter(False), kind))
    return found.groupBy("bucket").agg(F.sum("raw_n").alias("raw_n"), F.sum("target_n").alias("target_n"))


@dataclass
class Model:
    """Counts of buckets in the target and, on its scale, in all documents; of all buckets, or of those that are named."""

    target: np.ndarray
    raw: np.ndarray
    share: float
    buckets: int
    names: np.ndarray | None = None
    smoothing: float = SMOOTHING

    def __post_init__(self):
        self.ratio = np.log((self.target + self.smoothing) / (self.raw + self.smoothing)).astype(np.float32)

    def score(self, g: np.ndarray) -> float:
        """Mean log ratio of a text's buckets."""
        at = g if self.names is None else np.searchsorted(self.names, g)
        return float(self.ratio[at].mean(dtype=np.float64)) if len(g) else 0.0

    def score_without(self, g: np.ndarray) -> float:
        """The score of a target's text by the counts of all others."""
        k, n = np.unique(g if self.names is None else np.searchsorted(self.names, g), return_counts=True)
        ratio = np.log((np.maximum(self.target[k] - n, 0) + self.smoothing) / (np.maximum(self.raw[k] - self.share * n, 0) + self.smoothing))
        return float((ratio * n).sum() / max(n.sum(), 1))


def model(counts: DataFrame, buckets: int) -> Model:
    """The model as arrays over all buckets, for up to ``DENSE`` of them.

    Raw counts are scaled to the target's total before the prior is added to both, so
    that a bucket with few documents says little about either.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    got = counts.toArrow()
    k = got.column("bucket").to_numpy()
    raw[k] = got.column("raw_n").to_numpy()
    target[k] = got.column("target_n").to_numpy()
    share = float(target.sum() / max(raw.sum(), 1.0))
    return Model(target, raw * share, share, buckets)


def scored(docs: DataFrame, counts: DataFrame, buckets: int, make, schema: str, dense: int = DENSE) -> DataFrame:
    """``make(batch, model, hashes)`` over batches of ``docs``, with the counts that their texts need.

    A model of up to ``dense`` buckets is broadcast. A larger one is joined with the buckets of
    blocks of documents, and each block meets its part of the model in a task.
    """
    if buckets <= dense:
        shared = docs.sparkSession.sparkContext.broadcast(model(counts, buckets))

        def run(batches):
            known, m = _Hashes(), shared.value
            for batch in batches:
                for part in pieces(batch):
                    yield make(part, m, known)

        return docs.mapInArrow(run, schema)

    totals = counts.agg(F.sum("target_n"), F.sum("raw_n")).first()
    share = (totals[0] or 0) / max(totals[1] or 0, 1)
    block_of = _free("__block", docs)
    numbered = stored(docs.withColumn(block_of, F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).cast("long")))

    def needed(batches):
        known = _Hashes()
        for batch in batches:
            number = batch.column("__block").to_numpy()
            for block in np.unique(number).tolist():
                own = batch.filter(pa.array(number == block))
                k = np.unique(np.concatenate([np.zeros(0, np.int64), *(grams(t.split(), known, buckets) for t in raw_texts(own, "text"))]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k)], names=["__block", "bucket"])

    parts = numbered.select(F.col(block_of).alias("__block"), "text").mapInArrow(needed, "__block long, bucket long").distinct().join(counts, "bucket")

    def together(rows: pa.Table, part: pa.Table) -> pa.Table:
        part, known = part.sort_by("bucket"), _Hashes()
        m = Model(part.column("target_n").to_numpy(), part.column("raw_n").to_numpy() * share, share, buckets, part.column("bucket").to_numpy())
        return pa.Table.from_batches([make(p, m, known) for b in rows.drop_columns([block_of]).combine_chunks().to_batches() for p in pieces(b)])

    return numbered.groupBy(block_of).cogroup(parts.groupBy("__block")).applyInArrow(together, schema)


def threshold_of(docs: DataFrame, trusted: DataFrame, counts: DataFrame, buckets: int, most: int = MAX_BROADCAST, dense: int = DENSE) -> float:
    """``MARGIN`` under the score below which ``REJECTED`` of the trusted documents lie that the plain rules keep; without any, below all scores."""

    def bins(part, m, known):
        out = []
        for text in raw_texts(part, "text"):
            words = text.split()
            if not failed(len(words), repeated_words(words)):
                x = m.score_without(grams(words, known, m.buckets))
                out.append(int(min(max((x + RANGE) / (2 * RANGE), 0.0), 1.0) * (BINS - 1)))
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["bin"])

    n = np.zeros(BINS, np.int64)
    rows = targets(docs.select("doc_id", "text"), trusted, most)
    for r in scored(rows, counts, buckets, bins, "bin int", dense).groupBy("bin").count().collect():
        n[r["bin"]] = r["count"]
    if not n.any():
        return -RANGE
    return float(np.searchsorted(np.cumsum(n), REJECTED * n.sum(), "right")) / (BINS - 1) * 2 * RANGE - RANGE - MARGIN


def judge(docs: DataFrame, counts: DataFrame, buckets: int, threshold: float, keep_rows: bool = False, dense: int = DENSE) -> DataFrame:
    """The counts, score and verdict of every document, or with ``keep_rows`` the rows of ``docs`` that are kept."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    kinds = [docs.schema["doc_id"].dataType.simpleString(), *["long"] * 5, "boolean", "double", "boolean"]
    schema = docs.schema if keep_rows else ", ".join(f"{n} {k}" for n, k in zip(names, kinds))

    def make(part, m, known):
        rows = []
        for text in raw_texts(part, "text"):
            words = text.split()
            counts = plain_counts(text, words)
            score = m.score(grams(words, known, m.buckets)) if words else 0.0
            base = failed(counts[0], counts[4])
            rows.append((*counts, base, score, not base and score >= threshold))
        if keep_rows:
            return part.filter(pa.array([r[-1] for r in rows], pa.bool_()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in zip(*rows))], names=names)

    return scored(docs if keep_rows else docs.select("doc_id", "text"), counts, buckets, make, schema, dense)


def _judged(docs: DataFrame, trusted: DataFrame, keep_rows: bool, buckets: int | None, most: int, dense: int) -> DataFrame:
    buckets = buckets or buckets_for(docs)
    counts = stored(count_grams(docs, trusted, buckets, most, dense))
    return judge(docs, counts, buckets, threshold_of(docs, trusted, counts, buckets, most, dense), keep_rows, dense)


def score_documents(docs: DataFrame, trusted: DataFrame, buckets: int | None = None, most: int = MAX_BROADCAST, dense: int = DENSE) -> DataFrame:
    """Counts over all documents, then every document's counts, score and verdict."""
    return _judged(docs, trusted, False, buckets, most, dense)


def filter_documents(docs: DataFrame, trusted: DataFrame, buckets: int | None = None, most: int = MAX_BROADCAST, dense: int = DENSE) -> DataFrame:
    """The documents that are kept, with their columns as they are."""
    return _judged(docs, trusted, True, buckets, most, dense)

"""The highest-scoring documents of each query text, by the Best Position Algorithm.

Term weights follow from counts over all documents. The scan then cuts the documents into shards. A
shard has an impact list for each query term, its documents by falling impact, and a table of places for
direct access: the place of a document in a list. For each query text the lists are read from the top, a few
places more each round; a document met for the first time is looked up in all lists, and its places count
as seen. The best position of a list is the end of its seen beginning. No unseen document can
score more than the impacts at the best positions together; when that is strictly below the k-th
score so far, the shard is done. Scores so far carry over from shard to shard of a task, and each task
returns k documents for each query text.

Query texts go to the tasks in blocks of at most BLOCK texts and BLOCK_BYTES bytes, a scan for each block.

Defined results: a null text has no terms; documents without a score are not returned; each row is a document
of its own, also if its id repeats; equal scores come by ascending id, a null id last; each row of the items
is a query text of its own; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatpack.llm.arrow import raw_texts

BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: Places of a shard's table for direct access, and documents of a shard.
PLACES, SHARD = 24_000_000, 16_000

# Which bytes are no part of a term.
_BETWEEN = [range(0x00, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x80)]
_FOLD = bytearray(bytes(range(256)).lower())
for _span in _BETWEEN:
    for _byte in _span:
        _FOLD[_byte] = 0x20
_FOLD = bytes(_FOLD)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased; all bytes of other scripts belong to terms."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Queries:
    """Query texts as lists of term numbers and how often each occurs."""

    def __init__(self, texts: list[bytes]):
        self.number: dict[bytes, int] = {}
        self.items = []
        for text in texts:
            counts = Counter(self.number.setdefault(t, len(self.number)) for t in terms(text))
            self.items.append((np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))

    def counts(self, found: list[bytes]) -> tuple[list[int], list[int]]:
        """Numbers and frequencies of the query terms among ``found``."""
        counts = Counter(map(self.number.get, found))
        counts.pop(None, None)
        return list(counts), list(counts.values())


class Shard:
    """Impact lists of the query terms over some documents, and the places of the documents in them."""

    def __init__(self, ids: list, sizes: list[int], postings: list[tuple[list[int], list[int]]], weights: np.ndarray, documents: int, length: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(ids)), [len(p[0]) for p in postings])
        term, tf = (np.concatenate([np.array(p[k], np.int64) for p in postings]) for k in (0, 1))
        m = np.array([100 - 75 + (75 * n * documents) // length for n in sizes], np.int64)[doc]
        impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        order = np.lexsort((doc, -impact, term))
        term, self.doc = term[order], doc[order]
        #: One entry more, for places past the end of the last list.
        self.impact = np.append(impact[order], 0)
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.place = np.full((len(weights), len(ids)), -1, np.int16)
        self.place[term, self.doc] = np.arange(len(term)) - self.start[term]

    def search(self, item: tuple[np.ndarray, np.ndarray], best: list[tuple], k: int) -> list[tuple]:
        """``best`` (negative score, id is null, id), joined by the shard's documents; the first k of them."""
        lists, times = item
        start, size = self.start[lists], self.start[lists + 1] - self.start[lists]
        lists, times, start, size = (x[size > 0] for x in (lists, times, start, size))
        if not len(lists):
            return best
        met = np.zeros(len(self.ids), bool)
        seen = np.zeros(len(self.impact), bool)
        position, read, step = np.zeros(len(lists), np.int64), 0, 1
        while True:
            places = read + np.arange(step)
            inside = places < size[:, None]
            docs = np.unique(self.doc[(start[:, None] + places)[inside]])
            read, step = read + step, 2 * step
            new = docs[~met[docs]]
            met[new] = True
            own = self.place[lists[:, None], new].astype(np.int64)
            there = own >= 0
            entry = np.where(there, start[:, None] + own, len(self.impact) - 1)
            seen[entry[there]] = True
            scores = (times[:, None] * self.impact[entry]).sum(0)
            best = self._join(best, new, scores, k)
            position = self._advance(seen, start, size, np.minimum(np.maximum(position, read), size))
            open_ = position < size
            bound = int((times * self.impact[start + position - 1])[open_].sum())
            if bound == 0 or len(best) == k and bound < -best[-1][0]:
                return best

    @staticmethod
    def _advance(seen: np.ndarray, start: np.ndarray, size: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Moves positions over seen places."""
        ahead = np.arange(64)
        moving = np.flatnonzero(position < size)
        while len(moving):
            places = position[moving, None] + ahead
            ok = (places < size[moving, None]) & seen[np.minimum(start[moving, None] + places, len(seen) - 1)]
            steps = np.where(ok.all(1), len(ahead), ok.argmin(1))
            position[moving] += steps
            moving = moving[steps == len(ahead)]
        return position

    def _join(self, best: list[tuple], docs: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
        least = max(1, -best[-1][0] if len(best) == k else 1)
        if len(scores) > k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        good = np.flatnonzero(scores >= least)
        if not len(good):
            return best
        own = [(-s, self.ids[d] is None, self.ids[d]) for s, d in zip(scores[good].tolist(), docs[good].tolist())]
        # Null ids are equal, so that they are never compared with others.
        return sorted(best + own, key=lambda x: x if not x[1] else x[:2])[:k]


def _statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all their terms, and the documents that hold each query term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, length = Counter(), 0, 0
        for batch in batches:
            for text in raw_texts(batch, "text"):
                found = terms(text)
                documents, length = documents + bool(found), length + len(found)
                holding.update(queries.number.keys() & set(found))
        rows = [(None, documents, length), *((t, n, 0) for t, n in holding.items())]
        kinds = (pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["term", "n", "length"])

    rows = docs.select("text").mapInArrow(count, "term binary, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    found = {None if r.term is None else bytes(r.term): r for r in rows.collect()}
    total = found.pop(None, None)
    return (total.n, total.length, {t: r.n for t, r in found.items()}) if total else (0, 0, {})


def _search(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """(item, doc_id, score): up to k rows of each item from each task; items are places in ``texts``."""
    queries = Queries(texts)
    documents, length, holding = _statistics(docs, queries)
    weights = np.array([weight(documents, holding.get(t, 0)) for t in queries.number], np.int64)
    most = max(64, min(SHARD, PLACES // max(1, len(weights))))
    kind = docs.schema["doc_id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries.items]
        id_kind = pa.null()

        def flush(ids, sizes, postings):
            shard = Shard(ids, sizes, postings, weights, documents, length)
            for i, item in enumerate(queries.items):
                best[i] = shard.search(item, best[i], k)

        ids, sizes, postings = [], [], []
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text")):
                found = terms(text)
                own = queries.counts(found)
                if own[0]:
                    ids.append(doc), sizes.append(len(found)), postings.append(own)
                if len(ids) == most:
                    flush(ids, sizes, postings)
                    ids, sizes, postings = [], [], []
        if ids:
            flush(ids, sizes, postings)
        rows = [(i, doc, -score) for i, own in enumerate(best) for score, _, doc in own]
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), id_kind, pa.int64()))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(search, f"item int, doc_id {kind.simpleString()}, score long")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of the items, in blocks of bounded size."""
    block, size = [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        own = len(row.text or "")
        if block and (len(block) == BLOCK or size + own > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += own
    if block:
        yield block


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs`` for each row of ``items``."""
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType.simpleString()
    out = None
    for rows in _blocks(items):
        found = _search(docs, [(r.text or "").encode() for r in rows], k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(rows)], f"item int, item_id {kind}")
        own = top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.union(own)
    if out is None:
        kinds = f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
        return spark.createDataFrame([], kinds)
    return out

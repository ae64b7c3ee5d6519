"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the collection.

1. Every string of LENGTH bytes has a minimizer, the smallest hashed SEED-gram in it. Neighbours that
   share theirs form a *piece* of fewer than 2 * LENGTH bytes. Equal strings have equal minimizers, so
   only pieces with the same one can share a string. Copies of a piece are settled by hash.
2. What is left, different pieces with the same minimizer, is cut out of the texts and sorted in blocks.
   ``sort_suffixes`` inserts one symbol of each piece in each round, from right to left, into the
   Burrows-Wheeler transform of the block and into its longest common prefixes.
3. In the suffix order, equal strings of LENGTH bytes stand side by side with common prefixes of LENGTH.

A minimizer of more than CELL pieces is dealt to several cells; their distinct strings meet by hash.

Defined results: a null text is empty; texts shorter than LENGTH keep all bytes; a null id comes after
all others; rows with the same id and text are one document (each gets its result), rows with the same
id and different texts are ordered by the md5 of the text; other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatpack.llm.arrow import pieces, raw_texts
from chatpack.llm.components import stored
from chatpack.operators.ordering import numbered

LENGTH = 100
SEED = 24
#: Bytes of text whose pieces are found, and compared with each other, at once.
SCAN = 1 << 20
#: Pieces with one minimizer that are sorted together, and pieces of a block.
CELL = 8192
#: Minimizers of several cells that are broadcast.
BROADCAST_ROWS = 65_536
#: Pieces with one minimizer in a scanned block from which on they are dealt out by their content.
CROWD = 64

_COPY, _PIECE, _MARK = 1, 0, 2
_HALF = np.uint64(1 << 24)


def minimizers(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For each start of ``length`` bytes: hash of its minimizer, times 2^24, plus the minimizer's place.

    Hashes have 40 bits. Of equal ones the leftmost counts, so equal strings have equal minimizers.
    """
    grams = len(data) - seed + 1
    words = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
    h = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, seed, 8):
        h ^= h >> np.uint64(29)
        h += words[k : k + grams]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h &= ~(_HALF - np.uint64(1))
    h |= np.arange(grams, dtype=np.uint64)
    width, span = length - seed + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _pieces(ids: list[int], texts: list[bytes], starts: list[int]) -> pa.RecordBatch | None:
    """Rows (m, salt, s, doc, at, run, kind) of some texts; ``starts`` are their places in their documents.

    Of equal pieces in them only the first is a piece; the others are known to go.
    """
    data = b"".join(texts)
    sizes = np.array([len(x) for x in texts])
    if len(data) < LENGTH:
        return None
    ends = np.cumsum(sizes)
    least = minimizers(np.frombuffer(data, np.uint8))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    whole = np.arange(len(least)) + LENGTH <= ends[text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    if not len(first):
        return None
    # A run ends where the next begins or where strings would leave the text.
    bounds = np.append(np.flatnonzero(new | ~whole), len(least))
    last = bounds[np.searchsorted(bounds, first, "right")]
    run, text = last - first, text[first]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    s = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH - 1).tolist())], np.uint64).view(np.int64)
    doc = np.array(ids, np.int64)[text]
    at = first - (ends - sizes)[text] + np.array(starts)[text]
    m = (least[first] >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((at, doc, s))
    again = np.zeros(len(s), bool)
    again[order[1:]] = s[order[1:]] == s[order[:-1]]
    own, counts = np.unique(m[~again], return_counts=True)
    crowded = own[counts > CROWD]
    salt = np.where(np.isin(m, crowded) & ~again, 1 + (s & 63), 0)
    m[again] = -1 - (doc[again] * 0x9E3779B1 + at[again] & 0xFFFFFFFF)
    rows = [m, salt, s, doc, at, run, np.where(again, _COPY, _PIECE)]
    marks = [crowded, 0, np.iinfo(np.int64).min, 0, 0, 0, _MARK]
    columns = [np.concatenate([x, np.broadcast_to(y, len(crowded))]).astype(np.int64) for x, y in zip(rows, marks)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["m", "salt", "s", "doc", "at", "run", "kind"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, starts, size = [], [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column("__doc").to_pylist(), raw_texts(batch, "text")):
            # Long texts go in parts that share LENGTH - 1 bytes, so each string is whole in one part.
            for at in range(0, max(0, len(text) - LENGTH + 1), SCAN):
                part = text[at : at + SCAN + LENGTH - 1]
                ids.append(doc), texts.append(part), starts.append(at)
                size += len(part)
                if size >= SCAN:
                    if (out := _pieces(ids, texts, starts)) is not None:
                        yield out
                    ids, texts, starts, size = [], [], [], 0
    if (out := _pieces(ids, texts, starts)) is not None:
        yield out


_SCANNED = "m long, salt long, s long, doc long, at long, run long, kind long"
_MARKED = "m long, doc long, at long, run long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer, content and place: later copies come out with no minimizer, and
    first pieces come out with theirs if another piece has the same; pieces that are alone do not come out.
    """
    group = (None, None)  # minimizer and salt of the last row
    content, pieces, held = None, 0, None  # its content, pieces of the group so far, and the only one of them
    for batch in batches:
        m, salt, s, doc, at, run, kind = (batch.column(k).to_numpy() for k in range(7))
        if not len(m):
            continue
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (salt[1:] != salt[:-1])
        new[0] = (m[0], salt[0]) != group
        fresh = new.copy()
        fresh[1:] |= s[1:] != s[:-1]
        fresh[0] |= s[0] != content
        gone = (kind == _COPY) | ~fresh & (kind == _PIECE)
        number = np.cumsum(new)  # 0: goes on from the last batch
        weight = np.where(kind == _MARK, 2, np.where(salt > 0, 2, 1)) * (fresh & (kind != _COPY))
        total = np.bincount(number, weight).astype(int)
        total[0] += pieces
        if total[0] > 1 and held is not None:
            yield _marked(*[np.array([x]) for x in held])
            held = None
        shared = fresh & (kind == _PIECE) & (total[number] > 1)
        at_end = number[-1]
        if at_end or held is None:
            alone = np.flatnonzero((number == at_end) & fresh & (kind == _PIECE)) if total[at_end] == 1 else []
            held = (m[alone[0]], doc[alone[0]], at[alone[0]], run[alone[0]]) if len(alone) else None
        group, content, pieces = (m[-1], salt[-1]), s[-1], total[at_end]
        out = gone | shared
        yield _marked(np.where(gone, -1, m)[out], doc[out], at[out], run[out])


def _marked(m, doc, at, run) -> pa.RecordBatch:
    m = pa.array(m, pa.int64(), mask=m < 0)
    return pa.RecordBatch.from_arrays([m, pa.array(doc), pa.array(at), pa.array(run)], names=["m", "doc", "at", "run"])


class _Minimum:
    """Minimums of ranges of bytes, from minimums of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of places low to high - 1 each; ranges are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.uint8)
        for k in range(int(level.max(initial=-1)) + 1):
            if k == len(self.levels):
                x = self.levels[-1]
                self.levels.append(np.minimum(x[: -(1 << k - 1)], x[1 << k - 1 :]))
            here = np.flatnonzero(level == k)
            out[here] = np.minimum(self.levels[k][low[here]], self.levels[k][high[here] - (1 << k)])
        return out


def sort_suffixes(symbols: np.ndarray, first: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of many strings in order: codes (string * 256 + length) and common prefixes with the one before.

    String k has the symbols ``symbols[first[k] + step * i]`` for i < count[k] < 256, none of them 0.
    Round j inserts the j-th symbol from the right of every string. A suffix's symbol to the left is
    its entry in the transform; the suffix which that symbol begins comes after all suffixes that begin with
    smaller symbols, and after those with the same one whose rests come before its rest. So a round
    reads transform, prefixes and codes from front to back and writes them anew. The common prefix of
    two neighbours with the same first symbol is 1 more than the least between their rests.
    """
    strings = len(first)
    transform, common = np.zeros(strings, np.uint16), np.zeros(strings, np.uint8)
    codes, place = np.arange(strings, dtype=np.int64) << 8, np.arange(strings)
    for j in range(1, int(count.max(initial=0)) + 1):
        active = np.flatnonzero(count >= j)
        transform[place[active]] = symbols[first[active] + step * (count[active] - j)]
        order = np.argsort(transform, kind="stable")
        order = order[len(order) - np.count_nonzero(transform) :]
        fresh = np.zeros(len(transform), bool)
        fresh[place[active]] = True
        at = np.flatnonzero(fresh[order])
        rest = order[at]
        least = _Minimum(common)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(order) - 1)
        same = (at > 0) & (transform[order[before]] == transform[rest])
        prefix = np.zeros(len(at), np.uint8)
        prefix[same] = 1 + least.of(order[before[same]] + 1, rest[same] + 1)
        follows = (at + 1 < len(order)) & (transform[order[after]] == transform[rest])
        own = codes[rest]
        slots = strings + at
        kept = np.ones(len(transform) + len(at), bool)
        kept[slots] = False
        more = np.empty(len(kept), np.uint8)
        more[kept], more[slots] = common, prefix
        more[strings + after[follows]] = 1 + least.of(rest[follows] + 1, order[after[follows]] + 1)
        longer = np.zeros(len(kept), np.uint16)
        longer[kept] = transform
        all_codes = np.empty(len(kept), np.int64)
        all_codes[kept], all_codes[slots] = codes, own + 1
        place[own >> 8] = slots
        transform, common, codes = longer, more, all_codes
    return codes, common


def classes(strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, class) of every string of ``length`` bytes in the pieces; equal ones have one class.

    Symbols are 4 bytes wide, or 2 if there are too many of them: a piece then counts as so many
    strings, one for each remainder of the offset, and common prefixes count in symbols.
    """
    data = np.frombuffer(b"".join(strings) + b"\0" * 4, np.uint8)
    sizes = np.array([len(x) for x in strings])
    starts = np.cumsum(sizes) - sizes
    for width in (4, 2):
        words = np.lib.stride_tricks.as_strided(data[:4].view(f"<u{width}"), (len(data) - 4,), (1,))
        known, names = np.unique(words, return_inverse=True)
        if len(known) < 1 << 16:
            break
    remainder = np.tile(np.arange(width), len(strings))
    first, count = np.repeat(starts, width) + remainder, (np.repeat(sizes, width) - remainder) // width
    long = np.flatnonzero(count >= length // width)
    codes, common = sort_suffixes((names + 1).astype(np.uint16), first[long], count[long], width)
    number = np.cumsum(common < length // width)
    whole = (codes & 255) >= length // width
    codes, number = codes[whole], number[whole]
    string = long[codes >> 8]
    return string // width, remainder[string] + width * (count[string] - (codes & 255)), number


def _sort_block(rows: list[tuple], hot: list[bool]) -> Iterator[pa.RecordBatch]:
    """Repeated strings of pieces (doc, at, text), as runs; distinct strings of hot cells, with their hashes."""
    doc, at = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    piece, offset, number = classes([r[2] for r in rows])
    doc, at = doc[piece], at[piece] + offset
    order = np.lexsort((at, doc, number))
    first = np.ones(len(order), bool)
    first[1:] = number[order[1:]] != number[order[:-1]]
    gone = order[~first]
    gone = gone[np.lexsort((at[gone], doc[gone]))]
    d, a = doc[gone], at[gone]
    breaks = np.ones(len(gone), bool)
    breaks[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)
    begin = np.flatnonzero(breaks)
    run = np.diff(np.append(begin, len(gone)))
    yield _found(pa.nulls(len(begin), pa.binary()), d[begin], a[begin], run)
    if any(hot):
        seen = order[first]
        seen = seen[np.array(hot)[piece[seen]]]
        hashes = [xxhash.xxh3_128_digest(rows[p][2][o : o + LENGTH]) for p, o in zip(piece[seen].tolist(), offset[seen].tolist())]
        yield _found(pa.array(hashes, pa.binary()), doc[seen], at[seen], np.ones(len(seen), np.int64))


def _found(hashes, doc, at, run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([hashes, pa.array(doc), pa.array(at), pa.array(run)], names=["hash", "doc", "at", "run"])


def _sort_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole cells (m, part), which come sorted."""
    rows, hot, last = [], [], None
    for batch in batches:
        for m, part, parts, doc, at, text in zip(*[batch.column(k).to_pylist() for k in range(6)]):
            if (m, part) != last and len(rows) >= CELL:
                yield from _sort_block(rows, hot)
                rows, hot = [], []
            last = (m, part)
            rows.append((doc, at, text)), hot.append(parts > 1)
    if rows:
        yield from _sort_block(rows, hot)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of documents, as bytes."""
    for batch in batches:
        for text, own in zip(raw_texts(batch, "text"), batch.column("pieces")):
            found = own.values
            m, parts, doc, at, run = (found.field(k) for k in range(5))
            cut = [text[a : a + r + LENGTH - 1] for a, r in zip(at.to_pylist(), run.to_pylist())]
            yield pa.RecordBatch.from_arrays([m, parts, doc, at, pa.array(cut, pa.binary())], names=["m", "parts", "doc", "at", "text"])


def with_places(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, __doc) of every row, and the same with one row for each ``__doc``.

    ``__doc`` is a number in the order of documents. Ids that are distinct integers stay as they are.
    """
    docs = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    if whole and docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn("__doc", F.col("doc_id").cast("long"))
        return docs, docs
    docs = docs.withColumns({"__last": F.col("doc_id").isNull(), "__md5": F.md5("text")})
    keys = numbered(docs.select("__last", "doc_id", "__md5").distinct(), ["__last", "doc_id", "__md5"], "__doc")
    keys = keys.select(F.col("doc_id").alias("__id"), F.col("__md5").alias("__own"), "__doc")
    same = docs["doc_id"].eqNullSafe(keys["__id"]) & (docs["__md5"] == keys["__own"])
    docs = stored(docs.join(keys, same).select("doc_id", "text", "__doc"))
    return docs, docs.dropDuplicates(["__doc"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, at, run): strings of LENGTH bytes that start earlier, as runs of starts; of documents (__doc, text)."""
    docs = docs.select("__doc", "text")
    found = docs.mapInArrow(_scan, _SCANNED).repartition("m", "salt").sortWithinPartitions("m", "salt", "s", "doc", "at")
    marks = stored(found.mapInArrow(_settle, _MARKED))
    shared = marks.where("m is not null")
    counts = shared.groupBy("m").count().where(F.col("count") > CELL)
    parts = stored(counts.select("m", F.ceil(F.col("count") / CELL).cast("int").alias("parts")))
    # Few minimizers are so frequent; beyond the bound they are joined by a shuffle.
    few = parts.count() <= BROADCAST_ROWS
    shared = shared.join(F.broadcast(parts) if few else parts, "m", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = shared.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("m", "parts", "doc", "at", "run")).alias("pieces"))
    cut = docs.join(own, "__doc").select("text", "pieces").mapInArrow(_cut, "m long, parts int, doc long, at long, text binary")
    part = F.pmod(F.xxhash64("doc", "at"), F.col("parts").cast("long")).alias("part")
    cells = cut.select("m", part, "parts", "doc", "at", "text").repartition("m", "part").sortWithinPartitions("m", "part")
    sorted_ = stored(cells.mapInArrow(_sort_cells, "hash binary, doc long, at long, run long"))
    order = F.row_number().over(Window.partitionBy("hash").orderBy("doc", "at"))
    met = sorted_.where("hash is not null").withColumn("k", order).where("k > 1")
    columns = ["doc", "at", "run"]
    return marks.where("m is null").select(columns).union(sorted_.where("hash is null").select(columns)).union(met.select(columns))


def spans(starts: list[int], runs: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs of bytes, as (start, end), from runs of starts."""
    out: list[tuple[int, int]] = []
    for at, run in sorted(zip(starts, runs)):
        end = at + run + LENGTH - 1
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ids, sizes, removed spans and what is left."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), pa.string(), pa.binary()]
    for batch in (part for whole in batches for part in pieces(whole)):
        rows = []
        for text, gone in zip(raw_texts(batch, "text"), batch.column("gone")):
            found = spans(gone.values.field(0).to_pylist(), gone.values.field(1).to_pylist()) if gone.is_valid else []
            kept = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in found)], [*(s for s, _ in found), len(text)]))
            cells = [{"start": s, "end": e} for s, e in found]
            rows.append((len(text), len(text) - len(kept), len(found), cells, hashlib.sha256(kept).hexdigest(), kept))
        if rows:
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *_CLEANED])


_CLEANED = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<struct<start:long,end:long>>", "kept_sha256": "string", "kept": "binary"}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    ``spans`` are the removed byte ranges, ``kept`` the other bytes in order; they may cut a character in two.
    """
    docs, distinct = with_places(docs)
    gone = repeats(distinct).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("at", "run")).alias("gone"))
    both = docs.join(gone, "__doc", "left").select("doc_id", "text", "gone")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(_clean, ", ".join([f"doc_id {kind}", *(f"{k} {v}" for k, v in _CLEANED.items())]))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

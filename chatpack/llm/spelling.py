"""Spelling variants: words that differ by one letter, found with FM-indexes of the vocabulary.

One edit of a word leaves its left half a beginning, or its right half an end, of the variant. So words
meet by halves: a word asks under its left half and under its right half, and is found under the
beginnings and ends that words of its length, one less or one more can ask with. Halves are dealt to tasks and
searched in blocks. A block has an FM-index over its words between delimiters: for left halves over the
reversed words, which extends matches to the right, for right halves over the words as they are, which extends
them to the left. From the delimiter a search matches the half exactly and then the rest with one error, in
intervals of suffix ranks; a delimiter at its end makes it a whole word. A half with more than BLOCK words is dealt to several
blocks, each with part of the words and asked by all. Words that both halves find count for the left one.

Defined results: a null text has no words; a null id is written as nothing before the colon; repeated rows count
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.components import stored

# Fixed values of the word rule.
LETTERS, SHORTEST, FEWEST, DAMAGED, FACTOR = r"[A-Za-zÀ-ÿ]", 7, 2, 31, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of an index, and words that ask at once.
BLOCK = 20_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts that occur often enough."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    each = each.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")
    counts = each.select(word).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= FEWEST)


class Index:
    """An FM-index over distinct words, in which matches grow from the first letter to the last."""

    def __init__(self, words: list[str]):
        text = np.frombuffer("".join(w[::-1] + "\0" for w in words).encode("utf-32-le"), np.uint32)
        n, ends = len(text), text == 0
        self.letters = np.unique(text[~ends])
        symbols = np.where(ends, 0, np.searchsorted(self.letters, text) + 1)
        self.word = np.cumsum(ends) - ends
        self.size = len(words)
        self.suffixes = _suffixes(np.where(ends, self.word, len(words) + symbols))
        self.transform = np.where(self.suffixes > 0, symbols[self.suffixes - 1], 0)
        self.order = np.argsort(self.transform, kind="stable")
        self.width = n + 1
        self.keys = self.transform[self.order] * self.width + self.order
        kinds = np.arange(len(self.letters) + 2)
        counts = np.cumsum(np.bincount(symbols, minlength=len(kinds)))
        # From the rank of an occurrence in the transform to the rank of the suffix that it begins.
        self.shift = np.concatenate([[0], counts[:-1]]) - np.searchsorted(self.transform[self.order], kinds)

    def numbers(self, text: str) -> np.ndarray:
        """Symbols of a text; letters that no word has get the last one."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, len(self.letters) + 1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches with one more symbol."""
        base, shift = symbol * self.width, self.shift[symbol]
        return np.searchsorted(self.keys, base + low) + shift, np.searchsorted(self.keys, base + high) + shift

    def following(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, symbol) for all letters that matches can go on with."""
        kinds, size = len(self.letters) + 1, high - low
        wide = size > 4 * kinds
        own = np.flatnonzero(~wide)
        size = size[own]
        at = np.repeat(low[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = np.repeat(own, size) * kinds + self.transform[at]
        every = (np.flatnonzero(wide)[:, None] * kinds + np.arange(kinds)).ravel()
        pairs = np.concatenate([np.unique(pairs), every])
        interval, symbol = pairs // kinds, pairs % kinds
        return interval[symbol > 0], symbol[symbol > 0]

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which intervals hold a match that ends its word, and the word's number."""
        a, b = np.searchsorted(self.keys, low), np.searchsorted(self.keys, high)
        return a < b, self.word[self.suffixes[self.order[np.minimum(a, len(self.order) - 1)]]]


def _suffixes(ranks: np.ndarray) -> np.ndarray:
    """Suffix array by doubling."""
    n, k = len(ranks), 1
    ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    while True:
        key = ranks * (n + 1)
        key[: max(0, n - k)] += ranks[k:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if ranks[order[-1]] == n - 1:
            return order
        k *= 2


def with_one_error(index: Index, words: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(asking word, found word) numbers, each once: one edit apart, with the first ``exact`` letters the same."""
    size, exact = np.array([len(w) for w in words]), np.array(exact)
    start = np.cumsum(size) - size
    symbols = np.append(index.numbers("".join(words)), 0)
    q = np.arange(len(words))
    low, high = np.zeros(len(words), np.int64), np.full(len(words), index.size)
    for t in range(int(exact.max())):
        on = np.flatnonzero(exact[q] > t)
        low[on], high[on] = index.extend(symbols[start[q[on]] + t], low[on], high[on])
        q, low, high = (x[low < high] for x in (q, low, high))
    t = exact[q]
    # States: word, letters matched, interval; those in ``late`` have had their error.
    late, found = [np.zeros(0, np.int64)] * 4, [np.zeros(0, np.int64)]
    while len(q) or len(late[0]):
        states = [late]
        if len(q):
            inside = t < size[q]
            states.append([q[inside], t[inside] + 1, low[inside], high[inside]])
            at, symbol = index.following(low, high)
            low, high = index.extend(symbol, low[at], high[at])
            q, t = q[at], t[at]
            inside = t < size[q]
            match = inside & (symbols[start[q] + np.where(inside, t, 0)] == symbol)
            more, other = ~match, inside & ~match
            states.append([q[more], t[more], low[more], high[more]])
            states.append([q[other], t[other] + 1, low[other], high[other]])
            q, t, low, high = q[match], t[match] + 1, low[match], high[match]
        eq, et, elow, ehigh = (np.concatenate(x) for x in zip(*states))
        over = et == size[eq]
        ends, word = index.whole(elow[over], ehigh[over])
        found.append(eq[over][ends] * index.size + word[ends])
        eq, et, elow, ehigh = (x[~over] for x in (eq, et, elow, ehigh))
        elow, ehigh = index.extend(symbols[start[eq] + et], elow, ehigh)
        late = [x[elow < ehigh] for x in (eq, et + 1, elow, ehigh)]
    pairs = np.unique(np.concatenate(found))
    return pairs // index.size, pairs % index.size


class _Block:
    """Words to be found and words that ask, of one side."""

    def __init__(self, side: int):
        self.side, self.words, self.asking, self.index = side, {}, [], None

    def results(self) -> Iterator[pa.RecordBatch]:
        """(word, n_near, best_n, best) of the asking words, which are then forgotten."""
        asking, self.asking = self.asking, []
        if not asking or not self.words:
            return
        turn = (lambda w: w[::-1]) if self.side else (lambda w: w)
        words = list(self.words)
        if self.index is None:
            self.index = Index([turn(w) for w in words])
        exact = [(len(w) + 1) // 2 if self.side else len(w) // 2 for w in asking]
        rows: dict[str, tuple[int, int, str]] = {}
        for k in range(0, len(asking), 4096):
            part = asking[k : k + 4096]
            for a, b in zip(*[x.tolist() for x in with_one_error(self.index, [turn(w) for w in part], exact[k : k + 4096])]):
                a, b = part[a], words[b]
                if self.side and b.startswith(a[: len(a) // 2]):
                    continue  # the left half finds it
                count, n, best = rows.get(a, (0, 0, ""))
                own = self.words[b]
                n, best = (own, b) if own > n or own == n and b < best else (n, best)
                rows[a] = (count + 1, n, best)
        if rows:
            count, n, best = zip(*rows.values())
            columns = [pa.array(list(rows)), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(best)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "best_n", "best"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by side, half, part, and words to be found before those that ask."""
    block, group, crowded = _Block(0), None, False
    for batch in batches:
        for side, half, part, parts, asks, word, n in zip(*[c.to_pylist() for c in batch.columns]):
            if (side, half, part) != group:
                if side != block.side or crowded or parts > 1 or len(block.words) >= BLOCK:
                    yield from block.results()
                    block = _Block(side)
                group, crowded = (side, half, part), parts > 1
            if not asks:
                block.words[word] = n
            else:
                block.asking.append(word)
                if crowded and len(block.asking) >= BLOCK:
                    yield from block.results()
    yield from block.results()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: how many, and the most frequent."""
    size = F.length("word")
    ends = lambda k: F.expr(f"right(word, {k})")
    starts = lambda k: F.expr(f"left(word, {k})")
    m = "length(word)"
    halves = [
        (0, False, [starts(f"{m} div 2 - 1 + {m} % 2"), starts(f"{m} div 2"), starts(f"{m} div 2 + {m} % 2")]),
        (1, False, [ends(f"{m} div 2"), ends(f"{m} div 2 + {m} % 2"), ends(f"{m} div 2 + 1")]),
        (0, True, [starts(f"{m} div 2")]),
        (1, True, [ends(f"{m} div 2 + {m} % 2")]),
    ]

    def under(side, asks, own):
        return F.transform(F.array_distinct(F.array(*own)), lambda h: F.struct(F.lit(side).alias("side"), h.alias("half"), F.lit(asks).alias("asks")))

    rows = words.where(size >= SHORTEST).select("word", "n", F.inline(F.concat(*[under(*x) for x in halves])))
    counts = rows.where("not asks").groupBy("side", "half").count().where(F.col("count") > BLOCK)
    hot = counts.select("side", "half", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(hot, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts").cast("long")).cast("int"))
    part = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    rows = rows.select("side", "half", F.explode(part).alias("part"), "parts", "asks", "word", "n")
    dealt = rows.repartition("side", "half", "part").sortWithinPartitions("side", "half", "part", "asks")
    found = dealt.mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """(word, root) of ``forms`` (word, form), whose chains have at most ``longest`` steps.

    Steps double from round to round; a form that many words share is only ever on the side that is split.
    """
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1, longest)))):
        found = stored(found)
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return found


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs`` (doc_id, text)."""
    words = stored(vocabulary(docs))
    near = near_words(words)
    form = F.col("best_n") >= FACTOR * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", F.when(form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best_n")).alias("form_n"))
    found = stored(found)
    most = words.agg(F.max("n")).first()[0] or 0
    # Each step multiplies n by FACTOR or more, and the first has FEWEST or more.
    longest = next(k for k in range(99) if FEWEST * FACTOR ** (k + 1) > most)
    root = roots(found.where("form is not null"), longest)
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""License scans by diagonal voting.

Every rolling word k-gram of every document is hashed, and the hashes are joined with the positions of
equal k-grams in the license templates. A match votes for a diagonal, the document
position minus the template position. A diagonal on which all of a template's k-grams
vote is a place of it word for word. Of the other diagonals, neighbouring ones are merged
(words may be added or lost), and each stretch of merged diagonals that are not further
apart than added words can put them is verified: the template's and the document's words that voted are
aligned in order, and the aligned words must be a given share of both the template and the
span they lie in. So k-grams of a template that are scattered over a text, or out of order, are no place.
Phrases count only word for word.

Sibling licenses differ in a word or two. Words that a template has and a similar one of another label lacks are
its *decisive* words, which must all be aligned; and where places of different labels overlap, one with a larger share, or
as large a share of a longer span, beats the others. Phrases are not part of that.

The templates are configuration of a fixed size, so their k-grams are broadcast. One pass over the
texts hashes all k-grams and leaves out those whose hash a one-function Bloom filter of the templates' hashes excludes; the rest go
to the join, which decides. Neither texts nor other k-grams leave the pass. What is found is stored with a number for each row, so that repeated rows
are rows of their own, and the votes of that table are few.

Defined results: a null or empty text has no words, no places and no labels; texts of
fewer words than a k-gram have no votes; a null id is a value like any other; texts are read whole, and
templates have any length from a k-gram's up; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatpack.llm.arrow import pieces, raw_texts
from chatpack.llm.components import stored
from chatpack.llm.vectors import whole_groups

K = 3
#: Diagonals at most so far apart are merged, whatever the template's length.
GAP = 3
#: Share of a template's words, and of a span's, that must be aligned.
SIMILARITY = 0.8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # an exact phrase, all of whose places count


# The phrases, and sentences of public licenses.
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
SENTENCES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("gpl", "licensed under the gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license"),
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    Template("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    Template("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved"),
)
WHOLE = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means."""),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions"""),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License."""),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)
TEMPLATES = PHRASES + SENTENCES + WHOLE


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text with A-Z lower-cased."""
    return _WORD.findall(text.lower())


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def gram_hashes(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes, signed, of all k-grams of a text with these word hashes."""
    n = max(0, len(hashes) - K + 1)
    h = np.zeros(n, np.uint64)
    for k in range(K if n else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h.view(np.int64)


class Grams:
    """The k-grams of the templates, and the words of each that tell it from its siblings."""

    #: Bits of a hash that the Bloom filter goes by.
    BITS = 20

    def __init__(self, templates: tuple[Template, ...], similarity: float = SIMILARITY):
        texts = [words_of(t.text.encode()) for t in templates]
        if min(map(len, texts)) < K:
            raise ValueError(f"templates have {K} words at least")
        self.sizes = [len(w) for w in texts]
        #: (hash, template, position) of each k-gram.
        self.rows = []
        for t, w in enumerate(texts):
            own = gram_hashes(np.array([word_hash(x) for x in w], np.uint64))
            self.rows += [(h, t, k) for k, h in enumerate(own.tolist())]
        self.filter = np.zeros(1 << self.BITS, bool)
        self.filter[self._slot(np.array([r[0] for r in self.rows], np.int64))] = True
        self.decisive = [decisive(w, [o for u, o in zip(templates, texts) if u.label != t.label and not u.phrase], similarity) if not t.phrase else set() for t, w in zip(templates, texts)]
        self._words: dict[bytes, int] = {}

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return hashes.view(np.uint64) >> np.uint64(64 - self.BITS)

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the k-grams that the filter lets through."""
        known = self._words
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = word_hash(w)
        hashes = gram_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        pos = np.flatnonzero(self.filter[self._slot(hashes)])
        return pos, hashes[pos]


def decisive(words: list[bytes], others: list[list[bytes]], similarity: float) -> set[int]:
    """Positions of the words that are missing in another text of which so much of these words is a subsequence."""
    out: set[int] = set()
    for other in others:
        if sum((Counter(words) & Counter(other)).values()) >= similarity * len(words):
            common = {m.a + k for m in SequenceMatcher(None, words, other, autojunk=False).get_matching_blocks() for k in range(m.size)}
            if len(common) >= similarity * len(words):
                out |= set(range(len(words))) - common
    return out


def scanned(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(doc_id, n_words, pos, hash, row): every row with its template k-grams, stored under a number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        grams = Grams(templates)
        for batch in batches:
            for part in pieces(batch):
                found = []
                for text in raw_texts(part, "text"):
                    words = words_of(text)
                    found.append((len(words), *grams.find(words)))
                n, pos, hashes = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(pos, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "pos", "hash"])

    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, pos array<long>, hash array<long>")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def aligned(pos: np.ndarray, diagonal: np.ndarray, n_words: int) -> tuple[int, int, float, set[int]]:
    """(first word, end, share, template words) of the longest alignment in order of voted words; the share is of the longer of template and span."""
    steps = np.arange(K)
    at = (pos[:, None] + steps).ravel()
    of = (pos[:, None] - diagonal[:, None] + steps).ravel()
    pairs = np.unique(np.stack([at, -of], axis=1), axis=0)  # by document word; of equal ones the later template word first
    ends: list[int] = []  # of the best chains of each length, their last template words
    last: list[int] = []
    before = [-1] * len(pairs)
    for k, t in enumerate((-pairs[:, 1]).tolist()):
        j = bisect_left(ends, t)
        before[k] = last[j - 1] if j else -1
        if j == len(ends):
            ends.append(t)
            last.append(k)
        else:
            ends[j], last[j] = t, k
    k = last[-1]
    end, of = int(pairs[k, 0]) + 1, {-int(pairs[k, 1])}
    while before[k] >= 0:
        k = before[k]
        of.add(-int(pairs[k, 1]))
    first = int(pairs[k, 0])
    return first, end, len(ends) / max(n_words, end - first), of


def drift(n_words: int, similarity: float) -> int:
    """Diagonals that words added to a place of a template can put between its votes."""
    return max(GAP, int(n_words * (1 / similarity - 1)))


def verified(diagonal: np.ndarray, votes: list[np.ndarray], n_words: int, similarity: float, needed: set[int] = frozenset()):
    """(first, end, share) of the places on merged diagonals, which come in order with the positions that voted."""
    spread, k = drift(n_words, similarity), 0
    while k < len(diagonal):
        to = int(np.searchsorted(diagonal, diagonal[k] + spread, "right"))
        if K * sum(map(len, votes[k:to])) >= similarity * n_words:
            first, end, share, of = aligned(np.concatenate(votes[k:to]), np.repeat(diagonal[k:to], [len(v) for v in votes[k:to]]), n_words)
            if share >= similarity and needed <= of:
                yield first, end, share
                k = to
                continue
        k += 1


def best(spans: list[tuple], templates: tuple[Template, ...]) -> list[tuple]:
    """Of spans (first, end, tpl, share) in order: the phrases, and those that no overlapping one of another label beats."""
    rank = lambda s: (round(s[3], 9), s[1] - s[0])
    beaten, open_ = set(), []
    for i, s in enumerate(spans):
        if templates[s[2]].phrase:
            continue
        open_ = [j for j in open_ if spans[j][1] > s[0]]
        for j in open_:
            if templates[spans[j][2]].label != templates[s[2]].label and rank(spans[j]) != rank(s):
                beaten.add(j if rank(spans[j]) < rank(s) else i)
        open_.append(i)
    return [s for i, s in enumerate(spans) if i not in beaten]


def find_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_words, spans) of every row; spans hold tpl, first word, end and the aligned share."""
    spark = docs.sparkSession
    grams = Grams(templates, similarity)
    seen = scanned(docs, templates)
    rows = spark.createDataFrame(
        [(*r, n - K + 1, drift(n, similarity), templates[r[1]].phrase) for r in grams.rows for n in [grams.sizes[r[1]]]], "hash long, tpl int, tpl_pos long, full int, gap int, phrase boolean")
    diagonals = (
        seen.select("row", F.explode(F.arrays_zip("pos", "hash")).alias("gram")).select("row", "gram.pos", "gram.hash")
        .join(F.broadcast(rows), "hash")
        .groupBy("row", "tpl", "full", "gap", "phrase", (F.col("pos") - F.col("tpl_pos")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"), F.collect_list("pos").alias("votes"))
    )
    diagonals = stored(diagonals.where("n = full or not phrase"))
    places = diagonals.where("n = full").select("row", "tpl", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("full") + K - 1).alias("end"), F.lit(1.0).alias("share"))
    # Neighbouring diagonals are merged by a running count of the steps between them.
    by = Window.partitionBy("row", "tpl").orderBy("diagonal")
    step = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by), F.lit(0))
    runs = (
        diagonals.where("n < full").repartition("row", "tpl").withColumn("step", step).withColumn("run", F.sum(F.when(F.col("step") > F.col("gap"), 1).otherwise(0)).over(by))
        .withColumn("all", F.sum("n").over(Window.partitionBy("row", "tpl", "run")))
        .where(F.col("all") * K >= (F.col("full") + K - 1) * F.lit(float(similarity)))
        .select("row", "tpl", "run", "diagonal", "votes").repartition("row", "tpl").sortWithinPartitions("row", "tpl", "run", "diagonal")
    )

    def verify(batches):
        for part, group in whole_groups(batches, 3, alone=True):
            diagonal, tpl = part.column("diagonal").to_numpy(), part.column("tpl").to_numpy()
            votes = [np.sort(v.values.to_numpy()) for v in part.column("votes")]
            edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group)).tolist()
            out = [(a, *x) for a, b in zip(edges, edges[1:]) for x in verified(diagonal[a:b], votes[a:b], grams.sizes[tpl[a]], similarity, grams.decisive[tpl[a]])]
            if out:
                at, first, end, share = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").take(pa.array(at)), part.column("tpl").take(pa.array(at)), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(share)],
                    names=["row", "tpl", "first", "end", "share"])

    spans = places.union(runs.mapInArrow(verify, "row long, tpl int, first long, end long, share double"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "end", "tpl", "share"))).alias("spans"))

    def resolve(batches):
        for batch in batches:
            kept = [best([tuple(s.values()) for s in own], templates) for own in batch.column("spans").to_pylist()]
            names = ("first", "end", "tpl", "share")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([[dict(zip(names, s)) for s in own] for own in kept], batch.schema.field("spans").type)], names=["row", "spans"])

    spans = spans.mapInArrow(resolve, spans.schema)
    none = F.expr("cast(array() as array<struct<first:bigint,end:bigint,tpl:int,share:double>>)")
    return seen.select("row", "doc_id", "n_words").join(spans, "row", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))


def digests(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Word and place counts, and the labels of the phrases and of all templates, of every document."""
    phrase = [t.phrase for t in templates]
    is_phrase = lambda s: F.element_at(F.array(*[F.lit(x) for x in phrase]), s["tpl"] + 1)
    label = lambda s: F.element_at(F.array(*[F.lit(t.label) for t in templates]), s["tpl"] + 1)
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, label))), ",")
    found = find_spans(docs, templates).withColumn("base", F.filter("spans", is_phrase))
    starts = F.transform("base", lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(F.col("base")).alias("base_labels"),
        listed(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )

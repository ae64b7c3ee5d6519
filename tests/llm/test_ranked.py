import random
import re
from collections import Counter

import numpy as np
import pytest

from chatpack.llm import ranked

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, k=10):
    """Every document scored for every item."""
    found = [(i, PATTERN.findall(lowered(t))) for i, t in docs]
    found = [(i, t, Counter(t)) for i, t in found if t]
    n, length = len(found), sum(len(t) for _, t, _ in found)
    df = Counter(x for _, t, _ in found for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t, counts in found:
            m = 25 + (75 * len(t) * n) // length
            s = sum(ranked.weight(n, df[x]) * ((10**9 * counts[x]) // (1000 * counts[x] + 8 * m)) for x in PATTERN.findall(lowered(text)) if x in counts)
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéİKZ9") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !"), (None, docs[5][1]), (None, docs[5][1]), (7, docs[8][1]), (n + 3, docs[5][1]), (n + 4, text(9000))]
    items = [(10 * i, text(rng.randint(1, 40))) for i in range(25)] + [(3, None), (3, "zz zz"), (5, "nowhere"), (5, docs[5][1]), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_against_all_scores(spark, seed):
    docs, items = corpus(seed)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(4)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in ranked.best_documents(df, asked).collect())
    assert got == plain(docs, items)


def test_shards_and_early_stops():
    """Lists of several shards, with the scores of earlier ones, are read in part and give the same."""
    docs, items = corpus(8, 900)
    docs = [(i, t) for i, t in docs if i is not None]
    queries = ranked.Queries([(t or "").encode() for _, t in items])
    rows = [(i, ranked.terms((t or "").encode())) for i, t in docs]
    rows = [(i, t) for i, t in rows if t]
    n, length = len(rows), sum(len(t) for _, t in rows)
    df = Counter(x for _, t in rows for x in set(t))
    weights = np.array([ranked.weight(n, df[t]) for t in queries.number])
    best = [[] for _ in items]
    for k in range(0, len(rows), 150):
        own = [(i, len(t), queries.counts(t)) for i, t in rows[k : k + 150]]
        own = [x for x in own if x[2][0]]
        shard = ranked.Shard(*map(list, zip(*own)), weights, n, length)
        best = [shard.search(item, b, 10) for item, b in zip(queries.items, best)]
    got = Counter((item[0], rank, x[2], -x[0]) for item, b in zip(items, best) for rank, x in enumerate(b, 1))
    assert got == plain(docs, items)


def test_the_bound_stops_before_the_end_of_the_lists(monkeypatch):
    """A document far ahead of all others ends the search before most documents are met."""
    queries = ranked.Queries([b"one two"])
    postings = [([0], [1]) if k % 2 else ([1], [1]) for k in range(4000)] + [([0, 1], [9, 9])] * 10
    shard = ranked.Shard(list(range(4010)), [20 + k // 10 for k in range(4000)] + [18] * 10, postings, np.array([900, 900]), 4010, 4010 * 100)
    met = []
    join = ranked.Shard._join
    monkeypatch.setattr(ranked.Shard, "_join", lambda self, best, docs, *a: met.extend(docs) or join(self, best, docs, *a))
    best = shard.search(queries.items[0], [], 10)
    assert [x[2] for x in best] == list(range(4000, 4010)) and len(met) < 100


def test_empty_tables_and_text_ids(spark):
    docs, items = corpus(1, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.best_documents(df.limit(0), asked).count() == 0
    assert ranked.best_documents(df, asked.limit(0)).count() == 0
    named = [(i if i is None else f"d{i:05}", t) for i, t in docs]
    got = Counter(tuple(r) for r in ranked.best_documents(spark.createDataFrame(named, "doc_id string, text string"), asked).collect())
    expected = Counter()
    for (item, rank, doc, score), times in plain(docs, items).items():
        expected[item, rank, doc if doc is None else f"d{doc:05}", score] += times
    assert got == expected

import random
import re
import zlib
from collections import Counter

import pytest

from chatpack.llm import spelling

PATTERN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs):
    counts = Counter()
    for i, text in docs:
        for run in PATTERN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def corpus(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcÀÿ×", "abcdefghé"])
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(40)]
    times = [rng.choice([1, 2, 3, 30, 400]) for _ in words]
    for w in list(words):
        for _ in range(rng.randint(0, 8)):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
            times.append(rng.choice([1, 2, 3, 25]))
    every = [w for w, k in zip(words, times) for _ in range(k)] + ["long" * 900] * 3 + ["long" * 900 + "x"] * 2
    rng.shuffle(every)
    docs = [(k, "".join(w + rng.choice([" ", "-", "1", "\n", "ş"]) for w in every[k::50])) for k in range(50)]
    return docs + [(50, None), (51, ""), (None, docs[0][1]), (7, docs[7][1]), (7, docs[7][1])]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(3)
    got = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs) and len(got) > 30


def test_halves_with_very_many_words(spark, monkeypatch):
    """Halves dealt to several blocks give the same."""
    monkeypatch.setattr(spelling, "BLOCK", 5)
    docs = corpus(0) + corpus(4)
    assert {tuple(r) for r in spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == plain(docs)


def test_chains_end_at_the_last_form(spark):
    pairs = [(f"w{k:02}", f"w{k + 1:02}") for k in range(11)] + [(f"x{k}", "w03") for k in range(5)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(pairs, "word string, form string"), 11).collect()))
    assert set(got.values()) == {"w11"} and len(got) == 16
    assert plain([(0, "")]) == set()
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_error_in_an_index():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(400)})
    asking = words[::3] + ["zzzz", "abcz"]
    exact = [len(w) // 2 for w in asking]
    a, b = spelling.with_one_error(spelling.Index(words), asking, exact)
    got = {(asking[x], words[y]) for x, y in zip(a.tolist(), b.tolist())}
    assert got == {(u, v) for u, e in zip(asking, exact) for v in words if one_edit(u, v) and v[:e] == u[:e]}

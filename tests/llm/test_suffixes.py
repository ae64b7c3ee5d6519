import hashlib
import random

import numpy as np
import pytest

from chatpack.llm import suffixes


def plain(docs):
    """(n_bytes, n_removed, n_spans, sha) of texts in order, by a dictionary of all strings."""
    seen, out = set(), []
    for text in docs:
        data, gone = (text or "").encode(), set()
        for at in range(len(data) - 99):
            x = data[at : at + 100]
            if x in seen:
                gone.update(range(at, at + 100))
            seen.add(x)
        kept = bytes(c for k, c in enumerate(data) if k not in gone)
        n = sum(1 for k in gone if k - 1 not in gone)
        out.append((len(data), len(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=60):
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(10, 60)) for _ in range(6)] + ["a" * 300, "ab" * 90, text(12) + "\n"]
    docs = []
    for _ in range(n):
        parts = [text(rng.randint(1, 40)) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        docs.append(" ".join(parts))
    docs += [None, "", "x" * 99, "x" * 100, "x" * 100, docs[3], docs[5] + "!", "a" * 5000, text(4000)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_against_a_dictionary_of_all_strings(spark, seed):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame([(3 * k - 50, t, 1) for k, t in enumerate(docs)], "doc_id long, text string, m int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.digests(df).collect()}
    assert got == {3 * k - 50: x for k, x in enumerate(plain(docs))}


def test_small_blocks_crowds_and_cells(spark, monkeypatch):
    """The same rows with minimizers of many pieces, dealt to several cells, and texts in parts."""
    rng = random.Random(9)
    middle = "".join(rng.choice("qwertz") for _ in range(70))
    docs = ["".join(rng.choice("abc ") for _ in range(rng.randint(40, 60))) + middle + rng.choice(["x", "yy"]) * 40 for _ in range(150)]
    docs = [t if k % 9 else docs[k - 1][7:] for k, t in enumerate(docs)] + corpus(rng, 20)
    expected = dict(enumerate(plain(docs)))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    for name, value in (("CELL", 16), ("CROWD", 2), ("SCAN", 700)):
        monkeypatch.setattr(suffixes, name, value)
    # Workers import the module anew, so the parts are also run here.
    import pyarrow as pa

    order = sorted(range(len(docs)), key=lambda k: k % 7)
    batch = pa.table({"__doc": pa.array(order, pa.int64()), "text": pa.array([docs[k] for k in order])}).to_batches()[0]
    rows = [r for b in suffixes._scan(iter([batch])) for r in zip(*[c.to_pylist() for c in b.columns])]
    rows.sort(key=lambda r: r[:5])
    names = ["m", "salt", "s", "doc", "at", "run", "kind"]
    batches = [pa.table({n: pa.array([r[i] for r in rows[k : k + 13]], pa.int64()) for i, n in enumerate(names)}).to_batches()[0] for k in range(0, len(rows), 13)]
    gone, shared = [], {}
    for b in suffixes._settle(iter(batches)):
        for m, doc, at, run in zip(*[c.to_pylist() for c in b.columns]):
            gone.append((doc, at, run)) if m is None else shared.setdefault(m, []).append((doc, at, run))
    assert max(map(len, shared.values())) > 2 * suffixes.CELL
    met = {}
    for m, own in shared.items():
        parts = -(-len(own) // suffixes.CELL)
        for part in range(parts):
            mine = [(d, a, docs[d].encode()[a : a + r + 99]) for d, a, r in own if (d + a) % parts == part]
            for b in suffixes._sort_block(mine, [parts > 1] * len(mine)) if mine else ():
                for h, doc, at, run in zip(*[c.to_pylist() for c in b.columns]):
                    gone.append((doc, at, run)) if h is None else met.setdefault(h, []).append((doc, at))
    gone += [(d, a, 1) for x in met.values() for d, a in sorted(x)[1:]]
    for k, text in enumerate(docs):
        data = (text or "").encode()
        found = suffixes.spans([a for d, a, _ in gone if d == k], [r for d, _, r in gone if d == k])
        assert (sum(e - s for s, e in found), len(found)) == expected[k][1:3], (k, data)
    assert {r.doc_id: tuple(r)[1:] for r in suffixes.digests(df).collect()} == expected


def test_suffixes_are_in_order():
    rng = random.Random(2)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(0, 40))] for _ in range(50)]
    first = np.cumsum([0, *map(len, strings)])[:-1]
    flat = np.array([x for s in strings for x in s], np.uint16)
    codes, common = suffixes.sort_suffixes(flat, first, np.array([len(s) for s in strings]), 1)
    found = [strings[c >> 8][len(strings[c >> 8]) - (c & 255) :] for c in codes.tolist()]
    assert found == sorted(found) and len(found) == len(flat) + len(strings)
    for a, b, n in zip(found, found[1:], common[1:].tolist()):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_many_symbols_are_two_bytes_wide():
    rng = random.Random(4)
    strings = [rng.randbytes(176) for _ in range(500)]
    strings += [rng.randbytes(30) + s[20:150] for s in strings[:40]]
    piece, offset, number = suffixes.classes(strings)
    assert len(piece) == sum(len(s) - 99 for s in strings)
    by = {}
    for p, o, c in zip(piece.tolist(), offset.tolist(), number.tolist()):
        by.setdefault(c, set()).add(strings[p][o : o + 100])
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({s[o : o + 100] for s in strings for o in range(len(s) - 99)})


def test_rows_with_the_same_id_null_ids_and_text_ids(spark):
    a, b, c = ("%d " % k * 60 for k in (11, 222, 3333))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    rows = [(1, a + b), (1, b + c), (1, b + c), (None, a), (None, "short"), (2, c)]
    order = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, md5(r[1])))
    expected = dict(zip(order, plain([t for _, t in order])))
    for kind, make in (("long", lambda x: x), ("string", lambda x: x and f"id{x}")):
        df = spark.createDataFrame([(make(i), t, 0) for i, t in rows], f"doc_id {kind}, text string, __doc int")
        got = sorted(tuple(r)[1:] for r in suffixes.digests(df).collect())
        assert got == sorted(expected[r] for r in rows)
    assert suffixes.digests(df.limit(0)).count() == 0

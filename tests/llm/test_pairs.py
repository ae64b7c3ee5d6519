import random

import numpy as np
import pytest
import xxhash

from chatpack.llm import simhash, vectors
from chatpack.llm.components import connected_components


def unions(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 140)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    expected = unions(200, pairs)
    assert got == {x: expected[x] for x in {x for p in pairs for x in p if p[0] != p[1]}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(30)]
    docs = []
    for t in base:
        docs.append(t)
        for _ in range(rng.randint(0, 3)):
            x = t.split()
            x[rng.randrange(len(x))] = rng.choice(words)
            docs.append(" ".join(x).upper())
    docs += [None, "", "  \n", "one", "ONE", "a b c", "É é"] + [base[0]] * 20
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in docs]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in enumerate(unions(len(fps), links))}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_null_and_equal_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q w e r t z u")], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5)]
    assert sorted(r.doc_id or 0 for r in simhash.one_of_each(df).collect()) == [0, 0, 5]


def test_long_keys_are_compared_tile_by_tile(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 60, (900, 1), dtype=np.uint64)
    x[300:] = x[rng.integers(0, 300, 600)] ^ (np.uint64(1) << rng.integers(0, 60, (600, 1), dtype=np.uint64))
    x = x[np.argsort(np.bitwise_count(x[:, 0]), kind="stable")]
    links = [(i, j) for i in range(900) for j in np.flatnonzero(np.bitwise_count(x[i, 0] ^ x[:i, 0]) <= 4).tolist()]
    label, found = simhash.tiled(x, 4)
    assert label.tolist() == unions(900, links)
    found = [(int(i), int(j)) for a, b in found for i, j in zip(a, b)]
    assert {(j, i) for i, j in found} <= set(links) and unions(900, found) == unions(900, links)
    monkeypatch.setattr(simhash, "PENDING", 10)
    assert simhash.tiled(x, 4)[0].tolist() == unions(900, links)


def test_spanning_links_connect_what_is_connected_at_any_distance():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 30, 400))
    x = rng.integers(0, 1 << 14, (400, 1), dtype=np.uint64)
    got = [(int(i), int(j)) for a, b in simhash.spanning_links(key, x, 5) for i, j in zip(a, b)]
    far = np.bitwise_count(x ^ x[:, 0])
    for radius in range(6):
        links = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and far[i, j] <= radius]
        assert unions(400, [p for p in got if far[p] <= radius]) == unions(400, links)
    assert all(far[p] <= 5 for p in got) and len(got) == 400 - len(set(unions(400, got)))


def test_similarity_of_sketches():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    for a, b in ((h[:90], h[10:100]), (h[:2700], h[300:]), (h[:50], h[:2000]), (h[:0], h[:0]), (h[:0], h[:5])):
        exact = len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) or len(b) else 1.0
        got = simhash.jaccard(simhash.sketch(a, 256), simhash.sketch(b, 256), 256)
        assert got == exact if len(a) < 256 and len(b) < 256 else abs(got - exact) < 0.1


def test_one_of_each_goes_by_similarity(spark):
    """Removed documents have an earlier one of 0.8 or are linked over others; only those right at the bound may differ."""
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(30, 220))) for _ in range(60)]
    texts = [x for t in base for x in (t, *(near_copy(rng, t, rng.choice((0.0, 0.01, 0.03, 0.08, 0.3))) for _ in range(3)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    expected = {i for i, c in enumerate(unions(len(texts), links)) if i == c}
    assert expected <= kept and len(kept - expected) <= 0.03 * len(texts)


def near_copy(rng, text, share):
    w = text.split()
    for k in rng.sample(range(len(w)), int(len(w) * share)):
        w[k] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def test_one_of_each_keeps_one_copy_and_all_others(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, near_copy(rng, t, 0.01)) for i, t in enumerate(base[:20])] + [(200 + i, base[0]) for i in range(5)]
    kept = sorted(r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == list(range(40))


@pytest.mark.parametrize("tile_rows", [4096, 16])
def test_vectors(spark, tile_rows):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 16))
    x = np.concatenate([centers[rng.integers(0, 12, 150)] + 0.12 * rng.standard_normal((150, 16)), rng.standard_normal((40, 16))])
    x = np.concatenate([x, x[:10], x[:1].repeat(15, axis=0)]).astype(np.float32)
    label = rng.integers(0, 3, len(x))
    label[190:] = np.concatenate([label[:10], label[:1].repeat(15)])
    rows = [(i, [float(v) for v in x[i]], int(label[i]), "c") for i in range(len(x))]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(900 + i, v, 0, "c") for i, v in enumerate(odd)] + [(990, rows[0][1], None, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, tile_rows=tile_rows).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    component = unions(len(x), np.argwhere(near).tolist())
    found, true = sum(got[i][0] for i in range(len(x))), int(near.sum())
    assert found <= true and found >= 0.95 * true
    assert np.mean([got[i][1] == component[i] for i in range(len(x))]) > 0.95
    assert all(got[i] == (0, i, True) for i in (*range(900, 906), 990))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_one_name_count_for_themselves(spark):
    a, b, c, d = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.99, 0.05, 0.0], [0.0, 0.99, -0.05, 0.0]
    rows = [(1, a), (2, [0.99, 0.05, 0.0, 0.0]), (1, b), (3, c), (4, d), (1, a), (None, a)]
    df = spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<double>, label string, cid int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(0, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_vectors_at_the_bound_are_found(spark):
    """Recall of pairs at cosines from 0.93 to 0.95, by brute force, in labels of uneven size."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.93, 0.95, 1500)[:, None]
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos * cos) * side])
    label = np.tile(np.where(rng.random(1500) < 0.4, 0, rng.integers(1, 6, 1500)), 2)
    df = spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(both.tolist(), label))], "vec_id long, embedding array<double>, label int")
    near = (both @ both.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(got.values()) >= 0.95 * near.sum() > 2000


def test_tables_follow_the_rows():
    sizes = [vectors.tables_for(n) for n in (0, 1_000, 100_000, 10**9)]
    assert sizes == sorted(sizes) and sizes[0][0] == vectors.HASHES < sizes[-1][0] and sizes[-1][1] < 500


def test_copies_in_a_large_family_of_looser_likeness_are_found(spark, monkeypatch):
    """A key of more than a tile whose pairs are within the radius but not alike does not hide real copies."""
    monkeypatch.setattr(simhash, "COPY_BITS", 0)  # one key for all, as a key of a much larger family
    monkeypatch.setattr(simhash, "COPY_TABLES", 2)
    rng = random.Random(13)
    shared = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for k in range(330):  # about 0.75 to each other: the same words but for an end of their own
        texts.append(" ".join(shared + [f"v{k}x{i}" for i in range(30)]))
    texts += [" ".join([*t.split()[:-4], *(f"q{n}y{i}" for i in range(4))]) for n, t in enumerate(texts[:60])]
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    component = unions(len(texts), links)
    assert len(set(component)) == 330
    kept = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(range(330))


def test_only_checked_pairs_join():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 62, (1, 4), dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (700, 4), dtype=np.uint64))
    x = x[np.argsort(np.bitwise_count(x).sum(axis=1), kind="stable")]
    own, zero = np.arange(700), np.zeros(700, np.int64)
    good = {tuple(sorted(p)) for p in rng.integers(0, 700, (200, 2)).tolist()}
    a, b = simhash.verified(zero, own, zero, x, 51, [[0, 0, 0, 0]], lambda i, j: (i, j) in good)
    pairs = list(zip(a.tolist(), b.tolist()))
    assert set(pairs) <= good and unions(700, pairs) == unions(700, [p for p in good if p[0] != p[1]])


def test_long_keys_are_cut_into_cells(spark, monkeypatch):
    """No group holds more than about two parts of a key, and links connect the same as with whole keys."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 20)
    rng = np.random.default_rng(12)
    x = rng.integers(0, 1 << 40, 300, dtype=np.uint64)
    x[80:] = x[rng.integers(0, 80, 220)] ^ (np.uint64(1) << rng.integers(0, 40, 220, dtype=np.uint64))
    x = np.unique(x)
    classes = spark.createDataFrame([(f"{v:016x}", n) for n, v in enumerate(x.tolist())], "fp string, low long")
    masks = [[1 << 63], [0b11]]
    cells = simhash.grouped(simhash.keyed(classes, masks), 1, 20)
    assert cells.groupBy(*simhash.CELL).count().agg({"count": "max"}).first()[0] <= 75
    met = cells.select(*simhash.CELL, "low").collect()
    together = {}
    for r in met:
        together.setdefault(tuple(r[:4]), []).append(r.low)
    pairs = {(r, s) for g in together.values() for r in g for s in g if r < s}
    assert len(pairs) == len(x) * (len(x) - 1) // 2  # the first mask's one key holds all pairs
    links = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 4]
    for spanning in (False, True):
        found = [(r.low_a, r.low_b) for r in simhash.near_links(classes, 4, masks, spanning).collect()]
        assert unions(len(x), found) == unions(len(x), links)
    monkeypatch.setattr(simhash, "CELL_SKETCHES", 20)
    test_copies_in_a_large_family_of_looser_likeness_are_found(spark, monkeypatch)

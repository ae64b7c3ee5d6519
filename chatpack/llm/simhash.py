"""SimHash fingerprints of word shingles, and near-duplicates by tiled exact comparison.

Fingerprints within the radius of each other are found without comparing all pairs.
The bits are cut into blocks; two fingerprints that differ in at most ``radius`` bits
agree in all but ``radius`` blocks, so they share the value of at least one choice of
``blocks - radius`` blocks. Each distinct fingerprint goes to one key for each such choice.
The rows of a key lie together, sorted by population count, and are compared in
tiles with numpy exclusive-or and bit counts; a pair of tiles whose population
counts differ by more than the radius cannot hold a link and is skipped.

A key of more than ``CELL_ROWS`` rows is cut into parts by a hash, and each pair of parts is a
cell: a group, and so a task's work, of its own. No key has to fit in one task, and
each pair of a key's rows meets in a cell. A cell emits one link for each of its
fingerprints at most (to the smallest that it is connected with inside the cell), so a row
has a link for each mask, and in a key of n cells' rows n - 1 of them. Exact copies share a fingerprint and are one row from the start.

Wide fingerprints (several lanes of 64 bits) and large radii have no such choice of
blocks that would keep keys small. There keys are samples of bits: enough of them
that two fingerprints at the radius meet in one with a probability near 1. Fingerprints
so far apart say little about texts, so there the links of a key are a minimum spanning
forest (what is connected at any smaller distance stays connected by its links), and each
link is then checked by the similarity of the texts' shingles. A link that fails may have
stood for pairs that pass. So the rows around failed links meet once more under their keys, and
each pair within the radius that no checked links connect is checked itself (``hidden``).

Defined results: a null text counts as empty; a text without words has the fingerprint
zero and links like any other; texts of fewer words than a shingle are one shingle;
repeated rows, and rows with equal ids, get equal results; a null id stays null
and never becomes a component's name (its component is null if no row has an id).
An empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import pieces, raw_texts
from chatpack.llm.components import connected_components, stored
from chatpack.llm.vectors import whole_groups

SEED = 42
#: Rows of a tile in the exact comparison, and pairs of tiles that wait to be joined.
TILE, PENDING = 256, 1_000_000
#: Rows of the parts of long keys: a cell holds up to twice as many. Rows with sketches are larger.
CELL_ROWS, CELL_SKETCHES = 65_536, 8_192
#: The columns that make a group.
CELL = ["choice", "part", "c1", "c2"]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of all word shingles of a text with A-Z lower-cased; repeats included."""
    w = text.lower().split()  # bytes: only A-Z changes, and only ASCII white space splits
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    n = len(w) - words + 1
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64-bit hashes from the first, for wider fingerprints; lane 0 is the hash."""
    if not lane:
        return h
    x = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> list[int]:
    """Bits that are set in over half the hashes, 64 for each lane."""
    if not len(h):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        x, votes = _mixed(h, lane), np.zeros(64, np.int64)
        for at in range(0, len(x), 8192):
            part = np.ascontiguousarray(x[at : at + 8192]).astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0]))
    return out


def sketch(h: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest distinct hashes, cut to 31 bits; all of them if there are fewer."""
    return np.unique((h >> np.uint64(33)).astype(np.int32))[:size]


def jaccard(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Similarity of two sets by their sketches: exact if both are whole, else over the ``size`` smallest of both."""
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    n = len(both) - int(again.sum())
    if max(len(a), len(b)) >= size and n > size:
        again, n = again[np.cumsum(~again) < size], size
    return float(again.sum()) / n if n else 1.0


def fingerprints(docs: DataFrame, words: int = 4, lanes: int = 1, size: int = 0) -> DataFrame:
    """(doc_id, fp), and with ``size`` a sketch of so many hashes: the fingerprint's lanes in hex."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                fps, own = [], []
                for t in raw_texts(part, "text"):
                    h = shingle_hashes(t, words)
                    fps.append("".join(f"{x:016x}" for x in fingerprint(h, lanes)))
                    if size:
                        own.append(sketch(h, size))
                columns = {"doc_id": part.column("doc_id"), "fp": pa.array(fps, pa.string())}
                if size:
                    columns["sketch"] = pa.array(own, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp string" + ", sketch array<int>" * bool(size))


def block_masks(radius: int, blocks: int) -> list[list[int]]:
    """Bit masks of one lane, of which fingerprints within the radius agree in at least one."""
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [[sum(masks[k] for k in c)] for c in combinations(range(blocks), blocks - radius)]


def sampled_masks(lanes: int, bits: int, tables: int, seed: int = 7) -> list[list[int]]:
    """Bit masks that each take ``bits`` random bits of all lanes.

    Fingerprints that differ in a share p of their bits meet in one of them with a
    probability of 1 - (1 - (1 - p) ** bits) ** tables.
    """
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        own = [0] * lanes
        for k in rng.choice(64 * lanes, bits, replace=False).tolist():
            own[k // 64] |= 1 << (k % 64)
        out.append(own)
    return out


def _node(low: str, fp: str):
    """A class of copies among the nodes: its smallest id, or its fingerprint if no row has an id."""
    return F.struct(
        F.col(low).isNull().alias("no_id"), F.coalesce(low, F.lit(0)).alias("low"), F.when(F.col(low).isNull(), F.col(fp)).otherwise("").alias("fp")
    )


def near_links(classes: DataFrame, radius: int, masks: list[list[int]], spanning: bool = False) -> DataFrame:
    """(low_a, fp_a, low_b, fp_b): links between distinct fingerprints ``classes`` (fp, low) that connect those within the radius.

    Fingerprints that agree under one of ``masks`` are compared; the links returned have
    the connected components of all pairs found, with at most one link a row and mask.
    With ``spanning`` they are pairs within the radius, nearest ones first.
    """
    lanes = len(masks[0])

    def compare(batches):
        for rows, key in whole_groups(batches, len(CELL)):
            x, low = lanes_of(rows, lanes), rows.column("low")
            for a, b in (spanning_links if spanning else star_links)(key, x, radius):
                yield pa.RecordBatch.from_arrays([low.take(pa.array(a)), hex_names(x[a]), low.take(pa.array(b)), hex_names(x[b])], names=["low_a", "fp_a", "low_b", "fp_b"])

    return grouped(keyed(classes.select("fp", "low"), masks), lanes, CELL_ROWS).mapInArrow(compare, "low_a long, fp_a string, low_b long, fp_b string")


def keyed(classes: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(choice, part, pop, f0, f1, ..) and the columns of ``classes`` but fp: a row for each fingerprint and mask."""
    lanes = len(masks[0])
    others = [c for c in classes.columns if c != "fp"]

    def keys(batches):
        for batch in batches:
            packed = np.frombuffer(bytes.fromhex("".join(batch.column("fp").to_pylist())), ">u8").astype(np.uint64).reshape(-1, lanes)
            pop = np.bitwise_count(packed).sum(axis=1, dtype=np.int32)
            values = [pa.array(packed[:, k].copy().view(np.int64)) for k in range(lanes)]
            for number, mask in enumerate(masks):
                part = np.zeros(len(packed), np.uint64)
                for k, m in enumerate(mask):
                    part = _mixed((packed[:, k] & np.uint64(m)) ^ part, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(packed), number, np.int32)), pa.array(part.view(np.int64)), pa.array(pop), *values, *(batch.column(c) for c in others)],
                    names=["choice", "part", "pop", *fields_of(lanes), *others])

    columns = "".join(f", {k} long" for k in [*fields_of(lanes), *others])
    return classes.mapInArrow(keys, f"choice int, part long, pop int{columns}")


def grouped(rows: DataFrame, lanes: int, cell_rows: int) -> DataFrame:
    """``rows`` with those of a cell together, by population count: keys of up to ``cell_rows`` rows are one cell."""
    others = [c for c in rows.columns if c not in CELL]
    large = stored(rows.groupBy("choice", "part").count().where(F.col("count") > cell_rows)
                   .select("choice", "part", F.ceil(F.col("count") / cell_rows).cast("int").alias("parts")))
    if large.isEmpty():
        rows = rows.withColumns({"c1": F.lit(0), "c2": F.lit(0)})
    else:
        rows = rows.join(F.broadcast(large), ["choice", "part"], "left").withColumn("mine", F.pmod(F.xxhash64(*fields_of(lanes)), F.coalesce("parts", F.lit(1))).cast("int"))
        every = F.filter(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda k: F.col("parts").isNull() | (k != F.col("mine")))
        rows = rows.withColumn("with", F.explode(every)).withColumns({"c1": F.least("mine", "with"), "c2": F.greatest("mine", "with")})
    return rows.select(*CELL, *others).repartition(*CELL).sortWithinPartitions(*CELL, "pop", *fields_of(lanes))


def fields_of(lanes: int) -> list[str]:
    return [f"f{k}" for k in range(lanes)]


def lanes_of(rows: pa.RecordBatch, lanes: int) -> np.ndarray:
    return np.stack([rows.column(k).to_numpy().view(np.uint64) for k in fields_of(lanes)], axis=1)


def hidden(classes: DataFrame, links: DataFrame, checked: DataFrame, fps: DataFrame, radius: int, masks: list[list[int]], least: float, size: int) -> DataFrame:
    """Links that pass the check and that failed ones of ``links`` hid; ``checked`` are those that passed.

    A pair is hidden if its ends are within the radius and meet under a mask, but only links of
    which some failed connect them. Each of its ends is then in a component of ``checked`` that a failed link
    touches. Rows of such components are compared again, by fingerprints first, so that only rows
    with a neighbour in another component need their sketches, and only under the first mask of the pair.
    """
    lanes, fields = len(masks[0]), fields_of(len(masks[0]))
    of = stored(components(classes, checked))
    sides = links.select("fp_a", "fp_b").join(of.toDF("fp_a", "one"), "fp_a").join(of.toDF("fp_b", "two"), "fp_b").where("one <> two")
    touched = stored(sides.select("one").union(sides.select("two")).distinct().toDF("component_id"))
    again = stored(classes.join(of, "fp").join(touched, "component_id").select("fp", "low", F.col("component_id").alias("own")))

    def apart(batches):
        for rows, key in whole_groups(batches, len(CELL)):
            x, own, choice = lanes_of(rows, lanes), rows.column("own").to_numpy(), rows.column("choice").to_numpy()
            some = np.zeros(len(x), bool)
            for a, b, _ in pairs_apart(key, own, choice, x, radius, masks):
                some[a] = some[b] = True
            yield rows.drop_columns(["c1", "c2"]).filter(pa.array(some))

    kind = "choice int, part long, pop int" + "".join(f", {k} long" for k in [*fields, "low", "own"])
    near = stored(grouped(keyed(again, masks), lanes, CELL_ROWS).mapInArrow(apart, kind).distinct())
    name = F.concat(*[F.lpad(F.lower(F.hex(k)), 16, "0") for k in fields])
    # The sketch of a fingerprint is that of its smallest id, as in ``similar``.
    ends = near.select(name.alias("fp"), "low").distinct()
    own = stored(fps.select("fp", F.col("doc_id").cast("long").alias("low"), "sketch").join(ends, ["fp", "low"]).groupBy("fp").agg(F.min("sketch").alias("sketch")))

    def check(batches):
        for rows, key in whole_groups(batches, len(CELL)):
            x, low, sketches = lanes_of(rows, lanes), rows.column("low"), rows.column("sketch")
            label = rows.column("own").to_numpy()
            flat, at = sketches.values.to_numpy(), sketches.offsets.to_numpy()
            alike = lambda i, j: jaccard(flat[at[i] : at[i + 1]], flat[at[j] : at[j + 1]], size) >= least
            a, b = verified(key, label, rows.column("choice").to_numpy(), x, radius, masks, alike)
            yield pa.RecordBatch.from_arrays([low.take(pa.array(a)), hex_names(x[a]), low.take(pa.array(b)), hex_names(x[b])], names=["low_a", "fp_a", "low_b", "fp_b"])

    both = near.withColumn("fp", name).join(own, "fp").select("choice", "part", "pop", *fields, "low", "own", "sketch")
    return grouped(both, lanes, CELL_SKETCHES).mapInArrow(check, "low_a long, fp_a string, low_b long, fp_b string")


def pairs_apart(key: np.ndarray, own: np.ndarray, choice: np.ndarray, x: np.ndarray, radius: int, masks: list[list[int]]):
    """(a, b, distance) of the pairs of a key within the radius and in different components ``own``.

    A pair that also meets under an earlier mask is left to it.
    """
    bits = np.array(masks, np.uint64)

    def first(a, b, far):
        differ, met = x[a] ^ x[b], np.zeros(len(a), bool)
        for k in range(int(choice[a].max(initial=0))):
            met |= (k < choice[a]) & ~(differ & bits[k]).any(axis=1)
        return a[~met], b[~met], far[~met]

    small, long = small_and_long(key)
    count = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    for start, n in long:
        for at in range(start, start + n, TILE):
            stop = min(at + TILE, start + n)
            for to in range(at, start + n, TILE):
                if count[to] - count[stop - 1] > radius:
                    break
                until = min(to + TILE, start + n)
                other = own[at:stop, None] != own[None, to:until]
                if other.any():
                    far = distance(x[at:stop, None], x[None, to:until])
                    i, j = np.nonzero(other & (far <= radius))
                    once = i + at < j + to
                    yield first(i[once] + at, j[once] + to, far[i, j][once])
    a, b, far = near_pairs(key[small], x[small], radius)
    other = own[small[a]] != own[small[b]]
    yield first(small[a[other]], small[b[other]], far[other])


def verified(key, own, choice, x, radius: int, masks: list[list[int]], alike):
    """Positions (a, b) of pairs that pass ``alike`` and connect all that such pairs connect, nearest ones first.

    Only pairs that passed join their components, so none stands in for one that was not checked.
    """
    label = np.unique(own, return_inverse=True)[1].tolist()
    root = list(range(max(label, default=0) + 1))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    out = []
    for a, b, far in pairs_apart(key, own, choice, x, radius, masks):
        order = np.argsort(far, kind="stable")
        for i, j in zip(a[order].tolist(), b[order].tolist()):
            one, two = find(label[i]), find(label[j])
            if one != two and alike(i, j):
                root[max(one, two)] = min(one, two)
                out.append((i, j))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def similar(links: DataFrame, fps: DataFrame, least: float, size: int) -> DataFrame:
    """Those of ``links`` whose texts' shingles have a similarity of ``least``, by the sketches in ``fps``."""
    ends = links.select(F.col("fp_a").alias("fp"), F.col("low_a").alias("low")).union(links.select("fp_b", "low_b")).distinct()
    rows = fps.select("fp", F.col("doc_id").cast("long").alias("low"), "sketch")
    # The row of the smallest id stands for all of its fingerprint, so a hot fingerprint is one row.
    own = stored(rows.join(ends, ["fp", "low"]).groupBy("fp").agg(F.min("sketch").alias("sketch")))
    both = links.join(own.toDF("fp_a", "sketch_a"), "fp_a").join(own.toDF("fp_b", "sketch_b"), "fp_b")

    def check(batches):
        for batch in batches:
            a, b = (batch.column(k) for k in ("sketch_a", "sketch_b"))
            near = [jaccard(x.values.to_numpy(), y.values.to_numpy(), size) >= least for x, y in zip(a, b)]
            yield batch.select(["low_a", "fp_a", "low_b", "fp_b"]).filter(pa.array(near, pa.bool_()))

    return both.select("low_a", "fp_a", "low_b", "fp_b", "sketch_a", "sketch_b").mapInArrow(check, "low_a long, fp_a string, low_b long, fp_b string")


def hex_names(x: np.ndarray) -> pa.Array:
    text, size = np.ascontiguousarray(x).astype(">u8").tobytes().hex(), 16 * x.shape[1]
    return pa.array([text[k : k + size] for k in range(0, len(text), size)], pa.string())


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, summed over the lanes of the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def small_and_long(key: np.ndarray):
    """Positions of the rows whose keys fit a tile, and (start, length) of each longer key."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    return np.flatnonzero(np.repeat(size <= TILE, size)), list(zip(first[size > TILE].tolist(), size[size > TILE].tolist()))


def near_pairs(key: np.ndarray, x: np.ndarray, radius: int):
    """(a, b, distance) of all pairs of a key within the radius, for keys that fit a tile.

    All keys are compared together, each row with the next one, the one after that and so
    on while any key is that long.
    """
    found = []
    for d in range(1, TILE):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        far = distance(x[i], x[i + d])
        near = far <= radius
        found.append((i[near], i[near] + d, far[near]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def star_links(key: np.ndarray, x: np.ndarray, radius: int):
    """Positions (a, b) of links that connect what lies within the radius inside each key."""
    small, long = small_and_long(key)
    for at, n in long:
        label = tiled(x[at : at + n], radius)[0]
        child = np.flatnonzero(label != np.arange(n))
        yield child + at, label[child] + at
    a, b, _ = near_pairs(key[small], x[small], radius)
    if len(a):
        label = merged(np.arange(len(small)), a, b)
        child = np.flatnonzero(label != np.arange(len(small)))
        yield small[child], small[label[child]]


def spanning_links(key: np.ndarray, x: np.ndarray, radius: int):
    """Positions (a, b) of a minimum spanning forest of the pairs within the radius inside each key.

    Long keys skip tiles that are connected already; there the forest is of the pairs compared.
    """
    small, long = small_and_long(key)
    for at, n in long:
        for a, b in tiled(x[at : at + n], radius)[1]:
            yield a + at, b + at
    a, b, far = near_pairs(key[small], x[small], radius)
    if len(a):
        k = forest(np.arange(len(small)), a, b, far)[1]
        yield small[a[k]], small[b[k]]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray):
    """Labels after the pairs (a, b) are joined, and which pairs join them: a minimum spanning forest by ``far``.

    In each round every group takes its nearest pair (ties: the first by a, then b), until no
    pair joins two groups.
    """
    order = np.lexsort((b, a, far))
    taken = [np.zeros(0, np.int64)]
    while True:
        one, two = label[a[order]], label[b[order]]
        apart = one != two
        order, one, two = order[apart], one[apart], two[apart]
        if not len(order):
            return label, np.concatenate(taken)
        best = np.full(len(label), len(order))
        np.minimum.at(best, np.concatenate([one, two]), np.tile(np.arange(len(order)), 2))
        pick = order[np.unique(best[best < len(order)])]
        taken.append(pick)
        label = merged(label, a[pick], b[pick])


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the groups of each pair (a, b) are joined: the smallest position of each group."""
    a, b, root = label[a], label[b], np.arange(len(label))
    while True:
        before = root
        root = root.copy()
        low = np.minimum(before[a], before[b])
        for k in (before[a], before[b], a, b):
            np.minimum.at(root, k, low)
        root = root[root]
        if np.array_equal(before, root):
            return root[label]


def tiled(x: np.ndarray, radius: int):
    """For one long key, sorted by population count: the smallest connected position of each row, and links.

    The links are lists of pairs (a, b) within the radius that connect what is connected. Pairs
    are joined as soon as there are ``PENDING`` of them, so that a large group takes little memory.
    """
    count = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    label, links, pairs = np.arange(len(x)), [], []

    def join():
        nonlocal label
        if pairs:
            a, b, far = (np.concatenate(v) for v in zip(*pairs))
            label, k = forest(label, a, b, far)
            links.append((a[k], b[k]))
            pairs.clear()

    for at in range(0, len(x), TILE):
        stop = min(at + TILE, len(x))
        for to in range(at, len(x), TILE):
            if count[to] - count[stop - 1] > radius:
                break  # this tile and all later ones differ too much in population count
            until = min(to + TILE, len(x))
            group = np.concatenate([label[at:stop], label[to:until]])
            if group.min() == group.max():
                continue  # all of them are connected already
            far = distance(x[at:stop, None], x[None, to:until])
            i, j = np.nonzero(far <= radius)
            off = label[i + at] != label[j + to]
            pairs.append((i[off] + at, j[off] + to, far[i, j][off]))
            if sum(len(p[0]) for p in pairs) > PENDING:
                join()
        join()
    return label, links


def classes_of(fps: DataFrame) -> DataFrame:
    """(fp, low): the distinct fingerprints, each with its smallest doc_id."""
    return stored(fps.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("low")))


def components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id) of each of ``classes``: the smallest doc_id of all documents that ``links`` reach from it."""
    nodes = links.select(_node("low_a", "fp_a").alias("a"), _node("low_b", "fp_b").alias("b"))
    cc = stored(connected_components(nodes))
    root = F.coalesce("component", "node")
    return classes.withColumn("node", _node("low", "fp")).join(cc, "node", "left").select(
        "fp", F.when(~root.getField("no_id"), root.getField("low")).alias("component_id")
    )


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; exact for every pair of documents."""
    fps = stored(fingerprints(docs, words))
    classes = classes_of(fps)
    found = components(classes, near_links(classes, radius, block_masks(radius, blocks)))
    return fps.join(found, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


#: For whole-document near copies: five words, a Jaccard similarity of 0.8, and 256 bits. A
#: similarity J of shingles is a cosine of 2J / (1 + J), and bits differ with its angle / pi: 39
#: of 256 at 0.8, with a deviation of 6 bits; the radius grants two. Keys of 16 bits in 40
#: tables find 94 % of the pairs at 0.8 and 99 % of those at 0.85. Links are checked by sketches
#: of 256 hashes: exact up to so many shingles, and beyond with a deviation of 0.025.
COPY_WORDS, COPY_SIMILARITY, COPY_LANES, COPY_RADIUS, COPY_BITS, COPY_TABLES, COPY_SKETCH = 5, 0.8, 4, 51, 16, 40, 256


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each group of near copies: that of the smallest doc_id.

    Rows with equal ids are one document, of which one row stays. Rows without an id
    cannot stand for a group; they stay as they are.
    """
    fps = stored(fingerprints(docs.where("doc_id is not null"), COPY_WORDS, COPY_LANES, COPY_SKETCH))
    classes = classes_of(fps)
    masks = sampled_masks(COPY_LANES, COPY_BITS, COPY_TABLES)
    links = stored(near_links(classes, COPY_RADIUS, masks, spanning=True).distinct())
    checked = stored(similar(links, fps, COPY_SIMILARITY, COPY_SKETCH))
    more = stored(hidden(classes, links, checked, fps, COPY_RADIUS, masks, COPY_SIMILARITY, COPY_SKETCH))
    found = components(classes, checked.union(more))
    kept = fps.join(found, "fp").where("doc_id = component_id").select("doc_id").distinct()
    with_id = docs.join(kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id is null"))

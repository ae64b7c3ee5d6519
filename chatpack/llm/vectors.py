"""Near-duplicate vectors by p-stable hashing and exact cosine checks.

Vectors are scaled to length 1. Each of a number of hash tables rounds random projections,
shifted at random, to multiples of ``width`` (the projections are Gaussian, which is stable
for Euclidean distance); vectors with the same roundings share a bucket. At a cosine of 0.93
the distance is 0.374, and two such vectors agree in one projection with a probability of 0.80.
The number of projections follows the rows of the largest label, so that a bucket holds few
vectors that are not near, and the number of tables follows the projections, so that a pair at
the bound meets in some table with the probability ``RECALL``. The tables grow with about the
fourth root of the rows.

Vectors themselves are not sent to the buckets: a row of a bucket is its key, the vector's number
and 64 sign bits of further projections. Only rows that share their bucket with one whose sign
bits are near, and all rows of buckets of more than ``TILE_ROWS``, then meet with their vectors.
There pairs are checked by their cosine in double precision, so no link is below the bound.

Equal vectors of a label become one class with a count and a number of its own. A bucket
emits one row for each of its classes at most: how many vectors it links with (each
pair counts in the first table in which it meets) and the smallest class it is connected
with. Buckets of more than ``TILE_ROWS`` rows are cut into tiles, and each pair of
tiles is a piece of work of its own, so no bucket has to fit in one task.

Defined results: vectors that are null, zero or hold null, NaN or infinite parts, and
vectors without a label, link with nothing: no links, their own component, kept. Vectors
of different lengths do not link. Rows with equal vec_id count as vectors of their own
with one name; equal ones are one class, others have links and components of their own.
A null vec_id links with nothing. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.components import connected_components, stored

COSINE, WIDTH, SEED = 0.93, 1.5, 11
#: Projections of a table at least, others that a bucket holds on average, and pairs at the bound that meet.
HASHES, OTHERS, RECALL = 10, 4.0, 0.98
#: Sign bits of a row, and the deviations of their number that differs which count as near.
SIGNS, DEVIATIONS = 64, 4.0
#: Rows of a bucket that are compared in one piece of work.
TILE_ROWS = 4096
#: Buckets that are cut are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_ROWS = 50_000


def agreement(distance: float, width: float) -> float:
    """Probability that one rounded projection of two points at a distance is equal."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def tables_for(rows: int, cosine: float = COSINE, width: float = WIDTH) -> tuple[int, int]:
    """(projections of a table, tables) for ``rows`` vectors that may link."""
    far = -math.log(agreement(math.sqrt(2), width))
    hashes = max(HASHES, math.ceil(math.log(max(rows, 1) / OTHERS) / far))
    met = agreement(math.sqrt(2 - 2 * cosine), width) ** hashes
    return hashes, math.ceil(math.log(1 - RECALL) / math.log1p(-met))


class PStable:
    """The hash tables for vectors of one length."""

    def __init__(self, size: int, width: float, hashes: int, tables: int, seed: int = SEED):
        rng = np.random.default_rng([seed, size])
        self.shape = (tables, hashes)
        self.lines = rng.standard_normal((size, tables * hashes))
        self.shift = rng.uniform(0, width, tables * hashes)
        self.width = width
        self.mix = rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1
        self.sides = rng.standard_normal((size, SIGNS))

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """For each vector on which sides of random planes it lies, as the bits of a number."""
        return np.packbits(unit @ self.sides > 0, axis=1).view(np.int64)[:, 0]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row for each vector with its key in every table."""
        cells = np.floor((unit @ self.lines + self.shift) / self.width).astype(np.int64)
        with np.errstate(over="ignore"):
            return (cells.reshape(-1, *self.shape) * self.mix).sum(axis=2)


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def link_counts(classes: DataFrame, cosine: float, width: float, hashes: int, tables: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(cid, links, root) from distinct vectors ``classes`` (cid, label, size, copies, embedding).

    A row of ``classes`` appears in the result once for each bucket in which it has links
    of its own or a smaller connected class; links add up over the rows.
    """

    def keyed(batches):
        made: dict[int, PStable] = {}
        for batch in batches:
            sizes, salt = batch.column("size").to_numpy(), batch.column("salt").to_numpy()
            for size in np.unique(sizes).tolist():
                own = sizes == size
                part = batch.filter(pa.array(own))
                if size not in made:
                    made[size] = PStable(size, width, hashes, tables)
                unit = _unit(_matrix(part.column("embedding")), size)
                keys, signs, cid = made[size].keys(unit), pa.array(made[size].signs(unit)), part.column("cid")
                for t in range(tables):
                    # Rows of different labels, sizes or tables rarely share a key; where they do, the comparison tells them apart.
                    key = (keys[:, t] ^ salt[own]) * np.int64(0x5851F42D4C957F2D) + np.int64(t)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(part.num_rows, t, np.int16)), signs, cid], names=["key", "tab", "signs", "cid"])

    rows = classes.select("size", F.xxhash64("label", "size").alias("salt"), "cid", "embedding").mapInArrow(keyed, "key long, tab short, signs long, cid long")
    large = stored(rows.groupBy("key").count().where(F.col("count") > tile_rows).select("key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")))
    n_large = large.count()
    if 0 < n_large <= BROADCAST_ROWS:
        large = F.broadcast(large)
    few = rows.join(large, "key", "left_anti") if n_large else rows
    radius = sign_radius(cosine)

    def met(batches):
        for part, group in whole_groups(batches, 1):
            yield part.select(["key", "tab", "cid"]).filter(pa.array(_with_partner(part.column("signs").to_numpy().view(np.uint64), group, radius)))

    cells = (
        few.repartition("key").sortWithinPartitions("key").mapInArrow(met, "key long, tab short, cid long")
        .withColumns({"own": F.lit(0), "c1": F.lit(0), "c2": F.lit(0)})
    )
    if n_large:
        own = F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, own).alias("c1"), F.greatest(k, own).alias("c2")))
        many = rows.join(large, "key").select("key", "tab", "cid", own.alias("own"), F.explode(others).alias("cell"))
        cells = cells.unionByName(many.select("key", "tab", "cid", "own", "cell.c1", "cell.c2"))
    group_of = ["key", "tab", "label", "size", "c1", "c2"]
    whole = stored(cells).join(classes, "cid").select(*group_of, "own", "cid", "copies", "embedding").repartition(*group_of).sortWithinPartitions(*group_of, "cid")

    def compare(batches):
        made: dict[int, PStable] = {}
        for part, group in whole_groups(batches, len(group_of)):
            sizes = part.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in made:
                    made[size] = PStable(size, width, hashes, tables)
                own = sizes == size
                out = _links(part.filter(pa.array(own)), group[own], made[size], cosine)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["cid", "links", "root"])

    return whole.mapInArrow(compare, "cid long, links long, root long")


def sign_radius(cosine: float) -> int:
    """Sign bits that differ between vectors at the bound, and ``DEVIATIONS`` more."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SIGNS * p + DEVIATIONS * math.sqrt(SIGNS * p * (1 - p)))


def _with_partner(signs: np.ndarray, group: np.ndarray, radius: int, step: int = 1024) -> np.ndarray:
    """Which rows have another one in their group within the radius."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(group)))
    out, small = np.zeros(len(group), bool), 48
    for at, n in zip(first[count > small].tolist(), count[count > small].tolist()):
        for a in range(at, at + n, step):
            x = slice(a, min(a + step, at + n))
            near = np.bitwise_count(signs[x, None] ^ signs[None, at : at + n]) <= radius
            out[x] |= near.sum(axis=1) > 1
    few = np.flatnonzero(np.repeat(count <= small, count))
    own, bits = group[few], signs[few]
    for d in range(1, small):
        k = np.flatnonzero(own[d:] == own[:-d])
        if not len(k):
            break
        k = k[np.bitwise_count(bits[k] ^ bits[k + d]) <= radius]
        out[few[k]] = out[few[k + d]] = True
    return out


def whole_groups(batches, n_keys: int, alone: bool = False):
    """Stretches of whole groups of a stream sorted by its first columns, with group numbers; groups of one row only if ``alone``.

    Rows of a group that goes on into the next batch are carried over to it.
    """
    held: list[pa.RecordBatch] = []
    end = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        last = np.ones(batch.num_rows, bool)
        for k in keys:
            last &= k == k[-1]
        first = 0 if last.all() else int(np.flatnonzero(~last)[-1]) + 1
        if first:
            yield from _numbered([*held, batch.slice(0, first)], n_keys, alone)
            held = []
        elif end is not None and tuple(k[0] for k in keys) != end:
            yield from _numbered(held, n_keys, alone)
            held = []
        held.append(batch.slice(first))
        end = tuple(k[-1] for k in keys)
    yield from _numbered(held, n_keys, alone)


def _numbered(parts: list[pa.RecordBatch], n_keys: int, alone: bool):
    if not parts:
        return
    rows = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    new = np.zeros(rows.num_rows, bool)
    for k in range(n_keys):
        x = rows.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    group = np.cumsum(new)
    shared = np.bincount(group)[group] > (0 if alone else 1)
    if shared.any():
        yield rows.filter(pa.array(shared)), group[shared]


def _near_pairs(unit: np.ndarray, group: np.ndarray, cosine: float, small: int = 48, step: int = 1024):
    """Positions (i, j), i < j, of the pairs of each group whose cosine reaches the bound."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(group)))
    found = []
    for at, n in zip(first[count > small].tolist(), count[count > small].tolist()):
        for a in range(at, at + n, step):
            for b in range(a, at + n, step):
                one, two = slice(a, min(a + step, at + n)), slice(b, min(b + step, at + n))
                i, j = np.nonzero(unit[one] @ unit[two].T >= cosine)
                found.append(((i + a)[i + a < j + b], (j + b)[i + a < j + b]))
    few = np.flatnonzero(np.repeat(count <= small, count))
    group = group[few]
    for d in range(1, small):
        k = np.flatnonzero(group[d:] == group[:-d])
        if not len(k):
            break
        i, j = few[k], few[k + d]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _links(rows: pa.RecordBatch, group: np.ndarray, tables: PStable, cosine: float):
    """Links counted in the first table of each pair, and a star to the smallest of each connected set."""
    cid, copies, tab, own = (rows.column(k).to_numpy() for k in ("cid", "copies", "tab", "own"))
    apart = rows.column("c1").to_numpy() != rows.column("c2").to_numpy()
    unit = _unit(_matrix(rows.column("embedding")), rows.column("size")[0].as_py())
    i, j = _near_pairs(unit, group, cosine)
    ok = ~(apart[i] & (own[i] == own[j]))  # pairs inside a tile are the work of another cell
    i, j = i[ok], j[ok]
    if not len(i):
        return [], [], []
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys, first = tables.keys(unit[used]), np.ones(len(i), bool)
    for at in range(0, len(i), 65_536):  # a pair that also meets in an earlier table is counted there
        s = slice(at, at + 65_536)
        meet = keys[where[: len(i)][s]] == keys[where[len(i) :][s]]
        first[s] = ~(meet & (np.arange(keys.shape[1]) < tab[i[s], None])).any(axis=1)
    i, j = i[first], j[first]
    links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)
        root = root[root]
        if np.array_equal(before, root):
            break
    some = np.flatnonzero(links)
    return cid[some], links[some], cid[root[some]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, width: float = WIDTH, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    item = F.col("embedding")
    finite = F.forall(item, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & item.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(item, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label", F.coalesce(usable, F.lit(False)).alias("usable"))
    # Equal vectors have equal names: 128 bits of hashes stand for a vector in shuffles.
    named = rows.where("usable").select("vec_id", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"), "embedding")
    name = ["label", "h1", "h2"]
    classes = stored(
        named.groupBy(*name).agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
        .withColumns({"cid": F.monotonically_increasing_id(), "size": F.size("embedding")})
    )
    rows_of_label = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashes, tables = tables_for(rows_of_label, cosine, width)
    found = stored(link_counts(classes, cosine, width, hashes, tables, tile_rows))
    totals = found.groupBy("cid").agg(F.sum("links").alias("links"))
    cc = stored(connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid"))
    # A component is named after the smallest vec_id of its classes.
    names = cc.join(classes.select("cid", "low"), "cid").groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = (
        classes.select(*name, "cid", "low", "copies").join(totals, "cid", "left").join(cc, "cid", "left").join(names, "component", "left")
        .select(*name, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    )
    linked = named.select("vec_id", *name).join(stored(by_class), name).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

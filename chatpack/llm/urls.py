"""URL filters: host and path rules, and a ratio of two character language models.

Each rule that fits a url labels it: allow or block. Over all labelled urls two
variable-order Markov models of their characters are counted, one for each label. A
character's probability interpolates the orders: that of order k is
(n(context, char) + b * p_{k-1}) / (n(context) + b), from a uniform start. A url's
score is the mean log-likelihood difference for each character; urls that no rule
fits are allowed if their score reaches the threshold. The threshold is calibrated on
a fifth of the labelled urls, with counts from which that fifth is taken out: it is the cut with the
least mean error of the two labels. Verdicts then use the counts of all labelled urls.

Counts are exact and grow with the table: a gram of up to five characters is a number, and the models are
a table of grams that no task and not the driver holds as a whole. Urls are scored in blocks of
``BLOCK_ROWS``. A block's distinct grams are joined with the counts, and a task scores
a block with the part of the models that its urls need. The histogram for the threshold has a fixed number of bins.

Defined results: a null url, or one without "://", has an empty host and path, no rule,
and is judged by the models as the text it is (null: empty). Without labelled urls of
both kinds every score is compared with 0. Urls are read whole; rows with a null page_id and repeated rows
are judged like others, and count as often as they occur; an empty table gives an empty table. Only page_id and url are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import raw_texts
from chatpack.llm.components import stored

#: Characters of the longest gram: five bytes and the number of bytes fit a long.
ORDERS = 5
STRENGTH = 2.0
#: Urls that are scored together.
BLOCK_ROWS = 100_000
#: Bins of the score histogram, over scores from -RANGE to RANGE.
BINS, RANGE = 16_000, 8.0
HOLD_OUT = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise("")


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds host, path, rule and label (1 allow, 0 block, null none) to (page_id, url).

    ``rules`` are (verdict, host, path); they fit the host and its subdomains where the
    path starts alike, and the longest wins. A rule list is configuration, not data.
    """
    df = urls.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, label = F.lit(None).cast("string"), F.lit(None).cast("int")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        label = F.when(fits, int(verdict == "allow")).otherwise(label)
    return df.withColumns({"rule": rule, "label": label})


def grams(urls: list[bytes], orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """The grams that end at each character of the urls, as numbers, a row for each order; and the urls' lengths.

    A url ends with a character of its own. Before its start lie characters that are never predicted.
    """
    pad = b"\x02" * (orders - 1)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    data = np.frombuffer(b"".join([pad + u + b"\x03" for u in urls]), np.uint8).astype(np.int64)
    real = np.ones(len(data), bool)
    starts = np.concatenate([[0], np.cumsum(sizes + orders - 1)[:-1]])
    for k in range(orders - 1):
        real[starts + k] = False
    at = np.flatnonzero(real)
    out, code = np.zeros((orders, len(at)), np.int64), np.zeros(len(at), np.int64)
    for k in range(orders):
        code = code | data[at - k] << (8 * k)
        out[k] = code | (k + 1) << (8 * ORDERS)
    return out, sizes


#: The number under which the models keep how many urls each has.
URLS = 0


def counted(labelled: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(gram, allow, block, allow_held, block_held): how often each gram stands in urls of each label, and in those of fold 0."""

    def run(batches):
        for batch in batches:
            urls, label = list(raw_texts(batch, "url")), batch.column("label").to_numpy()
            held = batch.column("fold").to_numpy() == 0
            if not urls:
                continue
            codes, sizes = grams(urls, orders)
            kind = np.repeat((label == 0) + 2 * held, sizes)
            flat = np.concatenate([codes.ravel(), np.full(len(urls), URLS)])
            kind = np.concatenate([np.tile(kind, orders), (label == 0) + 2 * held])
            both, n = np.unique(np.stack([flat, kind]), axis=1, return_counts=True)
            first = np.flatnonzero(np.diff(both[0], prepend=-1))
            row = np.zeros((len(first), 4), np.int64)
            row[np.searchsorted(first, np.arange(len(n)), "right") - 1, both[1]] = n
            row[:, :2] += row[:, 2:]  # all urls, those of the fold included
            yield pa.RecordBatch.from_arrays([pa.array(both[0][first]), *(pa.array(row[:, k].copy()) for k in range(4))], names=["gram", *COUNTS])

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return labelled.select("url", "label", "fold").mapInArrow(run, f"gram long, {kinds}").groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ["allow", "block", "allow_held", "block_held"]


def needed(blocks: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(number, gram): the distinct grams of each block's urls (number, url)."""

    def run(batches):
        for batch in batches:
            number = batch.column("number").to_numpy()
            for n in np.unique(number).tolist():
                own = np.unique(grams(list(raw_texts(batch.filter(pa.array(number == n)), "url")), orders)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own) + 1, n)), pa.array(np.append(own, URLS))], names=["number", "gram"])

    return blocks.select("number", "url").mapInArrow(run, "number long, gram long").distinct()


def log_difference(urls: list[bytes], known: np.ndarray, counts: np.ndarray, totals: np.ndarray, orders: int = ORDERS, strength: float = STRENGTH) -> np.ndarray:
    """Mean over each url's characters of log p_allow - log p_block.

    ``known`` are gram numbers in order with URLS as the first, ``counts`` their counts for allow and block, and ``totals``
    those of all characters.
    """
    codes, sizes = grams(urls, orders)
    total = np.zeros(int(sizes.sum()))
    first = np.zeros(len(total), bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    at = [np.searchsorted(known, c) for c in codes]
    for kind, sign in ((0, 1.0), (1, -1.0)):
        p = np.full(len(total), 1 / 256)
        context = np.full(len(total), float(totals[kind]))
        for k in range(orders):
            n = counts[at[k], kind].astype(np.float64)
            p = (n + strength * p) / (context + strength)
            # The context of the next order is this order's gram that ends one character earlier.
            context = np.append(0.0, n[:-1])
            context[first] = counts[0, kind]
        total += sign * np.log(p)
    return np.add.reduceat(total, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes


def scored(rows: DataFrame, counts: DataFrame, orders: int = ORDERS) -> DataFrame:
    """Adds score, and held_score from counts without fold 0, to ``rows``, which has number (of its block), url and others."""
    # Orders of one character have the empty context: all characters.
    one = F.shiftright("gram", 8 * ORDERS) == 1
    totals = np.array([x or 0 for x in counts.where(one).agg(*[F.sum(c) for c in COUNTS]).first()], np.float64)
    model = needed(rows, orders).join(counts, "gram", "left").select("number", "gram", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double, held_score double"

    def run(urls: pa.Table, part: pa.Table) -> pa.Table:
        names = [*urls.column_names, "score", "held_score"]
        if not urls.num_rows:
            return pa.table([*urls.columns, pa.array([], pa.float64()), pa.array([], pa.float64())], names=names)
        gram = part.column("gram").to_numpy()
        order = np.argsort(gram)
        n = np.stack([part.column(c).to_numpy()[order] for c in COUNTS], axis=1)
        texts = [x for b in urls.select(["url"]).to_batches() for x in raw_texts(b, "url")]
        score = [log_difference(texts, gram[order], c, t, orders) for c, t in ((n[:, :2], totals[:2]), (n[:, :2] - n[:, 2:], totals[:2] - totals[2:]))]
        return pa.table([*urls.columns, *map(pa.array, score)], names=names)

    return rows.groupBy("number").cogroup(model.groupBy("number")).applyInArrow(run, schema)


def calibrated(held: DataFrame) -> float:
    """The cut between scores of the labels (score, label) with the least mean error of the two."""
    bin_of = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1))
    n = np.zeros((2, BINS + 1))
    for r in held.groupBy("label", bin_of.alias("bin")).count().collect():
        n[r["label"], r["bin"]] = r["count"]
    if not n[0].any() or not n[1].any():
        return 0.0
    missed = np.concatenate([[0], np.cumsum(n[1])])[:-1] / n[1].sum()  # allowed urls below a cut
    passed = 1 - np.concatenate([[0], np.cumsum(n[0])])[:-1] / n[0].sum()  # blocked urls from the cut on
    best = np.flatnonzero(missed + passed == (missed + passed).min())
    return float((best[0] + best[-1]) / 2 / BINS * 2 * RANGE - RANGE)


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``urls`` (page_id, url)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT))
    # Ids grow by one inside a partition, so their quotients number blocks of rows that lie together.
    ruled = stored(with_rule(urls, rules).withColumn("fold", fold).withColumn("number", F.floor(F.monotonically_increasing_id() / block_rows).cast("long")))
    counts = stored(counted(ruled.where("label is not null")))
    rows = stored(scored(ruled, counts))
    cut = calibrated(rows.where("label is not null and fold = 0").select("label", F.col("held_score").alias("score")))
    allowed = F.coalesce(F.col("label") == 1, F.col("score") >= cut)
    return rows.select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score")

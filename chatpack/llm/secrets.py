"""Secret scans: fixed patterns, and novelty against primed zstandard compressors.

The patterns find assignments, access keys and long hex strings. The method adds
strings in a sensitive context (a word such as key, secret or credential shortly
before them) that are not explained by what is known: a compressor primed with a
dictionary of identifiers measures how many bytes the candidate adds to its
surrounding text. A string that adds nearly a byte for each character is no word, no
identifier and no copy of its surroundings, and is reported as ``novel``. Long strings are measured in pieces,
each after the ones before it; they, and hex digits (with or without dashes, as in a UUID), which hold fewer bits, need to add fewer
bytes. A password in the user part of a URL counts as in a sensitive context. Further
occurrences of a string that was reported are reported too, though they add nothing to what stands before them.

The dictionary holds common words of code and the names that are assigned to most
often in all documents of the table. Names are counted with a map-side sum; the
dictionary takes as many of the most frequent as fit its size, which bounds what
the driver gets and broadcasts.

Defined results: a null text counts as empty and has no spans; a null id is a value like any other; texts are scanned
whole, so a span may lie anywhere; repeated rows give repeated results; an empty table
gives an empty table. Offsets are code points, ends are exclusive. Other columns are
not read by the scan, and stay as they are when text is redacted.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import pieces, texts

# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_CHARS = 12
ACCESS = re.compile("AKIA[A-Z0-9]+")
ACCESS_CHARS = 18
HEX = re.compile("[0-9a-f]{16,}")

#: Sensitive words, as parts of a name, and what may stand between them and a candidate. Only the word
#: is consumed, so that a candidate may itself hold the word before the next one.
CONTEXT = re.compile(
    r"(?:[kK][eE][yY]|SECRET|[sS]ecret|TOKEN|[tT]oken|PASS|[pP]ass(?:word|wd|phrase)|[pP]wd|PWD|[aA]uth(?:orization)?\b|AUTH|[cC]redential|[bB]earer|[sS]ignature|PRIVATE|[pP]rivate|[wW]ebhook|WEBHOOK|[jJ]wt|JWT|[hH]mac|HMAC|[dD]sn\b|DSN\b)"
    r"(?=[A-Za-z0-9_.-]{0,24}[\"']?\s{0,4}(?:[:=]{1,2}|=>|\bis\b|\bwith\b|\s)\s{0,4}[\"'<(]?([A-Za-z0-9+/_.=~$-]{12,}))"
)
#: The password in a URL, up to the sign before its host.
URL_PASSWORD = re.compile(r"://[^\s:/@'\"<>]{1,64}:([A-Za-z0-9+_.=~$!%^&*-]{8,})(?=@)")
#: Characters around a candidate that the compressor knows, and of the pieces of long candidates.
BEFORE, AFTER, PIECE = 256, 64, 64
#: Bytes that a candidate must add for each of its characters. Hex digits hold four bits of the six of others; and
#: among long candidates' own characters the compressor needs no more than these bits.
NOVELTY, HEX_SHARE, LONG_SHARE = 0.8, 4 / 6, 6 / 8
#: Of more characters the share varies less by chance, so that less will do.
MIDDLE, MIDDLE_SHARE = 20, 0.9
#: Dates, versions, and names or paths of several words are no secrets, whatever they add.
PLAIN = re.compile(
    r"\d{4}-\d\d-\d\d(?:[T_ ].*)?|(?:[A-Za-z]++[-_])*+v?\d+(?:\.\d++)++(?:[-_.][A-Za-z]++\d*+)*+"
    r"|[A-Za-z][a-z]++(?:[-_./]+[a-z]{2,}+|[-_./]*+[A-Z][a-z]++)++(?:[-_./]?\d{1,3})?(?:\.[a-z]{2,5})?"
)
HEX_DIGITS = re.compile("[0-9a-f]+|[0-9A-F]+")
#: Signs that divide a string and hold nothing.
DIVIDING = str.maketrans("", "", "-_.")
DICTIONARY_BYTES = 32_768
NAME = r"([A-Za-z_][A-Za-z0-9_.-]{2,40})[\"']? *[:=]"
# Fixed value: words of code that any text may hold.
CODE_WORDS = (
    "import from class function return public private static void const let var string int float bool true false null None "
    "self this new for while if else try except catch finally raise throw print console.log config settings environment export "
    "client server request response header authorization bearer token secret password username email host port database "
    "https://www.example.com/index.html application/json content-type utf-8 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789"
)


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """Words of code and the most frequent assigned names of all documents, the most frequent last (and so nearest)."""
    names = (
        docs.where(F.col("text").contains("=") | F.col("text").contains(":"))
        .select(F.explode(F.regexp_extract_all("text", F.lit(NAME), 1)).alias("name"))
        .groupBy("name").count().orderBy(F.desc("count"), "name").limit(size // 4)
    )
    words, room = [], size - len(CODE_WORDS)
    for r in names.collect():
        room -= len(r["name"]) + 1
        if room < 0:
            break
        words.append(r["name"])
    return " ".join([CODE_WORDS, *reversed(words)]).encode()


def pieces_of(size: int) -> int:
    return max(1, round(size / PIECE))


class Novelty:
    """Marginal compressed size of a string inside its surroundings."""

    def __init__(self, dictionary: bytes, level: int = 9):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False)

    def ratio(self, text: str, start: int, end: int) -> float:
        """Added bytes for each byte of ``text[start:end]``, measured in pieces of about ``PIECE`` characters."""
        count = pieces_of(end - start)
        edges = [start + (end - start) * k // count for k in range(count + 1)]
        # Copies that follow do not explain the first one.
        rest, added = text[end : end + AFTER].replace(text[start:end], "").encode(), 0
        for a, b in zip(edges, edges[1:]):
            before = text[max(0, a - BEFORE) : a].encode()
            added += len(self.packer.compress(before + text[a:b].encode() + rest)) - len(self.packer.compress(before + rest))
        return added / len(text[start:end].encode())


def needed(word: str, least: float) -> float:
    """Bytes that a candidate must add for each of its characters."""
    if len(word) >= MIDDLE:
        least *= MIDDLE_SHARE
    digits = word.translate(DIVIDING)
    share = HEX_SHARE * len(digits) / len(word) if HEX_DIGITS.fullmatch(digits) else 1
    return least * share * (LONG_SHARE / MIDDLE_SHARE if pieces_of(len(word)) > 1 else 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns; each kind leftmost and without overlaps."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """The fixed patterns' spans, and the novel strings that neither they nor an earlier one overlap."""
    taken = base_spans(text)
    edges = _merged(taken)
    found: list[tuple[int, int]] = []
    tried = set()
    candidates = [m.span(1) for m in CONTEXT.finditer(text)] + ([m.span(1) for m in URL_PASSWORD.finditer(text)] if "://" in text else [])
    for a, b in sorted(candidates):
        word = text[a:b]
        if (a, b) in tried or not (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)) and len(set(word)) < 12:
            continue
        if PLAIN.fullmatch(word):
            continue
        tried.add((a, b))
        if not _overlaps(edges, a, b) and novelty.ratio(text, a, b) >= needed(word, least):
            found.append((a, b))
            insort(edges, (a, b))
    for word in sorted({text[a:b] for a, b in found}):
        at = text.find(word)
        while at >= 0:
            if not _overlaps(edges, at, at + len(word)):
                found.append((at, at + len(word)))
                insort(edges, found[-1])
            at = text.find(word, at + len(word))
    return sorted(taken + [(a, 3, b) for a, b in found])


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, as stretches in order that do not overlap."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(edges: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the stretches meets (a, b)."""
    k = bisect_left(edges, (b, -1))
    return k > 0 and edges[k - 1][1] > a


def scan(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """(doc_id, spans): every document's spans as an array of (kind, start, end)."""
    return _scanned(docs, least, False)


def redact(docs: DataFrame, least: float = NOVELTY) -> DataFrame:
    """``docs`` with each secret in text replaced by its kind in angle brackets; n_chars follows the text if it is there."""
    return _scanned(docs, least, True)


def _scanned(docs: DataFrame, least: float, replace: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(identifier_dictionary(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        novelty = Novelty(shared.value)
        for batch in batches:
            for part in pieces(batch):
                spans = [all_spans(t, novelty, least) for t in texts(part, "text")]
                if replace:
                    yield _replaced(part, spans)
                else:
                    rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans]
                    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, shape)], names=["doc_id", "spans"])

    if replace:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with its spans replaced; overlapping ones become one, named after the first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _replaced(part: pa.RecordBatch, spans) -> pa.RecordBatch:
    old = part.column("text").to_pylist()
    new = [without(t, s) if s else t for t, s in zip(old, spans)]
    columns = dict(zip(part.schema.names, part.columns))
    columns["text"] = pa.array(new, part.schema.field("text").type)
    if "n_chars" in columns:
        sizes = [len(t) if s else n for t, s, n in zip(new, spans, columns["n_chars"].to_pylist())]
        columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays([columns[k] for k in part.schema.names], names=part.schema.names)


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the fixed patterns, the digest of their spans, and all spans as text."""
    text_of = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text_of), ",").alias("spans"),
    )

"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its decoder.

Encoding. For every prefix of a pretoken the last token of the prefix's encoding is
unique: it is the token that ends there and forms a stable pair with the last token
of the shorter prefix it follows. The transducer keeps these last tokens for a
window of positions. ``sufficient_lookahead`` derives from the merge list alone how
many bytes after a position can still change a token boundary there; a token that
ends further back is stable and is emitted, so memory does not grow with the input.

Decoding. Token bytes go through an incremental UTF-8 state machine that keeps at
most three bytes between tokens and writes U+FFFD for what is not valid UTF-8.

Defined results: a null text counts as the empty text, which has no tokens and
decodes to the empty text; texts of any length are encoded whole; repeated rows
give repeated results; an empty table gives an empty table. Only the named columns
of the input are read, so other columns cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatpack.llm.arrow import map_rows, texts

# Fixed value: white space of the public pretoken pattern of byte-level BPE. It is written
# out, as the class \s of Python's modules also holds the separators U+001C to U+001F.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pretoken_pattern(letters: str, numbers: str) -> str:
    """The public pretoken pattern over character classes for letters and numbers."""
    return (
        rf" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d|"
        rf" ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


def category_ranges(start: str) -> str:
    """The characters up to U+FFFF whose Unicode category begins so, as ranges of a class."""
    found = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == start]
    first = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    last = [c for c, after in zip(found, [*found[1:], -2]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


#: Pretokens up to so many characters are kept with their tokens, up to so many of them.
CACHED_CHARS, CACHED_WORDS = 48, 400_000
#: Characters of an unfinished pretoken that are held back between chunks of a stream.
HELD_BACK = 16


def byte_alphabet() -> dict[str, int]:
    """The printable character of every byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeTable:
    """Tokens as bytes, and for each merged token its rank and its two parts."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], special: dict[str, int] | None = None):
        self.ids = vocab
        self.special = special or {}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, r
        self.longest = max(map(len, vocab))
        self.lookahead = sufficient_lookahead(self, merges)
        self._right = {}
        self._left = {}
        self.pairs: dict[int, bool] = {}
        # Only tokens that their own bytes are merged to take part.
        self.usable = {bytes([b]): vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        for a, b in merges:
            if a in self.usable and b in self.usable and self._only_crossing(vocab[a], vocab[b]):
                self.usable[a + b] = vocab[a + b]
        self._automaton()

    def _automaton(self) -> None:
        """Suffix automaton of the tokens: the state after some bytes knows all tokens that end there, longest first."""
        self.step: dict[int, int] = {}
        self.fail, self.ends = [0], [()]
        own: list[tuple[int, int] | None] = [None]
        order: list[tuple[int, int, int]] = []
        for data, i in self.usable.items():
            at = 0
            for byte in data:
                key = at << 8 | byte
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(own)
                    own.append(None)
                    order.append((at, byte, to))
                at = to
            own[at] = (len(data), i)
        self.fail, self.ends = [0] * len(own), [()] * len(own)
        depth = [0] * len(own)
        for at, _, to in order:  # parents come before their children
            depth[to] = depth[at] + 1
        for at, byte, to in sorted(order, key=lambda x: depth[x[2]]):
            if at:
                f = self.fail[at]
                while f and f << 8 | byte not in self.step:
                    f = self.fail[f]
                self.fail[to] = self.step.get(f << 8 | byte, 0)
            longer = self.ends[self.fail[to]]
            self.ends[to] = (own[to], *longer) if own[to] else longer

    def follow(self, state: int, byte: int) -> int:
        """The state after one more byte; found by failure links and then kept."""
        f = state
        while (to := self.step.get(f << 8 | byte)) is None:
            if not f:
                return 0
            f = self.fail[f]
        if len(self.step) < 1_000_000:
            self.step[state << 8 | byte] = to
        return to

    @classmethod
    def from_json(cls, text: str) -> "MergeTable":
        """From the text of a byte-level BPE ``tokenizer.json``."""
        doc = json.loads(text)
        model, alphabet = doc["model"], byte_alphabet()
        if model["type"] != "BPE" or (doc.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or doc.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        special = {x["content"]: x["id"] for x in doc.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in doc.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need whole words are not supported")
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return cls(vocab, [(raw(a), raw(b)) for a, b in pairs], special)

    def right_spine(self, t: int) -> list[tuple[int, float]]:
        """Tokens at the right edge while ``t`` is built, each with the rank that ends it."""
        if (out := self._right.get(t)) is None:
            out, end, x = [], float("inf"), t
            while True:
                out.append((x, end))
                if x not in self.parts:
                    break
                end, x = self.made[x], self.parts[x][1]
            self._right[t] = out
        return out

    def left_spine(self, t: int) -> list[tuple[int, float]]:
        """The same for the left edge."""
        if (out := self._left.get(t)) is None:
            out, end, x = [], float("inf"), t
            while True:
                out.append((x, end))
                if x not in self.parts:
                    break
                end, x = self.made[x], self.parts[x][0]
            self._left[t] = out
        return out

    def _crossings(self, a: int, b: int):
        """Pairs of edge tokens of ``a`` and ``b`` that a merge joins while both are built side by side.

        A rule that would take both edges fires before the rule that ends the right
        edge; against the rule that ends the left edge it may be equal, as equal
        rules go from left to right.
        """
        rank, right = self.rank, self.left_spine(b)
        return (
            (s, t)
            for s, s_end in self.right_spine(a)
            for t, t_end in right
            if (r := rank.get((s, t))) is not None and r < s_end and r <= t_end
        )

    def _only_crossing(self, a: int, b: int) -> bool:
        """Whether the rule (a, b) is the only one that joins them, so that their bytes become its token."""
        return all(pair == (a, b) for pair in self._crossings(a, b))

    def stable_pair(self, a: int, b: int) -> bool:
        """Whether no merge joins bytes of ``a`` and ``b``."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        ok = self.pairs[a << 24 | b] = next(self._crossings(a, b), None) is None
        return ok


def sufficient_lookahead(table: MergeTable, merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a position that can change whether a token ends there.

    Compare two inputs that agree up to some point. Merges keep their boundaries alike
    up to a front, which starts where the inputs differ. A rule (u, v) moves the front
    left over u if only one of the inputs holds v at the front. Later rules see u, or a
    token built from u as its leftmost part, at the new front, and ranks only grow.
    So the reach is the heaviest chain of rules whose left parts appear on the left
    edge of the next rule's right part; one token's length covers the start.
    """
    reach: dict[int, int] = {}
    most = 0
    for a, b in merges:
        left, x, behind = table.ids[a], table.ids[b], 0
        while True:
            behind = max(behind, reach.get(x, 0))
            if x not in table.parts:
                break
            x = table.parts[x][0]
        here = len(a) + behind
        reach[left] = max(reach.get(left, 0), here)
        most = max(most, here)
    return most + table.longest


class WordTransducer:
    """Encodes the bytes of one pretoken, given piece by piece, in constant memory."""

    def __init__(self, table: MergeTable):
        self.t = table
        self.state = 0
        self.last: list[int] = []  # last token of each prefix that ends inside the window
        self.before = -1  # last emitted token
        self.keep = table.lookahead + table.longest

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = max(256, self.keep)
        for at in range(0, len(data), step):
            self._extend(data[at : at + step])
            if len(self.last) > 2 * self.keep:
                out += self._emit(len(self.last) - self.t.lookahead)
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.last))
        self.state, self.last, self.before = 0, [], -1
        return out

    def _extend(self, data: bytes) -> None:
        t, last, state = self.t, self.last, self.state
        step, ends, pairs = t.step.get, t.ends, t.pairs.get
        end = len(last)
        for byte in data:
            end += 1
            to = step(state << 8 | byte)
            state = t.follow(state, byte) if to is None else to
            for size, i in ends[state]:  # exactly one of them fits; mostly the longest
                if size < end:
                    left = last[end - size - 1]
                elif size == end:
                    left = self.before
                    if left < 0:
                        break
                else:
                    continue
                ok = pairs(left << 24 | i)
                if ok or ok is None and t.stable_pair(left, i):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
            last.append(i)
        self.state = state

    def _emit(self, upto: int) -> list[int]:
        """Tokens of the current prefix that end at or before ``upto``; the window moves past them."""
        last, size = self.last, self.t.size_of
        out: list[int] = []
        at, cut = len(last), 0
        while at > 0:
            i = last[at - 1]
            if at <= upto:
                out.append(i)
                cut = cut or at
            at -= size[i]
        out.reverse()
        if cut:
            self.before = last[cut - 1]
            self.last = last[cut:]
        return out


class _Words(dict):
    """Pretokens with their ids, packed as little-endian unsigned 32-bit integers; bounded."""

    def __init__(self, table: MergeTable):
        super().__init__()
        self.table = table
        self.transducer = WordTransducer(table)

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if (i := self.table.usable.get(data)) is not None:  # a token that merges build encodes itself
            ids = [i]
        else:
            ids = self.transducer.feed(data) + self.transducer.finish()
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


class Encoder:
    """Whole texts or streams of chunks to token ids."""

    def __init__(self, table: MergeTable):
        self.table = table
        # The re module is faster and takes texts without characters above U+FFFF.
        self.split = re.compile(pretoken_pattern(category_ranges("L"), category_ranges("N")))
        self.split_any = regex.compile(pretoken_pattern(r"\p{L}", r"\p{N}"))
        self.high = re.compile("[^\x00-\uffff]")
        names = sorted(table.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.words = _Words(table)

    def _plain(self, text: str) -> bytes:
        split = self.split_any if self.high.search(text) else self.split
        return b"".join(map(self.words.__getitem__, split.findall(text)))

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text; added tokens in the text count as such."""
        if self.special is None or not any(s in text for s in self.table.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), struct.pack("<I", self.table.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """The ids of a text that comes in chunks, without its added tokens.

        A pretoken that ends near the end of what has come may still change and is held
        back. Of a long one, all but its last characters go to the transducer at once.
        """
        held, word = "", None
        for chunk in chunks:
            held += chunk
            done = 0
            out: list[int] = []
            for m in self.split_any.finditer(held):
                if m.end() > len(held) - 4:
                    if m.end() - m.start() > 4 * HELD_BACK:
                        word = word or WordTransducer(self.table)
                        cut = m.end() - HELD_BACK
                        out += word.feed(held[m.start() : cut].encode())
                        done = cut
                    break
                if word:
                    out += word.feed(m[0].encode()) + word.finish()
                    word = None
                else:
                    out += unpacked(self.words[m[0]]).tolist()
                done = m.end()
            held = held[done:]
            if out:
                yield out
        out = []
        for m in self.split_any.finditer(held):
            if word:
                out += word.feed(m[0].encode()) + word.finish()
                word = None
            else:
                out += unpacked(self.words[m[0]]).tolist()
        if out:
            yield out


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")


class Decoder:
    """Token ids to text, in any number of steps."""

    def __init__(self, table: MergeTable):
        self.bytes_of = table.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def decode(self, ids, block: int = 65_536) -> str:
        """A whole sequence of ids, a block at a time."""
        self.state.reset()
        return "".join([self.feed(ids[k : k + block]) for k in range(0, len(ids), block)]) + self.finish()


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer file on the driver. It has a fixed size of a few MB and is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class _Vocabulary:
    """A broadcast tokenizer file; each Python worker builds its tables once."""

    def __init__(self, spark, path: str):
        text = read_vocabulary(path)
        self.digest = hashlib.sha256(text.encode()).hexdigest()
        self.shared = spark.sparkContext.broadcast(text)


_built: dict[str, tuple[MergeTable, Encoder]] = {}


def _encoder(digest: str, shared) -> Encoder:
    if digest not in _built:
        table = MergeTable.from_json(shared.value)
        _built[digest] = (table, Encoder(table))
    return _built[digest][1]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array) of every text."""
    v = _Vocabulary(df.sparkSession, vocabulary)
    digest, shared = v.digest, v.shared

    def make():
        coder = _encoder(digest, shared)

        def step(batch):
            ids = [coder.encode(t) for t in texts(batch, text_col)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            flat = unpacked(b"".join(ids)).astype(np.int32)
            return [batch.column(id_col), n, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids array<int>", [id_col, "n_tokens", "ids"])


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of rows that hold token ids; a null list decodes to the empty text."""
    v = _Vocabulary(df.sparkSession, vocabulary)
    digest, shared = v.digest, v.shared

    def make():
        d = Decoder(_encoder(digest, shared).table)

        def step(batch):
            return [batch.column(id_col), pa.array([d.decode(x.as_py() or []) for x in batch.column(ids_col)], pa.string())]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, ids_col), make, f"`{id_col}` {kind}, decoded string", [id_col, "decoded"])


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_le, decoded): ids as little-endian unsigned 32-bit integers, and the text they decode to.

    Encoding and decoding share a task, so that a text crosses to Python once.
    """
    v = _Vocabulary(df.sparkSession, vocabulary)
    digest, shared = v.digest, v.shared

    def make():
        coder = _encoder(digest, shared)
        d = Decoder(coder.table)

        def step(batch):
            packed = [coder.encode(t) for t in texts(batch, text_col)]
            n = np.array([len(x) // 4 for x in packed], np.int64)
            return [batch.column(id_col), n, pa.array(packed, pa.binary()), pa.array([d.decode(unpacked(x).tolist()) for x in packed], pa.string())]

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens long, ids_le binary, decoded string", [id_col, "n_tokens", "ids_le", "decoded"])


def digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """The digest columns of the round trip of every document."""
    return round_trip(df, vocabulary).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def tokens(df: DataFrame, vocabulary: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of every document: its ids, and whether they decode to its text; and its columns ``also``."""
    v = _Vocabulary(df.sparkSession, vocabulary)
    digest, shared = v.digest, v.shared

    def make():
        coder = _encoder(digest, shared)
        d = Decoder(coder.table)

        def step(batch):
            n, flat, same = [], [], []
            for t in texts(batch, "text"):
                ids = unpacked(coder.encode(t))
                n.append(len(ids))
                flat.append(ids.astype(np.int32))
                same.append(d.decode(ids.tolist()) == t)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
            return [batch.column("doc_id"), pa.array(n, pa.int64()), ids, pa.array(same, pa.bool_()), *(batch.column(c) for c in also)]

        return step

    kind = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean" + "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in also)
    return map_rows(df.select("doc_id", "text", *also), make, schema, ["doc_id", "n_tokens", "ids", "lossless", *also])

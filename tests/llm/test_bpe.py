import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatpack.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def table():
    return bpe.MergeTable.from_json(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def peer():
    return Tokenizer.from_file(PATH)


TEXTS = ["", " ", "\n\n x", "don't  stop's", "a<|endoftext|> b<|endoftext|>", "the" * 3000, "a" * 4000, " " * 2500 + "x", "é日本語 naïve \x1c\x1d\x85 x", "\U0001f600 ok \U00010400", "'" * 900 + "s", "x\r\n\t y"]


def test_equals_the_library(table, peer):
    coder, decoder = bpe.Encoder(table), bpe.Decoder(table)
    rng = random.Random(3)
    random_texts = ["".join(rng.choice("abcthe  \n'sréü12*!?<|endoftext|>日") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    for text in TEXTS + random_texts:
        ids = bpe.unpacked(coder.encode(text)).tolist()
        assert ids == peer.encode(text, add_special_tokens=False).ids
        assert decoder.decode(ids) == peer.decode(ids, skip_special_tokens=False)


def test_streams_in_chunks(table, peer):
    coder = bpe.Encoder(table)
    for text in TEXTS:
        if "endoftext" in text:
            continue
        for size in (1, 5, 700):
            got = [i for part in coder.stream(text[k : k + size] for k in range(0, len(text), size)) for i in part]
            assert got == peer.encode(text, add_special_tokens=False).ids


def test_decoder_replaces_what_is_not_utf8(table, peer):
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(256) for _ in range(rng.randint(0, 12))]
        assert bpe.Decoder(table).decode(ids, block=3) == peer.decode(ids, skip_special_tokens=False)


def merged(data, merges):
    """Byte pairs merged by rank, leftmost first, one at a time."""
    parts = [bytes([b]) for b in data]
    while True:
        found = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in merges]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.binary(min_size=0, max_size=400))
def test_random_merge_lists(rng, noise):
    tokens, merges = [b"a", b"b", b"c"], []
    for _ in range(rng.randint(0, 12)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    t = bpe.MergeTable({x: i for i, x in enumerate(tokens)}, merges)
    data = bytes(b"abc"[x % 3] for x in noise)
    w, out = bpe.WordTransducer(t), []
    for k in range(0, len(data), 37):
        out += w.feed(data[k : k + 37])
        out += w._emit(max(0, len(w.last) - t.lookahead))  # emitted as soon as stable
        assert len(w.last) <= t.lookahead + t.longest
    out += w.finish()
    assert [t.bytes_of[i] for i in out] == merged(data, merges)


def test_query_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, n_tokens string")
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, PATH).collect()}
    ids = Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert rows == {(1, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(b"hello world")), (2, 0, sha(b""), sha(b""))}
    back = bpe.decode(bpe.encode(df.where("doc_id = 1"), PATH), PATH).first()
    assert back.decoded == "hello world"
    assert bpe.digests(df.limit(0), PATH).count() == 0

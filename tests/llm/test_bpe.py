import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from folioforge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    entries = bpe.read_ranks(PATH)
    return bpe.Encoder(bpe.sentencepiece_model(entries), entries, P.PATTERN)


def test_same_ids_as_the_rank_files_library(peer, encoder):
    dice = random.Random(1)
    spaces = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x180E, 0x2003, 0x2028, 0x3000, 0xFEFF]))
    alphabet = spaces + "abeEéß'sdt09²½一漢ñ🙂́\u0000▁-.,%"
    texts = ["", " ", "a", "\n\n  x", "x" * 5000, " " * 3000, "ab " * 2000, "it's I'll 'S", "🙂" * 50, "<|endoftext|>"]
    texts += ["".join(dice.choices(alphabet, k=dice.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text).tolist() == peer.encode_ordinary(text), repr(text)


def test_every_entry_alone(peer, encoder):
    for entry in bpe.read_ranks(PATH):
        if (text := entry.decode(errors="ignore")).encode() == entry:
            assert encoder.encode(text).tolist() == peer.encode_ordinary(text)


def test_query_rows(spark, peer):
    rows = [(1, "Hello  wörld\n"), (1, "Hello  wörld\n"), (2, None), (None, ""), (3, "long " * 30000)]
    docs = spark.createDataFrame([(*row, b"x", 7) for row in rows], "doc_id long, text string, token_ids binary, decoded int")
    found = sorted(map(tuple, bpe.digests(docs, PATH, P.PATTERN).collect()), key=str)

    def expected(doc_id, text):
        ids = peer.encode_ordinary(text or "")
        return doc_id, len(ids), *(hashlib.sha256(x).hexdigest() for x in (b"".join(i.to_bytes(4, "little") for i in ids), (text or "").encode()))

    assert found == sorted((expected(*row) for row in rows), key=str)
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).collect() == []
    assert bpe.encode(docs, PATH, P.PATTERN).columns == ["doc_id", "text", "decoded", "token_ids"]


def test_round_trip(spark):
    """The columns of encode, then decode, but with one Python worker a task."""
    docs = spark.createDataFrame([(1, "Hello  wörld\n", "x", 7), (2, None, "x", 8), (3, "", None, 9)], "doc_id long, text string, source string, decoded int")
    found = bpe.round_trip(docs, PATH, P.PATTERN)
    both = bpe.decode(bpe.encode(docs, PATH, P.PATTERN).drop("text"), PATH)
    assert found.columns == both.columns == ["doc_id", "source", "token_ids", "decoded"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, both.collect()))
    assert bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []

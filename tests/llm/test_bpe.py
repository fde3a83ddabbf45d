import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from storelens.llm import bpe

from .helpers import frame

RANK_FILE = P.path("byte_bpe_50k.tiktoken")
ALPHABETS = ("the ining ation ", "aeiothnrs 's've  \n\t%é中😀012-=_ABC", "ab", " \n\t\xa0\x1c x")


@pytest.fixture(scope="module")
def encoder():
    with open(RANK_FILE, "rb") as f:
        return bpe.Encoder(bpe.parse_ranks(f.read()), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    ranks = encoder.vocabulary.ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def texts(n, seed=0):
    rng = random.Random(seed)
    for _ in range(n):
        alphabet = rng.choice(ALPHABETS)
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))


def test_equals_the_library(encoder, library):
    for t in texts(3000):
        assert ids(encoder.encode(t)) == library.encode_ordinary(t), repr(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()


def test_long_pieces_and_texts(encoder, library, monkeypatch):
    for t in ("a" * 5000, "=" * 3000, " " * 4000 + "x", "word " * 2000, "<|endoftext|>" * 3):
        assert ids(encoder.encode(t)) == library.encode_ordinary(t)
    monkeypatch.setattr(bpe, "PART_CHARS", 10)
    monkeypatch.setattr(bpe, "PART_PIECES", 3)
    for t in texts(200, 5):
        assert ids(encoder.encode(t)) == library.encode_ordinary(t) and encoder.decode(encoder.encode(t)) == t.encode()


def test_prefix_table_append_and_edit(encoder):
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"thneiaro") for _ in range(600))
        table = bpe.PrefixTable(encoder.vocabulary, data)
        assert table.tokens() == encoder.vocabulary.encode_piece(data)
        start = rng.randint(0, 600)
        end, new = min(600, start + rng.randint(0, 4)), rng.choice([b"", b"th", b"q"])
        assert table.edit(start, end, new) <= 600 - start + 10
        table.append(b"ing")
        whole = bpe.PrefixTable(encoder.vocabulary, data[:start] + new + data[end:] + b"ing")
        assert table.last == whole.last and table.tokens() == whole.tokens()


def test_edits_of_a_long_piece_are_local(encoder):
    rng = random.Random(2)
    data = bytes(rng.choice(b"thneiaro") for _ in range(20000))
    assert bpe.PrefixTable(encoder.vocabulary, data).edit(50, 51, b"x") < 2000


def test_text_edits(encoder):
    rng = random.Random(3)
    for t in texts(800, 7):
        start = rng.randint(0, len(t))
        end = min(len(t), start + rng.randint(0, 5))
        new = rng.choice(["", "x", " the", "'ve", "  ", "\n", " éa"])
        edited, packed, _ = encoder.reencode(t, encoder.encode(t), start, end, new)
        assert edited == t[:start] + new + t[end:] and packed == encoder.encode(edited)


def test_documents(spark, library):
    docs = [(1, "Hello, world's end"), (2, None), (3, ""), (3, ""), (None, "null id"), (5, "é " * 300), (6, "x" * 30000)]
    got = bpe.encode_documents(frame(spark, docs), RANK_FILE, P.PATTERN).collect()
    want = []
    for i, t in docs:
        tokens = library.encode_ordinary(t or "")
        packed = np.array(tokens, "<u4").tobytes()
        want.append((i, len(tokens), tokens, hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.encode_documents(frame(spark, []), RANK_FILE, P.PATTERN).collect() == []


def test_decode_and_edit_frames(spark, encoder):
    docs = frame(spark, [(i, t) for i, t in enumerate(texts(40, 9))])
    encoded = bpe.encode_documents(docs, RANK_FILE, P.PATTERN, digests=False)
    decoded = {r.doc_id: bytes(r.decoded) for r in bpe.decode_tokens(encoded, RANK_FILE, P.PATTERN).collect()}
    assert decoded == {r.doc_id: r.text.encode() for r in docs.select("doc_id", "text").collect()}
    edits = docs.select("doc_id", "text").join(encoded, "doc_id").selectExpr(
        "doc_id", "text", "ids", "length(text) as start", "length(text) as end", "if(doc_id = 3, null, ' the end') as new"
    )
    for r in bpe.edit_documents(edits, RANK_FILE, P.PATTERN).collect():
        assert r.ids == ids(encoder.encode(r.text)) and (r.doc_id == 3 or r.text.endswith(" the end"))

import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sigwright.llm import pieces
from sigwright.llm.queries import QUERIES, tokenizer_path

ODD = ["", " ", "  ", "a", " a", "a ", "\n", "\n\n a", "▁", "▁▁a ▁", "\x00a", "日本語テキスト🙂🙂 é", "a\tb\r\n  c", " " * 50 + "x", "a" * 3000, "aAbB" * 500, "http://x.y/z?q=1&b=22  -- ==== ####", "e\u0301\ufeff\ufffd", "\u2028 \u00a0"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    with open(tokenizer_path(), "rb") as f:
        return pieces.PieceCodec(f.read())


def same(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == codec.encode_decimal(text)[1] == library.decode(ids)


def test_equals_the_library(codec, library):
    r = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "日", "🙂", "ing", "1", "22", "..", "=", "\t", "er", "tion"]
    for text in ODD + ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(3000)]:
        same(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(codec, library, text):
    same(codec, library, text)


def test_decoding_any_ids(codec, library):
    r = random.Random(2)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), r.randrange(3)]) for _ in range(r.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids)


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_ENTRIES", 3)
    with open(tokenizer_path(), "rb") as f:
        codec = pieces.PieceCodec(f.read())
    for text in ODD:
        same(codec, library, text)


def test_backtracking_finds_plain_merges(codec):
    r = random.Random(3)
    for _ in range(2000):
        chunk = "▁" + "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14)))
        assert codec.tokens(chunk) == codec.merged(chunk)


def test_documents(documents, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x y"), (99, None), (1, " ")]
    df = documents(rows, extra=True)
    got = pieces.encode_documents(df, tokenizer_path(), keep=("doc_id",), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len(library.encode(x[1] or "")))), strict=True):
        ids = library.encode(t or "")
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, library.decode(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_documents(documents([]), tokenizer_path()).count() == 0


def test_query_equals_the_library(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op10_pieces"](spark, small).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()

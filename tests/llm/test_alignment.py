import hashlib
import json
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigwright.llm import alignment
from sigwright.llm.queries import BYTE_TOKENIZER, tokenizer_path

A, B = tokenizer_path(BYTE_TOKENIZER), tokenizer_path()
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "a\n b", "a \nb", "▁", "a ▁b", "<|endoftext|> <s></s>", "\x00a b", "日本語 テキスト🙂🙂 é", "a\tb\r\n  c", " " * 50 + "x", "a" * 3000,
    "it's we'll 'tis", "é ﻿�", "    x  y 　z", "a\x1c b \x85 c", "1 22 333 4444", "the the the", "<0x41> ▀ a",
]


class Plain:
    """Whole texts, whole encodings, byte by byte."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = keep + [b for b in range(256) if b not in keep]
        self.byte = {chr(b if b in keep else 256 + names.index(b) - len(keep)): b for b in names}

    def tokens(self, text):
        """[(id, bytes)] of A and of B, or none."""
        if not text:
            return [], []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def links(self, a, b):
        spans = []
        for tokens in (a, b):
            at, out = 0, []
            for i, raw in tokens:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        return [(i, j) for i, x, y in spans[0] for j, u, v in spans[1] if x < v and u < y]

    def groups(self, a, b):
        ends = []
        for tokens in (a, b):
            at, out = 0, []
            for i, raw in tokens:
                at += len(raw)
                out.append((at, i))
            ends.append(out)
        both = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        out, since = [], 0
        for e in both:
            out.append("|".join(",".join(str(i) for at, i in x if since < at <= e) for x in ends))
            since = e
        return out

    def table(self, texts):
        found = [self.tokens(t) for t in texts]
        links = [self.links(*x) for x in found]
        counts = Counter(p for x in links for p in set(x))
        most = defaultdict(int)
        for (i, _), n in counts.items():
            most[i] = max(most[i], n)
        rows = []
        for (a, b), x in zip(found, links, strict=True):
            groups = self.groups(a, b)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
            rows.append((len(a), len(b), len(groups), len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), digest))
        return rows


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    with open(A) as f, open(B, "rb") as g:
        return alignment.Aligner(f.read(), g.read())


def same(plain, aligner, texts):
    for text, got in zip(texts, aligner.align(texts), strict=True):
        a, b = plain.tokens(text)
        groups, links = plain.groups(a, b), Counter(i * 32000 + j for i, j in plain.links(a, b))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        assert got[:4] == (len(a), len(b), len(groups), digest), text
        assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == links


def random_texts(n, seed=5):
    r = random.Random(seed)
    bits = ["a", "b", "the", " ", " ", " ", "  ", "\n", "é", "日", "🙂", "ing", "1", "22", "..", "=", "\t", "er", "tion", "'s", " ", "x" * 70]
    return ["".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(n)]


def test_chunks_align_as_whole_texts(plain, aligner):
    same(plain, aligner, ODD + random_texts(1500))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text_aligns_as_a_whole(plain, aligner, texts):
    same(plain, aligner, texts)


def test_long_texts_and_small_caches_change_nothing(plain, monkeypatch):
    monkeypatch.setattr(alignment, "PART_CHARS", 16)
    monkeypatch.setattr(alignment, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(alignment, "CACHED_CHARS", 4)
    with open(A) as f, open(B, "rb") as g:
        same(plain, alignment.Aligner(f.read(), g.read()), ODD + random_texts(300, 6))


def test_models_that_chunks_do_not_fit_are_refused():
    with open(A) as f, open(B, "rb") as g:
        spec, model = json.load(f), g.read()
    spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        alignment.Aligner(json.dumps(spec), model)


@pytest.mark.parametrize("heavy", [0, 40, alignment.HEAVY])
def test_table_equals_brute_force(spark, documents, plain, heavy):
    texts = ODD + random_texts(40, 7) + ["the common text of many rows"] * 60 + ["  <|endoftext|> repeated"] * 2
    docs = documents([(None if i == 3 else i % 50, t) for i, t in enumerate(texts)], extra=True).selectExpr("*", "'x' as n_a", "'y' as row", "'z' as pairs").repartition(5)
    got = alignment.align_documents(docs, A, B, keep=("doc_id",), heavy=heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    ids = [None if i == 3 else i % 50 for i in range(len(texts))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *r) for i, r in zip(ids, plain.table(texts), strict=True)), key=key)


def test_empty_table(spark, documents):
    assert alignment.align_documents(documents([(1, "a")]).limit(0), A, B, keep=("doc_id",)).collect() == []

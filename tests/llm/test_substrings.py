import random
import time
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from sigwright.llm import substrings
from sigwright.llm.queries import QUERIES
from sigwright.llm.shingles import flat_words

SHORT = replace(substrings.DEFAULT, least=20)


def cut(text):
    """(first, last) of the paragraphs of one text, by a rule written out plainly."""
    words = flat_words(pa.array([text]))
    begins = substrings.beginnings(words).tolist()
    return list(zip(begins, [*begins[1:], len(words.h)], strict=True))


def brute(docs, options=substrings.DEFAULT):
    """repeated_passages of {doc_id: text} by comparing everything that shares a shingle; as
    {(doc_id, first, last, n_words, passage_words, copy_of, sources)}."""
    words = {d: (t or "").encode().lower().split() for d, t in docs.items()}
    sets, holders = {}, {}
    for d, t in docs.items():
        for first, last in cut(t) if words[d] else ():
            if last - first >= options.shingle:
                sets[d, first, last] = frozenset(tuple(words[d][i : i + options.shingle]) for i in range(first, last - options.shingle + 1))
    kinds = {}
    for place, x in sets.items():
        kinds.setdefault(x, []).append(place)
    for x in kinds:
        for s in x:
            holders.setdefault(s, []).append(x)
    root = {x: x for x in kinds}

    def find(x):
        while root[x] is not x:
            x = root[x]
        return x

    linked = set()
    for near in holders.values():
        for i, x in enumerate(near):
            for y in near[:i]:
                if options.den * len(x & y) >= options.num * len(x | y):
                    linked |= {x, y}
                    root[find(x)] = find(y)
    parts = {d: set() for d in docs}
    copied = {}
    for places in kinds.values():
        kept = min(places)
        for d, first, last in places:
            if d != kept[0]:
                copied[d, first] = (last, *kept)
    ends = {(d, x[0]) for (d, _), x in copied.items()}
    clusters = {}
    for x in linked:
        clusters.setdefault(find(x), []).extend(kinds[x])
    for places in clusters.values():
        kept = min(places)[0]
        for d, first, last in places:
            if d != kept and not {(d, first), (d, last)} & copied.keys() and (d, first) not in ends:
                parts[d].add((first, last, kept, None, None))
    for (d, first), (last, kept, k_first, k_last) in copied.items():
        parts[d].add((first, last, kept, k_first, k_last))
        w, k = words[d], words[kept]
        back = 0
        if (d, first) not in ends:
            while min(first, k_first) > back and w[first - back - 1] == k[k_first - back - 1]:
                back += 1
        more = 0
        if (d, last) not in copied:
            while last + more < len(w) and k_last + more < len(k) and w[last + more] == k[k_last + more]:
                more += 1
        if back:
            parts[d].add((first - back, last, kept, k_first - back, k_last))
        if more:
            parts[d].add((first, last + more, kept, k_first, k_last + more))
    low = lambda x: tuple(-1 if y is None else y for y in x)
    out = set()
    for d, mine in parts.items():
        spans = []
        for p in sorted(mine, key=low):
            if spans and p[0] <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], p[1])
                spans[-1][2].append(p)
            else:
                spans.append([p[0], p[1], [p]])
        islands = []
        for first, last, ps in spans:
            opens, closes = min(low((p[0], p[2], p[3])) for p in ps), max(low((p[1], p[2], p[4])) for p in ps)
            if islands and first - islands[-1][-1][1] <= options.bridge:
                was = islands[-1][-1]
                if was[3][1] == opens[1] and -1 not in (was[3][2], opens[2]) and 0 <= opens[2] - was[3][2] <= options.bridge:
                    islands[-1][-1] = (was[0], last, was[2], closes, was[4] | {p[2] for p in ps})
                    continue
                islands[-1].append((first, last, opens, closes, {p[2] for p in ps}))
            else:
                islands.append([(first, last, opens, closes, {p[2] for p in ps})])
        for island in islands:
            n = sum(x[1] - x[0] for x in island)
            if n >= options.least:
                out |= {(d, x[0], x[1], x[1] - x[0], n, x[2][1], tuple(sorted(x[4]))) for x in island}
    return out


def rows_of(df):
    return {(r.doc_id, r.first, r.last, r.n_words, r.passage_words, r.copy_of, tuple(r.sources)) for r in df.collect()}


def sentences(r, n):
    return " ".join(" ".join(f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(r.randint(5, 11))).capitalize() + "." for _ in range(n))


def planted(seed, inline):
    r = random.Random(seed)
    passage = sentences(r, 9)
    rows = []
    for i in range(60):
        own = [sentences(r, r.randint(3, 8)) for _ in range(3)]
        if i % 6 == 5:
            if inline:
                own[1] = f"{own[1]} {passage}"
            else:
                own.insert(1, passage)
        rows.append((i, "\n".join(own)))
    return rows, passage


def test_planted_passages_go_but_for_the_first(documents):
    both = [planted(7, False), planted(8, True)]
    rows = [(100 * k + i, text) for k, (rows, _) in enumerate(both) for i, text in rows]
    got = substrings.repeated_passages(documents(rows, extra=True)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in rows if i % 100 % 6 == 5} - {5, 105}
    texts = dict(rows)
    for r in got:
        kept = r.doc_id // 100 * 100 + 5
        assert r.copy_of == r.sources[0] == kept and " ".join(texts[r.doc_id].split()[r.first : r.last]) == both[r.doc_id // 100][1]
    out = {r.doc_id: r.text for r in substrings.deduplicated(documents(rows, extra=True)).collect()}
    for i, text in rows:
        if i % 100 % 6 == 5 and i % 100 != 5:
            assert len(out[i].split()) == len(text.split()) - len(both[i // 100][1].split())
        else:
            assert out[i] == text


def test_near_paragraphs_are_linked_by_exact_similarity(documents):
    r = random.Random(3)
    base = [f"b{r.randrange(9999)}" for _ in range(120)]
    near, far = list(base), list(base)
    near[60] = "other"
    for at in range(0, 120, 8):
        far[at] = f"x{at}"
    got = substrings.repeated_passages(documents([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))])).collect()
    assert [(r.doc_id, r.copy_of, r.n_words) for r in got] == [(2, 1, 120)]


def test_short_repeats_and_repeats_inside_a_document_stay(documents):
    r = random.Random(4)
    header, own = "A header of only nine words stands here always.", sentences(r, 8)
    rows = [(1, f"{header}\n{sentences(r, 4)}"), (2, f"{header}\n{sentences(r, 4)}"), (3, f"{own}\n{own}")]
    assert substrings.repeated_passages(documents(rows)).count() == 0


def test_odd_rows(documents):
    r = random.Random(5)
    text, long = sentences(r, 10), sentences(r, 3000)
    rows = [(1, text), (None, text), (2, None), (3, ""), (4, " \n "), (5, "word " * 5000), (6, text), (6, text), (7, long), (8, long + " End."), (9, "é" * 5000)]
    got = substrings.repeated_passages(documents(rows)).collect()
    assert {x.doc_id for x in got} == {6, 8}
    out = substrings.deduplicated(documents(rows)).collect()
    assert sorted((x.doc_id or 0) for x in out if x.doc_id not in (6, 8)) == [0, 1, 2, 3, 4, 5, 7, 9] and not any(x.doc_id == 6 for x in out)
    assert substrings.repeated_passages(documents([])).count() == 0 and substrings.deduplicated(documents([])).count() == 0


def test_paragraphs_are_cut_alike_wherever_they_stand():
    r = random.Random(6)
    radius = substrings.DEFAULT.radius
    for _ in range(50):
        run = [f"w{r.randrange(300)}" for _ in range(60)]
        a, b = ([f"x{r.randrange(300)}" for _ in range(r.randrange(40))] for _ in "ab")
        one, two = ({x - len(before) for x, _ in cut(" ".join(before + run + behind))} for before, behind in ((a, b), (b, a)))
        inner = set(range(radius, 60 - radius - 2)) - {0}
        inner -= {x for x in inner if min(len(a), len(b)) + x < 5}
        assert one & inner == two & inner
        assert all(last - first >= 5 for first, last in cut(" ".join(a + run + b)))
    assert cut("one two three") == [(0, 3)] and cut("the " * 500) == [(0, 500)]


def test_words_are_those_of_split():
    r = random.Random(12)
    texts = ["", None, " ", "One", "\n a\tB\x0b\x0cc \r\n", "é" * 3000 + " Ünï \u2003x", *("".join(r.choice("aB \n\t\x1cé") for _ in range(r.randrange(60))) for _ in range(200))]
    for column in (pa.array(texts), pa.array(["zz zz", *texts, "y"])[1:-1]):
        words = flat_words(column)
        known = {}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            at = slice(words.first[i], words.first[i + 1])
            assert [raw[a:b] for a, b in zip(words.start[at], words.end[at], strict=True)] == raw.split()
            for w, h in zip(raw.lower().split(), words.h[at].tolist(), strict=True):
                assert known.setdefault(w, h) == h
        assert len(set(known.values())) == len(known)


def test_query_finds_what_repeats(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op4_substrings"](spark, small).collect():
        words = docs[r.doc_id].encode().lower().split()[r.first : r.last]
        kept = [docs[s].encode().lower().split() for s in r.sources]
        known = {tuple(w[i : i + 5]) for w in kept for i in range(len(w) - 4)}
        mine = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert sum(x in known for x in mine) >= 0.6 * len(mine) and r.doc_id not in r.sources


def test_passages_in_short_and_mixed_lines_go(documents):
    r = random.Random(8)

    def lines(n, widths):
        out, at = [], 0
        while n > 0:
            width = min(n, widths[at % len(widths)])
            out.append(" ".join(f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(width)))
            at, n = at + 1, n - width
        return out

    rows = []
    for k, widths in enumerate([(5,), (6,), (3,), (1, 2), (10, 4, 4)]):
        passage = lines(60, widths)
        rows += [(100 * k + i, "\n".join(lines(40, widths) + (passage if i % 4 == 1 else []) + lines(40, widths))) for i in range(12)]
    out = {x.doc_id: x.text for x in substrings.deduplicated(documents(rows)).collect()}
    for i, text in rows:
        if i % 100 in (5, 9):
            assert len(out[i].split()) == len(text.split()) - 60
        else:
            assert out[i] == text


def test_all_words_of_a_passage_go_wherever_it_stands(documents):
    r = random.Random(9)
    rows, passages = [], []
    for k, kind in enumerate(["middle", "no punctuation", "other ends", "one word a line"]):
        prose = sentences(r, 90).split()
        if kind == "no punctuation":
            prose = [w.strip(".").lower() for w in prose]
        if kind == "other ends":
            prose = [w.replace(".", r.choice(["。", '."', ".)", ":", ";"])) for w in prose]
        passage, own = prose[3:58], prose[58:]
        passages.append(passage)
        for i in range(12):
            mine = [f"{w[:-1]}{i}{w[-1]}" for w in own[7 * i : 7 * i + 150]]
            mine[61:61] = passage if i % 4 == 1 else []
            rows.append((100 * k + i, ("\n" if kind == "one word a line" and i == 5 else " ").join(mine)))
    got = {x.doc_id: x for x in substrings.repeated_passages(documents(rows)).collect()}
    assert set(got) == {100 * k + i for k in range(4) for i in (5, 9)}
    for i, x in got.items():
        assert x.n_words == 55 and x.copy_of == i // 100 * 100 + 1 and dict(rows)[i].split()[x.first : x.last] == passages[i // 100]


def test_pairs_at_the_threshold_share_a_band():
    r = np.random.default_rng(11)
    for size in [*range(4, 60), 200, 1000]:
        for _ in range(20):
            both = -(-4 * size // 5)
            other = int(r.integers(both, 5 * both // 4 + 1))
            x = r.choice(1 << 40, size, replace=False)
            y = np.append(r.choice(x, both, replace=False), r.integers(1 << 40, 1 << 41, other - both))
            if 5 * both >= 4 * (size + other - both):
                a, b = (set(np.sort(z)[: substrings.n_bands(np.array([len(z)]))[0]].tolist()) for z in (x, y))
                assert a & b
    assert substrings.n_bands(np.arange(9)).tolist() == [0, 0, 0, 0, 1, 2, 2, 2, 2]


def test_short_passages_are_found_where_asked_for(documents):
    r = random.Random(14)
    run = sentences(r, 4).split()[:25]
    rows = [(i, " ".join([*sentences(r, 3).split(), *run, *sentences(r, 3).split()])) for i in range(3)]
    got = rows_of(substrings.repeated_passages(documents(rows), options=SHORT))
    assert got == brute(dict(rows), SHORT) and {(d, n) for d, _, _, n, *_ in got} == {(1, 25), (2, 25)}


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(documents, seed):
    r = random.Random(20 + seed)
    texts = []
    for i in range(40):
        words = sentences(r, r.choice([0, 1, 6, 20])).split()
        for _ in range(r.randrange(3) if texts else 0):
            source = r.choice(texts).split()
            at = r.randrange(len(source) + 1)
            piece = source[at : at + r.choice([10, 30, 60, 200])]
            for _ in range(r.choice([0, 0, 1, 3])):
                if piece:
                    piece[r.randrange(len(piece)) :][:1] = [r.choice(["new", "é", piece[0]])]
                    piece[r.randrange(len(piece))] = r.choice(["new", "ünï", piece[0]])
            at = r.randrange(len(words) + 1)
            words[at:at] = piece
        texts.append(r.choice([" ", "\n", " \n\t"]).join(words))
    rows = list(enumerate(texts))
    options = (substrings.DEFAULT, replace(SHORT, least=1, bridge=2))[seed]
    assert rows_of(substrings.repeated_passages(documents(rows, extra=True).repartition(3), options=options)) == brute(dict(rows), options)


def test_query_equals_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert rows_of(QUERIES["op4_substrings"](spark, small)) == brute(docs) != set()


def test_rows_that_share_an_id_keep_their_own_texts(documents):
    r = random.Random(13)
    passage, other = sentences(r, 12).replace("a", "é"), "ü " + sentences(r, 30)
    rows = [(1, f"{sentences(r, 4)} {passage}"), (6, f"{passage} {sentences(r, 3)}"), (6, other), (6, f"{passage} {passage}")]
    out = [x.text for x in substrings.deduplicated(documents(rows)).collect() if x.doc_id == 6]
    assert sorted(out) == sorted([rows[1][1][len(passage) + 1 :], other])


def test_families_of_lines_without_links_cost_no_squares(documents, spark):
    def seconds(n):
        lines = [f"Order {i} of {i * 7 % 9973} was sent to the customer {i * 31 % 99991} at the address that we have of {i * 17 % 9999991} in our books" for i in range(n)]
        docs = documents([(i, line) for i, line in enumerate(lines)]).repartition(4).cache()
        docs.count()
        began = time.time()
        assert substrings.repeated_passages(docs).count() == 0
        return time.time() - began

    few, many = seconds(500), seconds(8000)
    assert many < few + 15, (few, many)


def test_columns_of_any_name_stay(spark, documents):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, f"first {passage}"), (2, f"second one {passage} end")]).selectExpr("*", "1 AS __id", "2 AS __hash", "3 AS __spans", "4 AS _id", "5 AS text_hash")
    got = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert got[1].text == f"first {passage}" and got[2].text.split() == ["second", "one", "end"]
    assert all((r["__id"], r["__hash"], r["__spans"], r["_id"], r.text_hash) == (1, 2, 3, 4, 5) for r in got.values())


def test_long_words_of_few_letters_have_hashes_of_their_own():
    words = ["a"]
    for n in range(1, 14):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
        words += [a, a.translate(str.maketrans("ab", "ba")), a[::-1] + "b", "b" * (1 << n)]
    words = sorted(set(words))
    assert len(set(substrings.flat_words(pa.array([" ".join(words)])).h.tolist())) == len(words)


def test_one_huge_word(spark, documents):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, "x" * 3_000_000 + " " + passage), (2, "y" * 3_000_000 + " " + passage)])
    assert [(r.doc_id, r["first"], r["last"]) for r in substrings.repeated_passages(docs).collect()] == [(2, 1, 61)]

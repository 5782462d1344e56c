import math
import random
import zlib
from collections import Counter, defaultdict

import regex

from sigwright.llm import language
from sigwright.llm.queries import QUERIES
from sigwright.runtime import table

SYLLABLES = {"aa": ["ra", "mo", "li", "ten"], "bb": ["schu", "ver", "gen", "ü"], "cc": ["eau", "ç", "oi", "que"]}


def corpus(n=300, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        rows.append((i, " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 5))) for _ in range(r.randint(1, 40))).title() + " 12, x!", lang))
    return rows


def with_langs(spark, rows):
    return spark.createDataFrame([(i, t, la, "s", "x", "y", 1) for i, t, la in rows], "doc_id long, text string, lang string, source string, lang_pred string, score string, held_out int")


def plain(rows):
    """The method with dictionaries, over all rows outside the fold and with every entry."""
    tables = [defaultdict(Counter) for _ in range(6)]
    docs = Counter()
    split = lambda t: regex.findall(r"\p{L}[\p{L}\p{M}]*", (t or "").lower())
    grams = lambda w, n: [w] if n == 0 else [x[i : i + n] for x in [f" {w} " if n > 1 else w] for i in range(len(x) - n + 1)]
    for i, text, lang in rows:
        if i is None or text is None or lang is None or zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        docs[lang] += 1
        for w in split(text):
            for n in range(6):
                tables[n][lang].update(grams(w, n))
    langs = sorted(docs)

    def word(w):
        for n in (0, 5, 4, 3, 2, 1):
            known = [g for g in grams(w, n) if any(g in tables[n][x] for x in langs)]
            if known:
                cost = lambda g, x: -math.log10(tables[n][x][g] / tables[n][x].total()) if g in tables[n][x] else 7.0  # noqa: B023, E731
                return [sum(cost(g, x) for g in known) / len(known) for x in langs]
        return [7.0] * len(langs)

    def predict(text):
        found = split(text)
        if not found or not langs:
            return "und", 0.0
        costs = [sum(x) / len(found) for x in zip(*map(word, found), strict=True)]
        best = min(range(len(langs)), key=lambda k: (round(costs[k], 9), -docs[langs[k]], langs[k]))
        share = [10 ** -(c - costs[best]) for c in costs]
        return langs[best], share[best] / sum(share)

    return predict


def test_equals_plain_dictionaries(spark):
    rows = corpus()
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !? ́́", "aa"), (None, "ramo", "aa"), (1003, "verschu eau", None), (1004, "日本語 жизнь", None), (1005, "ramo " * 5000, None), (1005, "ramo " * 5000, None)]
    want = plain(rows)
    got = language.judge_documents(with_langs(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in got:
        lang, score = want(texts[r.doc_id])
        assert (r.lang_pred, r.held_out) == (lang, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert math.isclose(r.score, score, abs_tol=1e-5)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert by_id[1003].lang_pred != "und"


def test_nothing_to_learn_from(spark):
    rows = [(2, "some words", None), (3, "more", None)]
    assert [(r.lang_pred, r.score) for r in language.judge_documents(with_langs(spark, rows)).collect()] == [("und", 0.0)] * 2
    assert language.judge_documents(with_langs(spark, rows).limit(0)).collect() == []


def test_words_back_off_to_shorter_and_shorter_n_grams(spark):
    rows = [(i, "ramoli", "aa") for i in range(9)] + [(i, "vergen", "bb") for i in range(9, 18)]
    model = language.fit(with_langs(spark, rows))
    unseen = ["xxamolixx", "xxverxx", "xrxax", "ggg", "жжж"]
    costs = model.costs(unseen)
    assert costs[0, 0] < costs[0, 1] == 7 * language.PARTS
    assert costs[1, 1] < costs[1, 0]
    assert list(costs[4]) == [7 * language.PARTS] * 2


def test_sample_is_shared_out_among_languages(spark):
    rows = [(i, f"w{i}", "aa") for i in range(3000)] + [(i, f"w{i}", "bb") for i in range(3000, 3030)]
    drawn, counts = language.sample(with_langs(spark, rows), rows=200)
    taken = Counter(r.lang for r in drawn.collect())
    learnable = [i for i in range(3000, 3030) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert taken == {"aa": 100, "bb": len(learnable)} and counts["bb"] == len(learnable)


def test_small_caches_change_nothing(spark, monkeypatch):
    rows = corpus(60)
    model = language.fit(with_langs(spark, rows))
    texts = [t for _, t, _ in rows]
    whole = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "CACHE_NUMBERS", 1)
    one = language.Scorer(model)
    assert [one.predict([t])[0] for t in reversed(texts)][::-1] == whole


def test_held_out_languages_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = QUERIES["op11_language"](spark, sf_dir).join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)

import math
import random
import zlib

import pytest

from sigwright.llm import labelled, quality, toxicity
from sigwright.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ra", "mo", "li", "ten", "kur") for b in ("san", "dor", "vel", "pit")]
    rows, labels = [], []
    for i in range(n):
        toxic, bad = r.random() < 0.2, r.random() < 0.3
        text = [r.choice(words) for _ in range(r.randint(5, 150))]
        for _ in range(2 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["grobnik", "zwelp"]))
        rows.append((i, " ".join(f"{w.upper()}!!" for w in text) if bad else " ".join(text) + "."))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_toxic_texts_are_found_in_the_held_out_fold(spark, documents):
    rows, labels = corpus()
    got = toxicity.judge_documents(documents(rows, extra=True), spark.createDataFrame(labels, LABELS).selectExpr("*", "'x' text", "'y' label")).collect()
    truth = {i: t for i, _, t in labels}
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_scores_equal_plain_dictionaries(spark, documents):
    rows, labels = corpus(200)
    rows += [(900, ""), (901, None), (902, "Grobnik ZWELP é\U0001f600 " * 50)]
    known = spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(documents(rows), known, features=500)
    assert 0 < len(model.ratio) - 1 <= 500
    chosen = {b: (float(model.ratio[i]), float(model.weight[i])) for b, i in enumerate(model.slot.tolist()) if i}

    def score(text):
        chars = [ord(c) for c in f" {(text or '').lower()} "]
        mine = set()
        for n in (4, 5, 6):
            for at in range(len(chars) - n + 1):
                h = 0x9E3779B97F4A7C15
                for c in chars[at : at + n]:
                    h = (h ^ c) * 0x100000001B3D4E5F % (1 << 64)
                mine.add((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64) >> (64 - toxicity.BITS))
        mine &= chosen.keys()
        length = max(1.0, math.sqrt(sum(chosen[b][0] ** 2 for b in mine)))
        return 1 / (1 + math.exp(-(model.bias + sum(chosen[b][0] * chosen[b][1] for b in mine) / length)))

    got = {r.doc_id: r.score for r in toxicity.score_documents(documents(rows), model, keep=("doc_id",)).collect()}
    assert got == pytest.approx({i: score(t) for i, t in rows})


def test_posteriors_of_sparse_sites_by_hand(spark, documents, monkeypatch):
    """Two pseudo-documents, as _prior_rows has at least: sites of one and two documents, by the written formulas."""
    monkeypatch.setattr(quality, "_prior_rows", lambda groups, mean: 2.0)
    rows, labels = corpus(60)
    sited = [(i, t, "large") for i, t in rows] + [(900, "ra", "one"), (901, "ra mo", "two"), (902, "RA!! MO!!", "two")]
    got = {r.doc_id: r for r in quality.judge(documents(sited), spark.createDataFrame(labels, LABELS)).collect()}
    p = {i: r.evidence for i, r in got.items()}
    mean = (sum(p.values()) + 0.5) / (len(p) + 1)
    assert got[900].host_posterior == pytest.approx(mean) and got[900].path_posterior == pytest.approx(mean)
    for i, other in ((901, 902), (902, 901)):
        host = (2 * mean + p[other]) / 3
        path = (2 * host + p[other]) / 3
        assert (got[i].host_posterior, got[i].path_posterior) == pytest.approx((host, path))
        logit = lambda x: math.log(x / (1 - x))
        clipped = min(1 - 1e-6, max(1e-6, p[i]))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(logit(clipped) + logit(path) - logit(mean)))))


def test_held_out_labels_change_nothing(spark, documents):
    rows, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (toxicity.judge_documents(documents(rows).repartition(3 + k), spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for k, x in enumerate((labels, flipped)))
    assert a == b


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (None, "zwelp"), (3, "x"), (3, "x"), (4, "\n"), (5, "word " * 20000)]
    for labels in ([], [(3, 1, 1)], [(3, 1, 1), (1, 0, 0), (3, 1, 0), (None, 1, 1), (2, None, None), (4, 0, 0)]):
        known = spark.createDataFrame(labels, LABELS)
        got = toxicity.judge_documents(documents(rows), known).collect()
        assert len(got) == len(rows) and all(r.score is not None for r in got)
        kept = quality.judge(documents(rows), known).collect()
        assert len(kept) == len(rows) and all(r.keep is not None and 0 <= r.score <= 1 for r in kept)
    assert toxicity.judge_documents(documents([]), known).count() == 0 and quality.judge(documents([]), known).count() == 0


def test_samples_are_bounded_and_count_an_id_once(spark, documents):
    rows, labels = corpus(200)
    got = labelled.sample(documents(rows + rows), spark.createDataFrame(labels + labels, LABELS), "toxic", rows=50)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == 50 and not any(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


def test_quality_of_the_held_out_fold(spark, documents):
    rows, labels = corpus()
    got = quality.judge(documents(rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.keep == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_sites_shrink_toward_their_priors(spark, documents):
    rows, labels = corpus(400)
    sited = [(i, t, "bad" if not labels[i][1] else "good") for i, t in rows] + [(9000, "radan. rasan mosan.", "new"), (9001, "rasan ravel.", None)]
    got = {r.doc_id: r for r in quality.judge(documents(sited), spark.createDataFrame(labels, LABELS)).collect()}
    good = next(r for i, r in got.items() if i < 400 and labels[i][1])
    bad = next(r for i, r in got.items() if i < 400 and not labels[i][1])
    assert bad.host_posterior < got[9000].host_posterior < good.host_posterior
    assert abs(got[9000].host_posterior - got[9001].host_posterior) < 1e-9
    assert abs(got[9000].path_posterior - got[9000].host_posterior) < 1e-9


def test_driver_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    toxic = [r for r in QUERIES["op9_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id].toxic for r in toxic) >= 0.9 * len(toxic)
    kept = [r for r in QUERIES["op3_quality"](spark, folder).collect() if r.doc_id in labels]
    assert sum(r.keep == labels[r.doc_id].quality for r in kept) >= 0.98 * len(kept)


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.2, 0.5])
def test_priors_are_fitted_by_moments(spark, spread):
    """Groups around a mean: pseudo-documents by the written formula, over plain numbers."""
    r = random.Random(int(spread * 100))
    groups = []
    for _ in range(200):
        centre = min(0.98, max(0.02, 0.6 + spread * r.uniform(-1, 1)))
        groups.append([min(1.0, max(0.0, centre + r.uniform(-0.02, 0.02))) for _ in range(r.choice([1, 2, 3, 50]))])
    unit = quality.UNIT
    rows = [(len(g), sum(round(p * unit) for p in g), sum(round(round(p * unit) ** 2 / unit) for p in g)) for g in groups]
    mean = sum(map(sum, groups)) / sum(map(len, groups))
    total = weight = 0.0
    for g in groups:
        if len(g) > 1:
            m = sum(g) / len(g)
            noise = max(0.0, sum(p * p for p in g) / len(g) - m * m) / len(g)
            total += len(g) * ((m - mean) ** 2 - noise)
            weight += len(g)
    want = quality.MOST_PRIOR if total <= 0 else min(quality.MOST_PRIOR, max(quality.LEAST_PRIOR, mean * (1 - mean) / (total / weight) - 1))
    got = quality._prior_rows(spark.createDataFrame(rows, "n long, s long, q long"), mean)
    assert got == pytest.approx(want, rel=1e-3)


def test_posteriors_equal_a_loop(spark, documents):
    """All documents of many sites, sparse ones among them, with the fitted priors: the hierarchy over plain numbers, given the
    evidence."""
    rows, labels = corpus(300)
    r = random.Random(5)
    sited = [(i, t, r.choice(["a", "b", f"s{i % 40}", None])) for i, t in rows]
    got = {x.doc_id: x for x in quality.judge(documents(sited), spark.createDataFrame(labels, LABELS), path=quality.F.substring("text", 1, 1)).collect()}
    p = {i: x.evidence for i, x in got.items()}
    host = {i: s for i, _, s in sited}
    path = {i: (s, t[:1]) for i, t, s in sited}
    mean = (sum(p.values()) + 0.5) / (len(p) + 1)

    def pseudo(site):
        groups = {}
        for i, s in site.items():
            groups.setdefault(s, []).append(p[i])
        total = weight = 0.0
        for g in groups.values():
            if len(g) > 1:
                m = sum(g) / len(g)
                total += len(g) * ((m - mean) ** 2 - max(0.0, sum(x * x for x in g) / len(g) - m * m) / len(g))
                weight += len(g)
        return quality.MOST_PRIOR if total <= 0 else min(quality.MOST_PRIOR, max(quality.LEAST_PRIOR, mean * (1 - mean) / (total / weight) - 1))

    of_host, of_path = pseudo(host), pseudo(path)
    logit = lambda x: math.log(min(1 - 1e-6, max(1e-6, x)) / (1 - min(1 - 1e-6, max(1e-6, x))))
    for i in p:
        same = [p[j] for j in p if j != i and host[j] == host[i]]
        above = (of_host * mean + sum(same)) / (of_host + len(same))
        near = [p[j] for j in p if j != i and path[j] == path[i]]
        site = (of_path * above + sum(near)) / (of_path + len(near))
        score = 1 / (1 + math.exp(-(logit(p[i]) + logit(site) - math.log(mean / (1 - mean)))))
        assert (got[i].host_posterior, got[i].path_posterior) == pytest.approx((above, site), rel=2e-3)
        assert got[i].score == pytest.approx(score, abs=5e-3)

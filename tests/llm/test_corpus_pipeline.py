import os
from collections import Counter
from pathlib import Path

import sentencepiece

import corpus_pipeline
from sigwright.llm import mixing, neardup, substrings, toxicity
from sigwright.llm.queries import tokenizer_path
from sigwright.runtime import shared_dir, table


def test_stages_are_the_operators(spark, small):
    docs = table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "pieces"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = docs.collect()

    clean = stages[0](spark, docs, small).cache()
    bad = {r.doc_id for r in toxicity.judge_documents(docs, table(spark, small, "labels")).collect() if r.predicted}
    assert sorted(map(tuple, clean.collect())) == sorted(tuple(r) for r in rows if r.doc_id not in bad)

    single = stages[1](spark, clean, small).cache()
    kept = {r.doc_id for r in neardup.near_duplicates(clean).collect() if r.kept}
    assert {r.doc_id for r in single.collect()} == kept and single.columns == docs.columns

    cut = stages[2](spark, single, small).cache()
    touched = {r.doc_id for r in substrings.repeated_passages(single).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert (r.text == before[r.doc_id]) == (r.doc_id not in touched) and r.n_chars == len(r.text)
    assert {r.doc_id for r in cut.collect()} >= set(before) - touched

    mixed = stages[3](spark, cut, small).cache()
    want = {r.doc_id: r.taken for r in mixing.mix(cut).collect() if r.taken}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.encode().split())
    assert dict(got) == want

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    ids = Counter(tuple(library.encode(r.text)) for r in mixed.collect())
    assert Counter(tuple(r.ids) for r in stages[4](spark, mixed, small).collect()) == ids


def test_run_gives_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "ids", "decoded"]


def test_stages_leave_only_what_their_result_reads(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (2, text), (3, text + " and some more"), (4, "here stands " + text), (5, "nothing of that")])
    folder = Path(shared_dir(spark))
    for stage, left in ((1, "near-marks"), (2, "spans")):
        before = set(os.listdir(folder)) if folder.exists() else set()
        got = corpus_pipeline.STAGES[stage][1](spark, docs, "")
        assert [x.rsplit("-", 2)[0] for x in set(os.listdir(folder)) - before] == [left]
        ids = [r.doc_id for r in got.orderBy("doc_id").collect()]
        assert ids == ([1, 5] if stage == 1 else [1, 3, 4, 5])


def test_descriptions_of_plans_are_bounded_in_a_stage_only(spark):
    import corpus_pipeline

    name = "spark.sql.maxPlanStringLength"
    before, seen = spark.conf.get(name), []
    corpus_pipeline.lean(lambda session, docs, _: seen.append(session.conf.get(name)) or docs)(spark, spark.range(1), "")
    assert seen == [str(corpus_pipeline.PLAN_TEXT)] and spark.conf.get(name) == before


def test_batches_for_python_are_bounded_in_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["n", "rows"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 500000) AS text")
    try:
        got = corpus_pipeline.lean(lambda session, docs, _: docs.mapInArrow(sizes, "n long, rows long"))(spark, rows, "").collect()
        assert sum(r.rows for r in got) == 40 and max(r.n for r in got) <= corpus_pipeline.BATCH_BYTES + 1_000_000
        spark.conf.set(name, "12345678")
        corpus_pipeline.lean(lambda session, docs, _: docs)(spark, rows, "")
        assert spark.conf.get(name) == "12345678"
    finally:
        spark.conf.unset(name)


def test_workers_that_cut_passages_give_memory_back(spark, documents, monkeypatch, tmp_path):
    log = str(tmp_path / "released")

    def released():
        with open(log, "a") as f:
            f.write("x")

    monkeypatch.setattr(substrings, "release_memory", released)
    text = " ".join(f"w{i}" for i in range(60))
    got = substrings.deduplicated(documents([(1, text), (2, "here stands " + text)]))
    open(log, "w").close()  # so far others did
    assert got.count() == 2 and os.path.getsize(log)

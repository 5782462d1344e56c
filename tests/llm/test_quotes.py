import re

from sigwright.llm import quotes
from sigwright.llm.queries import ORACLES, QUERIES

from oracle import same_rows

KIND = "conv_id long, turn long, role string, text string"
THREAD = [
    (1, 0, "user", "Shall we meet on Monday at the office?\nThanks"),
    (1, 1, "assistant", "> Shall we meet on  MONDAY at the office?\nYes, at noon then."),
    (1, 2, "user", "Anna wrote:\n>> Shall we meet on Monday at the office?\n> Yes, at noon then.\n\nNoon is fine.\n> Thanks"),
    (1, 3, "user", "A new matter without quotes."),
    (1, 4, "assistant", "> Noon is fine.\n\nSee you."),
    (1, 5, "user", ">> Yes, at noon then.\nonly deeper"),
    (1, 6, "user", "> A new matter without quotes.\n> nothing anyone said\n reply"),
    (2, 0, "user", "> Shall we meet on Monday at the office?\nfrom elsewhere"),
]


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, KIND)
    if extra:
        df = df.selectExpr("*", "'x' line", "'y' root_turn", "'z' lines", "'r' range", "'p' position")
    return {(r.conv_id, r.turn): r for r in quotes.link_quotes(df.repartition(3)).collect()}


def test_threads(spark):
    got = run(spark, THREAD, extra=True)
    assert {k: r.parent_turn for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): None, (1, 4): 2, (1, 5): 1, (1, 6): 3, (2, 0): None}
    assert {k: (r.root_turn, r.depth) for k, r in got.items()} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 2), (1, 3): (3, 0), (1, 4): (0, 3), (1, 5): (0, 2), (1, 6): (3, 1), (2, 0): (0, 0)}
    order = [k[1] for k, _ in sorted(((k, r.position) for k, r in got.items() if k[0] == 1), key=lambda x: x[1])]
    assert order == [0, 1, 2, 4, 5, 3, 6]
    assert got[1, 2].text == "Noon is fine." and got[1, 2].n_quoted == 3
    assert not any(re.search("^>", r.text) for r in got.values())


def test_equals_sql_on_quotes(spark, tmp_path):
    df = spark.createDataFrame(THREAD, KIND)
    df.coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    same_rows(quotes.link_quotes(df), ORACLES["op2_quotes"], str(tmp_path))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, None, "> hi\nx"), (3, None, "user", None), (3, 0, "user", ""), (3, 1, "user", "> \n>\n"), (3, 1, "user", "> \n>\n"), (3, 2, "a", "> " * 5000 + "deep"), (4, 0, "u", "line\n" * 5000), (4, 1, "u", "> line\nok"), (4, 1, "u", "> line\nok")]
    got = list(quotes.link_quotes(spark.createDataFrame(rows, KIND)).collect())
    assert len(got) == len(rows)
    for conv in (None, 3, 4):
        own = sorted(r.position for r in got if r.conv_id == conv)
        assert own == list(range(1, len(own) + 1))
    assert all(r.parent_turn == (0 if (r.conv_id, r.turn) == (4, 1) else None) for r in got)
    assert quotes.link_quotes(spark.createDataFrame([], KIND)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "line 0")] + [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(1, 40)]
    got = run(spark, rows)
    assert all(r.root_turn == 0 and r.depth == k[1] == r.position - 1 for k, r in got.items())


def test_query_equals_sql_and_is_native(spark, small):
    df = QUERIES["op2_quotes"](spark, small)
    assert not re.search("Python|Arrow|Pandas|RDDScan", df._jdf.queryExecution().toString())
    same_rows(df, ORACLES["op2_quotes"], small)


WRAPPED = [
    (1, 0, "user", "The first sentence is rather long and goes on. A second one follows it, does it not?\nAnd a third stands on a line of its own."),
    (1, 1, "user", "Something else entirely. It has nothing to do with the rest."),
    (1, 2, "assistant", "Bob wrote:\n> The first sentence is rather\n> long and goes on. A second one\n> follows it, does it not?\nYes it does."),
    (1, 3, "user", "> A second one follows it, does it not? And a\n> third stands on a line of its own.\nGood."),
    (1, 4, "user", f"{'x' * 400} wrote:\n> It has nothing to do\n> with the rest.\nTrue."),
    (1, 5, "assistant", "> It has nothing\n\n> to do with the rest.\nnot one passage"),
    (1, 6, "assistant", ">> Yes it\n>> does.\n> Good.\nfine"),
]


def test_wrapped_quotes_are_found_by_their_sentences(spark, tmp_path):
    got = run(spark, WRAPPED)
    assert {t: got[1, t].parent_turn for t in range(7)} == {0: None, 1: None, 2: 0, 3: 0, 4: 1, 5: None, 6: 3}
    assert got[1, 2].text == "Yes it does." and got[1, 4].text == "True."
    df = spark.createDataFrame(WRAPPED, KIND)
    df.coalesce(1).toPandas().to_parquet(tmp_path / "conversations.parquet")
    same_rows(quotes.link_quotes(df), ORACLES["op2_quotes"], str(tmp_path))

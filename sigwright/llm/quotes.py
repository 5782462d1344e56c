"""Quotation linking for conversations (operator 2), with DataFrame functions only.

Lines of a message carry as many quote levels as ``>`` marks stand before them. Neighbouring lines of one level are a
passage, however a mail client has wrapped it; passages are cut at sentences, normalised and hashed, and joined
to the first message of the conversation that says them itself. Where no sentence is found, whole lines are
looked for. The message that most of the least nested quotes come from is the parent. Following parents gives the
thread, and messages are numbered thread by thread, without their quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.runtime import Cut, shuffle_partitions

#: Quote marks at the start of a line. One class of characters: groups would recurse on very many marks.
MARKS = "^[ \\t>]*>"
#: A line before a quotation that names its author, in the languages of the corpus.
ATTRIBUTION = "(?i)^.*(?:wrote|writes|schrieb|a écrit|escribió)[ \\t]*:[ \\t]*$"


def quote_lines(text: Column) -> Column:
    """array<struct<level int, body string>> of the lines of a text; null has none."""
    lines = F.coalesce(F.split(text, "\\r?\\n"), F.array().cast("array<string>"))
    return F.transform(
        lines,
        lambda x: F.struct(
            F.char_length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS + "[ \\t]?", "").alias("body"),
        ),
    )


def normalised(body: Column) -> Column:
    """Lower case, runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(body), "[ \\t\\x0B\\f]+", " "))


def own_lines(lines: Column) -> Column:
    """The lines that are no quotes and do not name the author of the quotation below them."""
    names = lambda x, i: (x["body"].rlike(ATTRIBUTION)) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    return F.filter(lines, lambda x, i: (x["level"] == 0) & ~names(x, i))


def marked_lines(lines: Column) -> Column:
    """array<struct<level, own, line, opens>>: normalised lines, and whether a passage opens with them. A passage ends at an
    empty line, at another level and at a line that names an author."""
    own = lambda i: (F.get(lines, i)["level"] == 0) & ~(F.get(lines, i)["body"].rlike(ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0))
    each = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), own(i).alias("own"), normalised(x["body"]).alias("line")))

    def opens(x: Column, i: Column) -> Column:
        before = F.get(each, i - 1)
        return (i == 0) | (before["level"] != x["level"]) | (before["own"] != x["own"]) | (before["line"] == "") | (x["line"] == "")

    return F.transform(each, lambda x, i: F.struct(x["level"].alias("level"), x["own"].alias("own"), x["line"].alias("line"), opens(x, i).alias("opens")))


def quoted_units(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, own, kind, h, n) of what messages (message, conv_id, turn, lines) say or quote: sentences of
    passages (kind 0) and lines (kind 1), with hash and length."""
    each = rows.select("message", "conv_id", "turn", F.posexplode(marked_lines(F.col("lines"))).alias("i", "x")).select("message", "conv_id", "turn", "i", "x.*").filter("level > 0 OR own")
    runs = each.withColumn("run", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("message").orderBy("i"))).filter("line <> ''")
    passage = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda p: p["line"]), " ")
    passages = runs.groupBy("message", "conv_id", "turn", "level", "own", "run").agg(passage.alias("passage"))
    sentences = F.explode(F.split(F.regexp_replace("passage", "([.!?]) ", "$1\n"), "\n"))
    units = passages.select("conv_id", "turn", "level", "own", F.lit(0).alias("kind"), sentences.alias("unit")).unionByName(each.select("conv_id", "turn", "level", "own", F.lit(1).alias("kind"), F.col("line").alias("unit")))
    return units.filter("unit <> ''").select("conv_id", "turn", "level", "own", "kind", F.xxhash64("unit").alias("h"), F.char_length("unit").alias("n"))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted (quoted lines), parent_turn, root_turn, depth and position
    of every row of messages.

    parent_turn is the message that a message quotes: each quoted sentence belongs to the first earlier message of
    the conversation that has it among its own, and so does each quoted line. Of the least quote level with such
    sentences or lines the message with most quoted characters wins, by sentences if any is found and else by lines, then
    the later one. It is null where nothing quoted is found, as for messages
    without quotes; those begin threads of their own, with depth 0. position, from 1, orders a conversation by
    thread (root_turn), then turn: replies follow what they reply to.

    Rows with one conversation and turn are one message in links and keep a position each, by role and text.
    Rows with a null conversation or turn are linked with nothing; they are numbered in a conversation of
    their own and before all turns. A null text is empty. Empty tables give no row.

    No message list of a conversation is gathered: links are joins on (conversation, line), parents are
    followed by doubling, and positions are prefix sums over ranges that a sampled sort has cut.
    """
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), quote_lines(F.col(text)).alias("lines"))
    rows = Cut(rows.withColumn("message", F.monotonically_increasing_id()), "quote-lines").df
    named = rows.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    asked = named.filter(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id").distinct()
    units = Cut(quoted_units(named.join(asked, "conv_id", "left_semi")), "quote-units").df
    first = units.filter("own").groupBy("conv_id", "kind", "h").agg(F.min("turn").alias("origin"))
    quoted = units.filter("level > 0").drop("own")
    votes = quoted.join(first, ["conv_id", "kind", "h"]).filter("origin < turn").groupBy("conv_id", "turn", "level", "kind", "origin").agg(F.sum("n").alias("n"))
    best = F.min(F.struct("level", "kind", (-F.col("n")).alias("n"), (-F.col("origin")).alias("o")))
    parents = Cut(votes.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", (-F.col("b.o")).alias("parent_turn")), "quote-parents").df
    up = parents.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("long").alias("depth"))
    while True:
        above = up.select(F.col("conv_id"), F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        joined = up.join(above, ["conv_id", "root_turn"], "left")
        joined = joined.select("conv_id", "turn", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("went"))
        step = Cut(joined, "quote-roots").df
        up = step.drop("went")
        if not step.filter("went").limit(1).count():
            break
    known = parents.join(up, ["conv_id", "turn"])
    body = F.regexp_replace(F.array_join(F.transform(own_lines(F.col("lines")), lambda x: x["body"]), "\n"), "^\\s+|\\s+$", "")
    slim = rows.select("conv_id", "turn", "role", body.alias("text"), F.size(F.filter("lines", lambda x: x["level"] > 0)).alias("n_quoted"))
    full = slim.join(known, ["conv_id", "turn"], "left").withColumns({"root_turn": F.coalesce("root_turn", "turn"), "depth": F.coalesce("depth", F.lit(0).cast("long"))})
    return _numbered(full, ["conv_id"], ["root_turn", "turn", "role", "text"])


def _numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with position, from 1, within group by order; a group may hold any share of all rows."""
    n = shuffle_partitions(rows.sparkSession)
    ranged = Cut(rows.repartitionByRange(n, *group, *order).withColumn("range", F.spark_partition_id()), "ranges").df
    counts = ranged.groupBy(*group, "range").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy(*group).orderBy("range")) - F.col("here")
    counts = counts.select(*(F.col(g).alias(f"__{g}") for g in group), F.col("range").alias("__range"), before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*group, "range").orderBy(*order))
    same = F.col("range") == F.col("__range")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    numbered = ranged.withColumn("inside", inside).join(counts, same)
    return numbered.withColumn("position", F.col("__before") + F.col("inside")).select(*rows.columns, "position")


#: DuckDB SQL for op2 over conversations.
ORACLE = r"""
WITH RECURSIVE raw AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS ls FROM conversations),
lines AS (
  SELECT id, conv_id, turn, i, len(regexp_replace(regexp_extract(l, '^[ \t>]*>'), '[^>]', '', 'g')) AS level,
         regexp_replace(l, '^[ \t>]*>[ \t]?', '') AS body
  FROM (SELECT id, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM raw)),
marked AS (
  SELECT *, level = 0 AND NOT (coalesce(lead(level) OVER (PARTITION BY id ORDER BY i), 0) > 0
         AND regexp_matches(body, '(?i)^.*(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$')) AS own,
         trim(regexp_replace(lower(body), '[ \t\x0B\f]+', ' ', 'g')) AS line
  FROM lines),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN coalesce(lag(level) OVER w = level AND lag(own) OVER w = own AND lag(line) OVER w <> '' AND line <> '', false) THEN 0 ELSE 1 END AS opens
        FROM marked WINDOW w AS (PARTITION BY id ORDER BY i))
  WHERE level > 0 OR own),
passages AS (SELECT id, conv_id, turn, level, own, run, string_agg(line, ' ' ORDER BY i) AS passage FROM runs WHERE line <> '' GROUP BY ALL),
units AS (
  SELECT conv_id, turn, level, own, 0 AS kind, unnest(string_split(regexp_replace(passage, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS line FROM passages
  UNION ALL SELECT conv_id, turn, level, own, 1, line FROM marked WHERE level > 0 OR own),
first AS (SELECT conv_id, kind, line, min(turn) AS origin FROM units WHERE own AND line <> '' GROUP BY ALL),
votes AS (
  SELECT m.conv_id, m.turn, m.level, m.kind, f.origin, sum(len(m.line)) AS n
  FROM units m JOIN first f ON m.conv_id = f.conv_id AND m.kind = f.kind AND m.line = f.line
  WHERE m.level > 0 AND m.line <> '' AND f.origin < m.turn GROUP BY ALL),
parents AS (
  SELECT conv_id, turn, origin AS parent_turn
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, kind, n DESC, origin DESC) AS k FROM votes) WHERE k = 1),
up AS (
  SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM parents
  UNION ALL SELECT u.conv_id, u.turn, p.parent_turn, u.depth + 1 FROM up u JOIN parents p ON u.conv_id = p.conv_id AND u.above = p.turn),
roots AS (SELECT conv_id, turn, min(above) AS root_turn, max(depth) AS depth FROM up GROUP BY ALL),
texts AS (
  SELECT id, coalesce(string_agg(CASE WHEN own THEN body END, chr(10) ORDER BY i), '') AS text, count(*) FILTER (level > 0) AS n_quoted
  FROM marked GROUP BY id),
joined AS (
  SELECT r.conv_id, r.turn, r.role, regexp_replace(t.text, '^\s+|\s+$', '', 'g') AS text, CAST(t.n_quoted AS INTEGER) AS n_quoted,
         p.parent_turn, coalesce(o.root_turn, r.turn) AS root_turn, CAST(coalesce(o.depth, 0) AS BIGINT) AS depth
  FROM raw r JOIN texts t USING (id)
  LEFT JOIN parents p ON r.conv_id = p.conv_id AND r.turn = p.turn LEFT JOIN roots o ON r.conv_id = o.conv_id AND r.turn = o.turn)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY root_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) AS position FROM joined
"""

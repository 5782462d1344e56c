"""Mixing sources to target weights (operator 6).

Every document gets a key from a hash of its id, then its size and a hash of its text; within its source the keys give
the order. The space of keys is cut into ranges, so that prefix sums of token counts need only the documents of one
range plus the sums of the ranges before it: no task ever holds a whole source, or all documents of one id. A source's budget is first spent on whole epochs,
then on the documents whose prefix sums lie under what is left; the document at the cut gives the part that
is still missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.operators.ranges import prefix_sums
from sigwright.runtime import Cut

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: A word: anything but the ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Documents aimed at in one range of one source's keys.
RANGE_ROWS = 20_000
#: Digits of the part of a key that comes from the id, and of that and the size.
ID_DIGITS, SIZE_DIGITS = 32, 48
#: Ranges with so many times RANGE_ROWS documents are cut further.
HOT = 4
#: Sources up to which one task sorts their sums.
FEW_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) rows, written before, with their targets.

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target
    stops at max_epochs times its source's size; what is above goes to the others by weight until none is
    above. That is the level at which cap or level * weight, whichever is less, sums to the total: sources are
    capped in ascending order of cap / weight, and the level follows from sums over the capped ones before.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int"))
    few = sizes.count() <= FEW_SOURCES
    ranked = prefix_sums(sizes, [F.col("source").asc_nulls_last()], {"i": F.lit(1).cast("long")}, few)
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_level = [F.col("cap") / F.col("weight"), F.col("i")]
    steps = prefix_sums(ranked, by_level, {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, few)
    total = ranked.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(total.size) - F.col("cap_before")) / (F.lit(total.weight) - F.col("weight_before"))
    steps = steps.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that needs no cap holds for all that follow
    common = steps.agg(F.min(F.struct(by_level[0].alias("at"), "i", "level"))["level"].alias("level")).first().level
    target = F.col("cap") if common is None else F.least(F.col("cap"), F.lit(common) * F.col("weight"))
    return ranked.select(*sizes.columns, target.alias("target"))


def _keyed(docs: DataFrame, id_col: str, text: str, source: str, more: tuple[Column, ...] = ()) -> DataFrame:
    size = words(F.col(text))
    of_id = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    key = F.concat(of_id, F.lpad(F.lower(F.hex(size)), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"))
    # a name that is never null, so that windows and joins by source share one partitioning
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), name.alias("name"), size.alias("size"), key.alias("key"), *more)


def _digits(rows: int, range_rows: int) -> int:
    """Digits that cut so many rows, spread evenly, into ranges."""
    digits = 0
    while range_rows * 16**digits < rows:
        digits += 1
    return digits


def _spans(sized: DataFrame, range_rows: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds span, the prefix of the key that names a row's range: as long as the largest source asks for. Where
    one id has many documents, its range is cut by whole ids, and then by sizes and texts."""
    largest = sized.groupBy("name").count().agg(F.max("count")).first()[0] or 0
    first = F.substring("key", 1, _digits(largest, range_rows))
    of_id = F.substring("key", 1, ID_DIGITS)
    limit = HOT * range_rows
    wide = Cut(sized.groupBy("name", first.alias("first")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("name", "first"), "mix-wide").df
    if not wide.limit(1).count():
        return lambda rows: rows.withColumn("span", first)
    inside = sized.withColumn("first", first).join(wide, ["name", "first"], "left_semi")
    ids = Cut(inside.groupBy("name", of_id.alias("of_id")).agg(F.count("*").alias("n")).filter(F.col("n") > limit), "mix-ids").df
    most = ids.agg(F.max("n")).first()[0] or 0
    longest = F.substring("key", 1, SIZE_DIGITS + _digits(most, range_rows))

    def cut_up(rows: DataFrame) -> DataFrame:
        marked = rows.withColumns({"first": first, "of_id": of_id})
        marked = marked.join(wide.withColumn("wide", F.lit(True)), ["name", "first"], "left").join(ids.select("name", "of_id", F.lit(True).alias("hot")), ["name", "of_id"], "left")
        return marked.withColumn("span", F.when(F.col("hot"), longest).when(F.col("wide"), F.col("of_id")).otherwise(F.col("first"))).select(*rows.columns, "span")

    return cut_up


def _place(rows: DataFrame, sized: DataFrame, weights: tuple[float, ...], max_epochs: int, range_rows: int) -> DataFrame:
    """rows with source_size, target and taken; sized: the same rows, slim and already counted."""
    cut_up = _spans(sized, range_rows)
    spans = cut_up(sized).groupBy("name", "span").agg(F.sum("size").alias("span_size"), F.first("source").alias("source"))
    spans = Cut(spans, "mix-spans").df
    sums = Cut(spans.groupBy("name").agg(F.sum("span_size").alias("source_size"), F.first("source").alias("source")), "mix-sources").df
    targets = source_targets(sums, weights, max_epochs)
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    by_source = Window.partitionBy("name").orderBy("span")
    spans = spans.select("name", "span", (F.sum("span_size").over(by_source) - F.col("span_size")).alias("before")).join(targets, "name")
    inside = Window.partitionBy("name", "span").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_up(rows).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(spans.drop("source"), ["name", "span"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    return placed.withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of docs.

    size is the number of words (null text: 0), taken the words that the mix takes from the document, repeats
    counted. The sums of taken are each source's target, rounded down; the last document of a source may give
    only its first words. Rows with equal ids stand next to each other in an order by size; equal rows share
    alike, as they are interchangeable. A null id is a key like any other. An empty table gives no row. Other
    columns of docs are not read.

    Sizes are counted once and written to the shared folder; texts are never shuffled.
    """
    sized = Cut(_keyed(docs, id_col, text, source), "mix-sizes").df
    return _place(sized, sized, weights, max_epochs, range_rows).select("doc_id", "source", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed corpus, with the columns of docs: each document as often as it is taken, the last one of a
    source cut behind the words that its budget still holds. Documents that the mix doesn't take, and those
    without words, are left out. Repeated rows count as documents of their own.
    """
    sized = Cut(_keyed(docs, id_col, text, source), "mix-sizes").df
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    placed = _place(_keyed(docs, id_col, text, source, (row,)), sized, weights, max_epochs, range_rows).filter("taken > 0")
    copies = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.col("taken") - F.col("epoch") * F.col("size")
    whole = F.col("row").getField(text)
    # pieces are a word with the blanks behind it; blanks at the start are a piece of their own
    pieces = F.split(whole, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(whole.rlike("^[\\x20\\x09-\\x0D]"), F.lit(1)).otherwise(F.lit(0))
    start = F.concat_ws("", F.slice(pieces, F.lit(1), (left + lead).cast("int")))
    chosen = F.when(left >= F.col("size"), whole).otherwise(start)
    return copies.select(*((chosen if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns))


#: DuckDB SQL for mix() over documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         3.0::DOUBLE * source_size AS cap, (SELECT sum(size)::DOUBLE FROM sized) AS total
  FROM sums),
steps AS (
  SELECT *, (total - coalesce(sum(cap) OVER o, 0.0)) / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER o, 0.0)) AS level
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT level FROM steps WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(cap, (SELECT level FROM common) * w) AS target FROM steps),
placed AS (
  SELECT doc_id, s.source, size, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

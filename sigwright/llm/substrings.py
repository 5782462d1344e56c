"""Substring deduplication by paragraph MinHash banding (operator 4).

A paragraph begins where the words around it say so: at each word whose hash, together with the next two, is
the least within ``radius`` words. So a passage is cut alike wherever it stands, whatever its lines and
sentences; paragraphs have ``radius`` + 1 words or more and twice that on average. A paragraph's bands are the
least hashes of its word shingles, as many as its size calls for: sets at the least similarity share one of them
for certain. Paragraphs that collide are compared by exact Jaccard similarity, linked ones form clusters by
components, and equal sets are one node before that. In each cluster the document with the smallest id keeps
its paragraphs.

Where the equal paragraphs of a document end, the words beyond are compared one by one with those beyond the
kept paragraph, so a passage is known to its first and last word. Only words that one of these comparisons has
shown to repeat are removed, and a few changed ones between two parts that follow each other in the kept
document as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.llm.linking import linked_components
from sigwright.llm.shingles import GOLDEN, FlatWords, _mixed, flat_words, ordered_shingles, text_slices
from sigwright.runtime import Cut, Owner, release_memory, release_shuffles

NOTHING = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Options:
    """shingle: words of a shingle. num / den: least similarity of linked paragraphs. radius: words to each side
    of a paragraph's beginning that it is chosen among, shingle - 1 or more. least: repeated words of the least
    passage that is removed. bridge: changed words between two repeated parts of one passage, at most."""

    shingle: int = 5
    num: int = 80
    den: int = 100
    radius: int = 4
    least: int = 20
    bridge: int = 6


DEFAULT = Options()


@dataclass
class Paragraphs:
    """Paragraphs of several texts, as flat word numbers: text, first and last (behind) word, node (hash of the
    shingle set), size of the set; owner and shingle of all sets, sorted; bands: whether a shingle is one."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    node: np.ndarray
    owner: np.ndarray
    shingle: np.ndarray
    bands: np.ndarray


def beginnings(words: FlatWords, options: Options = DEFAULT) -> np.ndarray:
    """The flat numbers of the words at which paragraphs begin. Texts are cut without regard to each other; no
    paragraph has fewer words than a shingle, unless its text has."""
    n, r = len(words.h), options.radius
    sizes = np.diff(words.first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    left = words.first[1:][text] - np.arange(n)
    ahead = np.concatenate([words.h, np.zeros(2, np.uint64)])
    key = _mixed(ahead[:-2] * np.uint64(GOLDEN) + (ahead[1:-1] ^ (ahead[1:-1] >> np.uint64(31))) + ahead[2:] * np.uint64(3))
    key[left < 3] = NOTHING
    at = np.arange(n) + r * (text + 1)
    spread = np.full(n + r * (len(sizes) + 1), NOTHING)
    spread[at] = key
    low, width = spread, 1
    while width < r:
        step = min(width, r - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    done = np.arange(n) - words.first[:-1][text]
    cut = (key < low[at - r]) & (key <= low[at + 1]) & (done >= options.shingle) & (left >= options.shingle) | (done == 0)
    return np.flatnonzero(cut)


def paragraphs(words: FlatWords, options: Options = DEFAULT) -> Paragraphs:
    first = beginnings(words, options)
    last = np.append(first[1:], len(words.h))
    sizes = last - first - (options.shingle - 1)
    first, last, sizes = first[sizes > 0], last[sizes > 0], sizes[sizes > 0]
    text = np.searchsorted(words.first, first, "right") - 1
    if not len(first):
        none = np.zeros(0, np.int64)
        return Paragraphs(none, none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool))
    owner = np.repeat(np.arange(len(first)), sizes)
    shingle = ordered_shingles(words.h, options.shingle)[np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]]
    bits = np.uint64(max(1, len(first).bit_length()))
    shingle = shingle[np.argsort(owner.astype(np.uint64) << (np.uint64(64) - bits) | shingle >> bits)]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    owner, shingle = owner[new], shingle[new]
    size = np.bincount(owner)
    starts = np.cumsum(size) - size
    node = _mixed(np.add.reduceat(_mixed(shingle + np.uint64(GOLDEN)), starts)).view(np.int64)
    return Paragraphs(text, first, last, node, owner, shingle, np.arange(len(owner)) - starts[owner] < n_bands(size, options)[owner])


def n_bands(size: np.ndarray, options: Options = DEFAULT) -> np.ndarray:
    """Bands of sets of a size: by so many least shingles two sets at the least similarity must meet. None for
    sets so small that only an equal one is similar enough."""
    bands = size + -options.num * size // options.den + 1
    return np.where(size * (options.den - options.num) >= options.num, bands, 0)


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(text).alias("text_hash"), F.col(text).alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _cut_up(source: DataFrame, options: Options) -> DataFrame:
    """One row for each paragraph of each text: place, node and, once in a batch, the bands."""
    names = ["doc_id", "text_hash", "first", "last", "node", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            words = flat_words(batch.column(2))
            p = paragraphs(words, options)
            if not len(p.first):
                continue
            rows, before = pa.array(p.text), words.first[p.text]
            fresh = np.zeros(len(p.node), bool)
            fresh[np.unique(p.node, return_index=True)[1]] = True
            sent = p.bands & fresh[p.owner]
            ends = np.concatenate([[0], np.cumsum(np.bincount(p.owner[sent], minlength=len(p.node)))])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p.shingle[sent].view(np.int64)))
            places = [pa.array((x - before).astype(np.int32)) for x in (p.first, p.last)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *places, pa.array(p.node), bands], names=names)
        release_memory()

    return source.mapInArrow(run, "doc_id long, text_hash int, first int, last int, node long, bands array<long>")


def _gathered(starts: np.ndarray, lengths: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[0], starts[0] + step, ... for each start, as many as its length."""
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(starts, lengths) + step * within


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))


def _look_up(texts: DataFrame, options: Options) -> DataFrame:
    """From (doc_id, text_hash, nodes, places, text): the set of each node (id, set), and for each place (at, side)
    the hashes of the words beyond it: behind it (side 1) or, backwards, before it (side 0), as far as a run of
    equal words can go that makes no whole paragraph."""
    reach = options.radius + 3
    kind = "id long, set array<long>, doc_id long, text_hash int, at int, side int, words array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4):
            words = flat_words(batch.column(4))
            p = paragraphs(words, options)
            if not len(p.first):
                continue
            texts_at = np.arange(batch.num_rows)
            # nodes that are asked for, by text: places of equal (text, node) hashes, then of equal nodes
            asked, owner = batch.column(2).flatten().to_numpy(), np.repeat(texts_at, batch.column(2).value_lengths().to_numpy())
            both = lambda node, text: _mixed(node.view(np.uint64) ^ _mixed(text.astype(np.uint64)))
            mine = both(p.node, p.text)
            order = np.argsort(mine)
            k = order[np.minimum(np.searchsorted(mine[order], both(asked, owner)), len(order) - 1)]
            k = k[(p.node[k] == asked) & (p.text[k] == owner)]
            begins = np.searchsorted(p.owner, k)
            sizes = np.searchsorted(p.owner, k, "right") - begins
            sets = _lists(p.shingle[_gathered(begins, sizes)].view(np.int64), sizes)
            places, owner = batch.column(3).flatten(), np.repeat(texts_at, batch.column(3).value_lengths().to_numpy())
            at, side = (places.field(i).to_numpy() for i in (0, 1))
            begin, end = words.first[owner], words.first[owner + 1]
            where = begin + at
            ahead = np.minimum(np.searchsorted(p.first, where), len(p.first) - 1)
            behind = np.minimum(np.searchsorted(p.last, where), len(p.last) - 1)
            to = np.where(p.first[ahead] == where, np.minimum(end, p.last[ahead] + reach), end)
            since = np.where(p.last[behind] == where, np.maximum(begin, p.first[behind] - reach), begin)
            lengths = np.where(side == 1, to - where, where - since)
            index = _gathered(np.where(side == 1, where, where - 1), lengths, 1 if not len(side) else np.repeat(np.where(side == 1, 1, -1), lengths))
            beyond = _lists(words.h[index].view(np.int64), lengths)
            n, m, rows = len(k), len(at), pa.array(owner)
            mixed = [
                (pa.array(p.node[k]), None), (sets, None), (None, batch.column(0).take(rows)), (None, batch.column(1).take(rows)),
                (None, pa.array(at, pa.int32())), (None, pa.array(side, pa.int32())), (None, beyond),
            ]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([x if x is not None else pa.nulls(n, y.type), y if y is not None else pa.nulls(m, x.type)]) for x, y in mixed], names=["id", "set", "doc_id", "text_hash", "at", "side", "words"])
        release_memory()

    return texts.mapInArrow(run, kind)


def _equal_words(x: Column, y: Column) -> Column:
    """How many words at the start of two lists are equal."""
    differs = F.array_position(F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int")


def _runs(copies: DataFrame) -> DataFrame:
    """Copied paragraphs that follow each other here and in the kept document, as one row: first, last, kept_first,
    kept_last, n_paragraphs, and whether the words before and behind are of no copied paragraph (opens, closes).
    Rows that occur again count once."""
    in_text = Window.partitionBy("doc_id", "text_hash").orderBy("first")
    before = lambda c: F.lag(c).over(in_text)
    once = copies.withColumn("again", before("first").eqNullSafe(F.col("first"))).filter("NOT again").drop("again")
    joins = before("last").eqNullSafe(F.col("first"))
    goes_on = joins & before("kept_in").eqNullSafe(F.col("kept_in")) & before("kept_hash").eqNullSafe(F.col("kept_hash")) & before("kept_last").eqNullSafe(F.col("kept_first"))
    closes = ~F.lead("first").over(in_text).eqNullSafe(F.col("last"))
    marked = once.withColumns({"opens": ~joins, "closes": closes, "new": F.when(goes_on, 0).otherwise(1)}).withColumn("run", F.sum("new").over(in_text))
    return marked.groupBy("doc_id", "text_hash", "run", "kept_in", "kept_hash").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min_by("kept_first", "first").alias("kept_first"),
        F.max_by("kept_last", "first").alias("kept_last"),
        F.count("*").alias("n_paragraphs"),
        F.max("opens").alias("opens"),
        F.max("closes").alias("closes"),
    ).drop("run")


def _extended(runs: DataFrame, beyond: DataFrame) -> DataFrame:
    """runs with the words around them that the kept document has as well: at the ends where no other copied
    paragraph follows."""
    beyond = beyond.dropDuplicates(["doc_id", "text_hash", "at", "side"])
    kept = beyond.select(F.col("doc_id").alias("kept_in"), F.col("text_hash").alias("kept_hash"), F.col("at").alias("kept_at"), "side", F.col("words").alias("kept_words"))
    out = runs
    for side, at, sign in ((0, "first", -1), (1, "last", 1)):
        edges = runs.filter("closes" if side else "opens").select("doc_id", "text_hash", F.col(at).alias("at"), "kept_in", "kept_hash", F.col(f"kept_{at}").alias("kept_at"))
        both = edges.join(beyond.filter(F.col("side") == side), ["doc_id", "text_hash", "at"]).join(kept.filter(F.col("side") == side).drop("side"), ["kept_in", "kept_hash", "kept_at"])
        more = both.select("doc_id", "text_hash", F.col("at").alias(at), _equal_words(F.col("words"), F.col("kept_words")).alias("more")).filter("more > 0")
        out = out.withColumn(f"edge_{at}", F.col(at)).join(more.withColumnRenamed(at, f"edge_{at}"), ["doc_id", "text_hash", f"edge_{at}"], "left").drop(f"edge_{at}")
        grown = sign * F.coalesce("more", F.lit(0))
        out = out.withColumns({at: F.col(at) + grown, f"kept_{at}": F.col(f"kept_{at}") + grown}).drop("more")
    return out


def _passages(parts: DataFrame, options: Options) -> DataFrame:
    """Passages from repeated parts of texts: parts that meet are one span, spans that a few changed words part
    and that follow each other in the same kept document as well are one too. Spans with few words between them
    count as one passage when it comes to its least length."""
    text = Window.partitionBy("doc_id", "text_hash")
    order = text.orderBy("first", "last", "kept_in", "kept_first", "kept_last", "n_paragraphs")
    behind = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > behind, F.lit(True)).cast("int")
    spans = parts.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order)).groupBy("doc_id", "text_hash", "span").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n_paragraphs").alias("n_paragraphs"),
        F.min(F.struct("first", "kept_in", "kept_first")).alias("opens"),
        F.max(F.struct("last", "kept_in", "kept_last")).alias("closes"),
        F.collect_set("kept_in").alias("sources"),
    )
    by_span = text.orderBy("first")
    gap = F.col("first") - F.lag("last").over(by_span)
    before = F.lag("closes").over(by_span)
    same = (before["kept_in"] == F.col("opens.kept_in")) & (F.col("opens.kept_first") - before["kept_last"]).between(0, options.bridge)
    close = F.coalesce(gap <= options.bridge, F.lit(False))
    spans = spans.withColumn("island", F.when(close, 0).otherwise(1)).withColumn("join", F.when(close & F.coalesce(same, F.lit(False)), 0).otherwise(1))
    spans = spans.withColumn("island", F.sum("island").over(by_span)).withColumn("join", F.sum("join").over(by_span))
    rows = spans.groupBy("doc_id", "text_hash", "island", "join").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("n_paragraphs").alias("n_paragraphs"),
        F.min("opens")["kept_in"].alias("copy_of"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    ).withColumn("n_words", F.col("last") - F.col("first"))
    long = F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "island")).cast("int")
    return rows.withColumn("passage_words", long).filter(F.col("passage_words") >= options.least).select("doc_id", "text_hash", "first", "last", "n_words", "n_paragraphs", "passage_words", "copy_of", "sources")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", options: Options = DEFAULT) -> DataFrame:
    """One row for each span to remove: doc_id and text_hash (hash of the text), first and last (behind) word,
    n_words, n_paragraphs (repeated ones that it holds), passage_words (of all spans with no more than ``bridge``
    words between them), copy_of (the document that keeps the span's first words) and sources (all documents that
    keep parts of it).

    Repeats within one document stay, so do passages of fewer than ``least`` repeated words. Rows with one id are
    one document: they keep nothing from each other, but each text has spans of its own. Null ids and texts, and
    texts with fewer words than a shingle, give no row; rows that occur again give theirs once. Empty tables give no
    row; other columns are not read. Words, shingles and sets are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    source = _source(docs, id_col, text)
    cuts = Cut(_cut_up(source, options), "paragraphs")
    found = cuts.df.drop("bands")
    keys = cuts.df.filter(F.size("bands") > 0).select(F.explode("bands").alias("key"), F.col("node").alias("id"))
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key")
    # paragraphs that share a band with an unequal one, and those of which another document has an equal one
    met = Cut(keys.join(shared, "key").select(F.col("id").alias("node")).distinct(), "paragraphs-met")
    release_shuffles(spark)
    equal = found.groupBy("node").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("other")).filter("kept_in <> other")
    wanted = equal.select("node", "kept_in", F.lit(False).alias("near")).unionByName(met.df.select("node", F.lit(None).cast("long").alias("kept_in"), F.lit(True).alias("near")))
    wanted = wanted.groupBy("node").agg(F.max("kept_in").alias("kept_in"), F.max("near").alias("near"))
    chosen_cut = Cut(found.join(wanted, "node"), "paragraphs-chosen")
    chosen = chosen_cut.df
    cuts.drop()
    met.drop()
    release_shuffles(spark)
    # of the kept document's equal paragraphs the first, by text and place, in one number
    place = F.shiftleft(F.col("text_hash").cast("long"), 31).bitwiseOR(F.col("first").cast("long"))
    keeps = chosen.filter("doc_id = kept_in").groupBy("node").agg(F.min(place).alias("place"), F.min_by("last", place).alias("kept_last"))
    keeps = keeps.select("node", F.shiftright("place", 31).cast("int").alias("kept_hash"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("kept_first"), "kept_last")
    copied_cut = Cut(_runs(chosen.filter("doc_id > kept_in").drop("near").join(keeps, "node").drop("node")), "paragraphs-copied")
    copied = copied_cut.df
    edges = [(0, "opens", "first"), (1, "closes", "last")]
    places = [copied.filter(edge).select("doc_id", "text_hash", F.col(at).alias("at"), F.lit(side).alias("side")) for side, edge, at in edges]
    places += [copied.filter(edge).select(F.col("kept_in").alias("doc_id"), F.col("kept_hash").alias("text_hash"), F.col(f"kept_{at}").alias("at"), F.lit(side).alias("side")) for side, edge, at in edges]
    places = places[0].unionByName(places[1]).unionByName(places[2]).unionByName(places[3]).distinct()
    sets_of = chosen.filter("near").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_hash", "doc_id").alias("text_hash"))
    asked = places.select("doc_id", "text_hash", F.lit(None).cast("long").alias("node"), F.struct("at", "side").alias("place")).unionByName(
        sets_of.select("doc_id", "text_hash", "node", F.lit(None).cast("struct<at int, side int>").alias("place"))
    ).groupBy("doc_id", "text_hash").agg(F.collect_list("node").alias("nodes"), F.collect_list("place").alias("places"))
    texts = source.join(asked, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "nodes", "places", "text")
    reread_cut = Cut(_look_up(texts, options), "paragraph-words")
    reread = reread_cut.df
    release_shuffles(spark)
    # rows that occur again give the same set again
    sets = Cut(reread.filter("id IS NOT NULL").select("id", "set").dropDuplicates(["id"]), "paragraph-sets").df
    roots = linked_components(None, sets, options.num, options.den)
    linked = chosen.join(roots, chosen["node"] == roots["id"]).select("doc_id", "text_hash", "first", "last", F.col("root").alias("cluster"), F.coalesce(F.col("doc_id") > F.col("kept_in"), F.lit(False)).alias("copied"))
    kept = linked.groupBy("cluster").agg(F.min("doc_id").alias("kept_in"))
    near = linked.filter("NOT copied").join(kept, "cluster").filter("doc_id <> kept_in").select("doc_id", "text_hash", "first", "last", "kept_in").distinct()
    # beside an equal paragraph words have been compared one by one: that says more
    for mine, other in (("first", "last"), ("last", "first")):
        near = near.join(copied.select("doc_id", "text_hash", F.col(other).alias(mine)), ["doc_id", "text_hash", mine], "left_anti")
    no_place = F.lit(None).cast("int")
    near = near.withColumns({"kept_first": no_place, "kept_last": no_place, "n_paragraphs": F.lit(1).cast("long")})
    exact = _extended(copied, reread.filter("id IS NULL").drop("id", "set")).drop("kept_hash", "opens", "closes")
    return _passages(exact.unionByName(near), options)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without spans of bytes; the blanks behind a removed span go with it."""
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(raw[at:start])
        at = end
        while at < len(raw) and raw[at] in b" \t\n\r\x0b\x0c":
            at += 1
    out.append(raw[at:])
    return b"".join(out).rstrip(b" \t\n\r\x0b\x0c") if spans else raw


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", options: Options = DEFAULT) -> DataFrame:
    """docs with the passages of repeated_passages cut out of the texts that hold them; documents of which nothing
    but blanks is left go. Rows without such passages stay as they are, in all columns."""
    # names that no column of docs has, whatever its columns are called
    mark = "_" * (1 + max(len(c) for c in docs.columns))
    own_id, own_hash, cuts = (f"{mark}{c}" for c in ("id", "hash", "spans"))
    with Owner() as owner:
        spans = repeated_passages(docs, id_col, text, options)
        spans = owner.keep(Cut(spans.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.collect_list(F.struct("first", "last")).alias(cuts)), "spans")).df
    release_shuffles(docs.sparkSession)
    joined = docs.join(spans, (docs[id_col].cast("long") == F.col(own_id)) & (F.hash(docs[text]) == F.col(own_hash)), "left").drop(own_id, own_hash)
    names = docs.columns
    at = names.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for i, (value, spans) in enumerate(zip(batch.column(at), batch.column(len(names)).to_pylist(), strict=True)):
                own = value.as_py()
                if spans and own is not None:
                    words = flat_words(pa.array([own]))
                    own = without(own.encode(), [(int(words.start[s["first"]]), int(words.end[s["last"] - 1])) for s in spans]).decode()
                    if not own:
                        continue
                keep.append(i)
                texts.append(own)
            columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[: len(names)]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    return joined.mapInArrow(apply, docs.schema)

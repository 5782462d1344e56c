"""Abundance of transcripts from key counts: weight classes, expectation maximisation, report.

A class is a set of keys of one gene that have the same weights. It holds the transcripts in which its keys stand, with
weights (``entries``), and no others: what is stored and computed grows with these entries, not with
classes times transcripts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.functions import dna
from sigwright.options import EstimateOptions
from sigwright.runtime import Cut


def key_weights(positions: DataFrame) -> DataFrame:
    """(gid, key, tidx, weight): in how many places a key stands in a transcript."""
    return positions.groupBy("gid", "key", "tidx").agg(F.count("*").cast("int").alias("weight"))


def class_name(entries: str = "entries") -> F.Column:
    """The name of a class in its gene: 128 bits of hashes of its entries."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), entries)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), entries)))


def key_classes(keys: DataFrame, positions: DataFrame) -> DataFrame:
    """keys (gid, key, ...) with class and entries: array<struct<tidx, weight>> in order of tidx, empty without a place."""
    by_key = key_weights(positions).groupBy("gid", "key").agg(F.array_sort(F.collect_list(F.struct("tidx", "weight"))).alias("entries"))
    none = F.array().cast(by_key.schema["entries"].dataType)
    return keys.join(by_key, ["gid", "key"], "left").withColumn("entries", F.coalesce("entries", none)).withColumn("class", class_name())


def weight_classes(counts: DataFrame, positions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(gid, n, class, entries, total_counts, occurrences): keys of a gene with equal weights in all its transcripts, their
    counts summed; n is the number of the gene's transcripts. Keys without a place are a class without entries.

    counts: (gid, key, count); transcripts: (gid, tidx, ...), tidx from 0 without gaps.
    """
    sizes = transcripts.groupBy("gid").agg((F.max("tidx") + 1).alias("n"))
    summed = key_classes(counts, positions).groupBy("gid", "class").agg(F.sum("count").alias("total_counts"), F.count("*").alias("occurrences"), F.any_value("entries").alias("entries"))
    return summed.join(sizes, "gid").select("gid", "n", "class", "entries", "total_counts", "occurrences")


def dense_weights(n: F.Column, entries: F.Column) -> F.Column:
    """array<int> of a class's weights in all n transcripts, for those who want to look at them."""
    by_tidx = F.map_from_entries(entries)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.coalesce(F.element_at(by_tidx, t), F.lit(0)))


def class_weights(classes: DataFrame) -> DataFrame:
    """(gid, class, tidx, w, total_counts, occurrences) of the transcripts that a class touches."""
    each = classes.select("gid", "class", "total_counts", "occurrences", F.explode("entries").alias("e"))
    return each.select("gid", "class", "total_counts", "occurrences", F.col("e.tidx").alias("tidx"), F.col("e.weight").alias("w"))


def effective_kmers(classes: DataFrame) -> DataFrame:
    """(gid, tidx, n_kmers): sum of weight times occurrences."""
    return class_weights(classes).groupBy("gid", "tidx").agg(F.sum(F.col("w") * F.col("occurrences")).alias("n_kmers"))


def counted_genes(classes: DataFrame) -> DataFrame:
    """(gid) with any count above 0: only these need to be estimated."""
    return classes.groupBy("gid").agg(F.max("total_counts").alias("most")).filter("most > 0").select("gid")


#: Classes in one number of a bitmap.
_BITS = 63


def covered_transcripts(classes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(gid, covering, covered): every class that touches ``covered`` touches ``covering`` too. A transcript that no class
    touches is covered by all others.

    A transcript's classes are a bitmap, of which only the numbers that are not 0 are kept. Who covers a transcript holds
    the rarest of its classes: the holders of that class are the candidates, and bits decide. A diagnostic; the
    estimate does not use it.
    """
    ids = transcripts.select("gid", "tidx").distinct()
    numbered = classes.filter(F.size("entries") > 0).select("gid", "entries", (F.row_number().over(Window.partitionBy("gid").orderBy("class")) - 1).alias("c"))
    touched = numbered.select("gid", "c", F.size("entries").alias("held"), F.explode("entries.tidx").alias("tidx"))
    words = touched.groupBy("gid", "tidx", F.floor(F.col("c") / _BITS).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(c % {_BITS} as int))")).alias("bits"))
    bitmaps = words.groupBy("gid", "tidx").agg(F.collect_list(F.struct("word", "bits")).alias("bits"))
    rarest = touched.groupBy("gid", F.col("tidx").alias("covered")).agg(F.min(F.struct("held", "c"))["c"].alias("c"))
    candidates = rarest.join(touched.select("gid", "c", F.col("tidx").alias("covering")), ["gid", "c"]).filter("covering <> covered").select("gid", "covering", "covered")
    lower = bitmaps.select("gid", F.col("tidx").alias("covered"), F.col("bits").alias("below"))
    upper = bitmaps.select("gid", F.col("tidx").alias("covering"), F.map_from_entries("bits").alias("above"))
    holds = F.forall("below", lambda x: F.element_at("above", x["word"]).bitwiseAND(x["bits"]).eqNullSafe(x["bits"]))
    found = candidates.join(lower, ["gid", "covered"]).join(upper, ["gid", "covering"]).filter(holds).select("gid", "covering", "covered")
    bare = ids.join(bitmaps.select("gid", "tidx"), ["gid", "tidx"], "left_anti").select("gid", F.col("tidx").alias("covered"))
    every = bare.join(ids.withColumnRenamed("tidx", "covering"), "gid").filter("covering <> covered").select("gid", "covering", "covered")
    return found.unionByName(every)


def sparse_maximisation(tidx: np.ndarray, weight: np.ndarray, owner: np.ndarray, counts: np.ndarray, occurrences: np.ndarray, n: int, start: np.ndarray | None = None, options: EstimateOptions = EstimateOptions(), rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(density, shares, sizes, rounds) of one gene of n transcripts; entry i says that the class owner[i], in ascending
    order, has a weight in the transcript tidx[i].

    Stops when no share moves by the tolerance, or after ``rounds`` rounds where given. The shares returned
    are those of densities, from which another call can start.
    """
    pi = np.full(n, 1.0 / n) if start is None else start.astype(float)
    size = np.bincount(tidx, weight * occurrences[owner], n)
    # entries of classes without counts give nobody anything
    live = counts[owner] > 0
    tidx, owner = tidx[live], owner[live]
    per = weight[live] * occurrences[owner] / size[tidx]
    done = 0
    while True:
        part = per * pi[tidx]
        total = np.bincount(owner, part, len(counts))
        scale = np.divide(counts, total, out=np.zeros(len(counts)), where=total > 0)
        found = np.bincount(tidx, part * scale[owner], n)
        found[found < options.least_count] = 0
        whole = found.sum()
        new = found / whole if whole > 0 else np.zeros(n)
        moved = np.abs(new - pi).max(initial=0)
        pi = new
        done += 1
        if (rounds is not None and done >= rounds) or (rounds is None and (moved < options.tolerance or done > options.max_rounds)):
            break
    density = np.divide(found, size, out=np.zeros(n), where=size > 0)
    whole = density.sum()
    return density, (density / whole if whole > 0 else np.zeros(n)), size, done


def expectation_maximisation(weights: np.ndarray, counts: np.ndarray, occurrences: np.ndarray, start: np.ndarray | None = None, options: EstimateOptions = EstimateOptions(), rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(density, shares, rounds) as sparse_maximisation has them, from a matrix of weights, classes x transcripts."""
    owner, tidx = np.nonzero(weights)
    density, share, _, done = sparse_maximisation(tidx, weights[owner, tidx].astype(float), owner, counts, occurrences, weights.shape[1], start, options, rounds)
    return density, share, done


EM_SCHEMA = "gid string, tidx int, n_reads_kmers double, density double, share double, rounds long"


def _entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tidx, weight, owner) of a column of entries."""
    flat = column.flatten()
    return flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(float), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def estimate_genes(classes: DataFrame, options: EstimateOptions = EstimateOptions(), rounds: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(gid, tidx, n_reads_kmers, density, share, rounds) of genes with any count.

    Genes are independent. One of up to ``options.group_entries`` entries of classes is a group of an Arrow function, which
    holds the entries and nothing that is larger. Those above are estimated together, by rounds of aggregations
    over their entries. start: (gid, tidx, share) to begin from, as for repeated estimates on growing counts.
    """
    genes = Cut(classes.groupBy("gid").agg(F.max("total_counts").alias("most"), F.sum(F.size("entries")).alias("cells")).filter("most > 0").drop("most"), "counted-genes").df
    small = genes.filter(F.col("cells") <= options.group_entries).select("gid")
    large = genes.filter(F.col("cells") > options.group_entries).select("gid")
    found = _by_group(classes.join(small, "gid"), options, rounds, start)
    if not large.limit(1).count():
        return found
    return found.unionByName(_by_rounds(classes.join(large, "gid"), options, rounds, start))


def _by_group(classes: DataFrame, options: EstimateOptions, rounds: int | None, start: DataFrame | None) -> DataFrame:
    rows = classes.withColumn("begin", F.lit(None).cast("array<double>"))
    if start is not None:
        begin = start.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("tidx", "share"))), lambda x: x["share"]).alias("begin"))
        rows = rows.drop("begin").join(begin, "gid", "left")

    def run(group: pa.Table) -> pa.Table:
        # in one order, whatever the order of tasks: sums do not depend on it
        group = group.sort_by("class")
        n = group.column("n")[0].as_py()
        tidx, weight, owner = _entries_of(group.column("entries").combine_chunks())
        counts, occurrences = (group.column(c).to_numpy().astype(float) for c in ("total_counts", "occurrences"))
        begin = group.column("begin")[0].as_py()
        begin = np.array(begin, float) if begin is not None and len(begin) == n and sum(begin) > 0 else None
        density, share, size, done = sparse_maximisation(tidx, weight, owner, counts, occurrences, n, begin, options, rounds)
        columns = [pa.array([group.column("gid")[0].as_py()] * n), pa.array(range(n), pa.int32()), pa.array(density * size), pa.array(density), pa.array(share), pa.array([done] * n, pa.int64())]
        return pa.table(columns, names=["gid", "tidx", "n_reads_kmers", "density", "share", "rounds"])

    return rows.select("gid", "n", "class", "entries", "total_counts", "occurrences", "begin").groupBy("gid").applyInArrow(run, EM_SCHEMA)


def _by_rounds(classes: DataFrame, options: EstimateOptions, rounds: int | None, start: DataFrame | None) -> DataFrame:
    """The estimates of genes of any size. A round is a join of entries with shares and two aggregations, and is written to
    the shared folder; genes that have settled take no part in the next. Genes are few here, their entries many."""
    classes = Cut(classes, "large-classes").df
    kmers = Cut(effective_kmers(classes), "large-kmers").df
    per = F.col("w") * F.col("occurrences") / F.col("n_kmers")
    cells = class_weights(classes.filter("total_counts > 0")).join(kmers, ["gid", "tidx"]).select("gid", "class", "tidx", "total_counts", per.alias("per"))
    cells = Cut(cells, "large-entries").df
    members = classes.groupBy("gid").agg(F.max("n").alias("n"))
    ids = members.select("gid", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tidx"))
    even = 1.0 / F.col("n")
    if start is not None:
        sums = start.groupBy("gid").agg(F.sum("share").alias("whole"), F.count("*").alias("known"))
        ids = ids.join(start.select("gid", "tidx", "share"), ["gid", "tidx"], "left").join(sums, "gid", "left")
        even = F.when((F.col("whole") > 0) & (F.col("known") == F.col("n")), F.col("share")).otherwise(even)
    state = Cut(ids.select("gid", "tidx", even.alias("pi"), F.lit(0.0).alias("found")), "em-state")
    settled: list[DataFrame] = []
    done = 0
    while True:
        part = cells.join(state.df.select("gid", "tidx", "pi"), ["gid", "tidx"]).select("gid", "class", "tidx", "total_counts", (F.col("per") * F.col("pi")).alias("x"))
        sums = part.groupBy("gid", "class").agg(F.sum("x").alias("s")).filter("s > 0")
        given = part.join(sums, ["gid", "class"]).groupBy("gid", "tidx").agg(F.sum(F.col("total_counts") * F.col("x") / F.col("s")).alias("y")).filter(F.col("y") >= options.least_count)
        found = state.df.select("gid", "tidx", "pi").join(given, ["gid", "tidx"], "left").withColumn("found", F.coalesce("y", F.lit(0.0))).drop("y")
        found = Cut(found, "em-found")
        # one row a gene of this kind, of which there are few
        whole = F.broadcast(found.df.groupBy("gid").agg(F.sum("found").alias("whole")))
        share = F.when(F.col("whole") > 0, F.col("found") / F.col("whole")).otherwise(0.0)
        after = Cut(found.df.join(whole, "gid").select("gid", "tidx", share.alias("pi"), "found", F.abs(share - F.col("pi")).alias("moved")), "em-state")
        done += 1
        state.drop()
        found.drop()
        quiet = F.lit(rounds is not None and done >= rounds or rounds is None and done > options.max_rounds)
        if rounds is None:
            quiet = quiet | (F.max("moved") < options.tolerance)
        ended = Cut(after.df.groupBy("gid").agg(quiet.alias("quiet")), "em-settled")
        resting, open_ = ended.df.filter("quiet").select("gid"), ended.df.filter("NOT quiet").select("gid")
        if resting.limit(1).count():
            settled.append(Cut(after.df.join(F.broadcast(resting), "gid").select("gid", "tidx", "found", F.lit(done).cast("long").alias("rounds")), "em-done").df)
        if not open_.limit(1).count():
            break
        state = Cut(after.df.join(F.broadcast(open_), "gid").select("gid", "tidx", "pi", "found"), "em-state")
        after.drop()
        ended.drop()
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(kmers, ["gid", "tidx"], "left").withColumn("density", F.coalesce(F.col("found") / F.col("n_kmers"), F.lit(0.0)))
    whole = F.broadcast(rows.groupBy("gid").agg(F.sum("density").alias("whole")))
    share = F.when(F.col("whole") > 0, F.col("density") / F.col("whole")).otherwise(0.0)
    return rows.join(whole, "gid").select("gid", F.col("tidx").cast("int").alias("tidx"), F.col("found").alias("n_reads_kmers"), "density", share.alias("share"), "rounds")


def one_round(classes: DataFrame, found: DataFrame, least_count: float = 1e-7) -> DataFrame:
    """(gid, tidx, again): counts by transcript after one round of expectation maximisation from found (gid, tidx,
    found), without leaving the JVM. Transcripts that get less than the least count are left out."""
    whole = found.groupBy("gid").agg(F.sum("found").alias("whole"))
    pi = found.join(whole, "gid").select("gid", "tidx", F.when(F.col("whole") > 0, F.col("found") / F.col("whole")).otherwise(0.0).alias("pi"))
    parts = class_weights(classes).join(effective_kmers(classes), ["gid", "tidx"]).join(pi, ["gid", "tidx"])
    parts = parts.select("gid", "class", "tidx", "total_counts", (F.col("w") * F.col("occurrences") / F.col("n_kmers") * F.col("pi")).alias("x"))
    sums = parts.groupBy("gid", "class").agg(F.sum("x").alias("s"))
    given = parts.join(sums, ["gid", "class"]).select("gid", "tidx", F.when(F.col("s") > 0, F.col("total_counts") * F.col("x") / F.col("s")).otherwise(0.0).alias("y"))
    return given.groupBy("gid", "tidx").agg(F.sum("y").alias("again")).filter(F.col("again") >= least_count)


def log_likelihood(classes: DataFrame, shares: DataFrame) -> DataFrame:
    """(gid, log_likelihood) of shares (gid, tidx, share): sum of count * ln(sum of share * weight * occurrences / kmers).

    A diagnostic; classes without a count or a positive sum add nothing.
    """
    rows = class_weights(classes).join(effective_kmers(classes), ["gid", "tidx"]).join(shares, ["gid", "tidx"])
    inner = rows.groupBy("gid", "class", "total_counts").agg(F.sum(F.col("share") * F.col("w") * F.col("occurrences") / F.col("n_kmers")).alias("p"))
    term = F.when((F.col("p") > 0) & (F.col("total_counts") > 0), F.col("total_counts") * F.log("p")).otherwise(F.lit(0.0))
    return inner.groupBy("gid").agg(F.sum(term).alias("log_likelihood"))


def abundance(transcripts: DataFrame, estimates: DataFrame, options: EstimateOptions = EstimateOptions()) -> DataFrame:
    """(tid, length, est_reads, rpkm, tpm) of every transcript; those without an estimate have 0.

    Densities times lengths below the least abundance count as 0. Of transcripts that share a tid the one of
    the last gene, in order of gene ids, counts. Totals are one aggregated row, sent to every task.
    """
    full = transcripts.select("gid", "tidx", "tid", F.char_length("seq").alias("length")).join(estimates.select("gid", "tidx", "density"), ["gid", "tidx"], "left")
    x = F.coalesce(F.col("density"), F.lit(0.0)) * F.col("length")
    last = F.max_by(F.struct("length", F.when(x < options.least_abundance, 0.0).otherwise(x).alias("x")), F.struct("gid", "tidx"))
    rows = full.groupBy("tid").agg(last.alias("r")).select("tid", "r.length", dna.scaled_reads(F.col("r.x"), options.read_length, options.k).alias("est_reads"))
    totals = rows.agg(F.sum("est_reads").alias("all_reads"), F.sum(F.try_divide("est_reads", "length")).alias("all_density"))
    return rows.crossJoin(F.broadcast(totals)).select(
        "tid", "length", "est_reads", dna.rpkm(F.col("est_reads"), F.col("length"), F.col("all_reads")).alias("rpkm"), dna.tpm(F.col("est_reads"), F.col("length"), F.col("all_density")).alias("tpm")
    )

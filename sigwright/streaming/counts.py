"""Counts and estimates that follow a growing set of reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sigwright.operators import packed
from sigwright.operators.count import few_kmers, oriented_keys
from sigwright.operators.estimate import key_classes, sparse_maximisation
from sigwright.operators.kmers import read_kmers
from sigwright.options import EstimateOptions
from sigwright.runtime import Cut, log, remove, removed_at_exit, scratch, shared_dir
from sigwright.sources.text import significant
from sigwright.streaming.batches import BatchSink, latest


def running_counts(reads: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of a stream of reads (seq): a lookup of the fixed keys, or a join with them, then a count kept as state. If the
    keys are few, tasks count packed k-mers, and only their sums are shuffled."""
    wanted = oriented_keys(keys).select("kmer").distinct()
    few = few_kmers(wanted) if k <= packed.LONGEST else None
    if few is not None:
        chunks = packed.read_chunks(reads, k, wanted=packed.Wanted(few, k)).observe("lookups", F.coalesce(F.sum("seen"), F.lit(0)).alias("kmers"))
        hits = packed.unpacked(chunks, k).observe("found", F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
        return hits.groupBy("kmer").agg(F.sum("n").alias("n"))
    found = read_kmers(reads, k).observe("lookups", F.count(F.lit(1)).alias("kmers"))
    hits = found.join(wanted, "kmer").observe("found", F.count(F.lit(1)).alias("hits"))
    return hits.groupBy("kmer").agg(F.count("*").alias("n"))


def key_totals(keys: DataFrame, counted: DataFrame) -> DataFrame:
    """(gid, key, count) from counts of k-mers."""
    return oriented_keys(keys).join(counted, "kmer", "left").groupBy("gid", "key").agg(F.sum(F.coalesce("n", F.lit(0))).alias("count"))


class CountJob:
    """Counts a stream in micro-batches; each replaces what ``counts`` reads by the complete counts so far."""

    def __init__(self, reads: DataFrame, keys: DataFrame, k: int, interval: str | None = None):
        """interval: time between batches ("11 seconds"); without one, what is there is read and the job ends."""
        self.spark, self.keys, self.batches = keys.sparkSession, keys, 0
        self.latest: DataFrame | None = None
        self.written: list[str] = []
        self.folder = f"{shared_dir(self.spark)}/stream-{uuid.uuid4().hex}"
        writer = running_counts(reads, keys, k).writeStream.outputMode("complete").option("checkpointLocation", f"{self.folder}/state").foreachBatch(self._keep)
        self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

    def _keep(self, batch: DataFrame, number: int) -> None:
        path = f"{self.folder}/counts-{number}"
        batch.write.mode("overwrite").parquet(path)
        self.latest = self.spark.read.schema(batch.schema).parquet(path)
        if not self.batches:
            removed_at_exit(self.spark, self.folder)
        self.batches += 1
        log.info("batch %d of %s", number, self.folder)
        self.after_batch()
        # whoever has asked for counts may still read the batch before this one
        self.written.append(path)
        for old in self.written[:-2]:
            remove(self.spark, old)
        self.written = self.written[-2:]

    def after_batch(self) -> None:
        """For jobs that do more."""

    def counts(self) -> DataFrame:
        """(gid, key, count) of every key so far."""
        nothing = self.spark.createDataFrame([], "kmer string, n long")
        return key_totals(self.keys, self.latest if self.latest is not None else nothing)

    def finish(self, timeout: int | None = None) -> DataFrame:
        """Waits for the end of the stream and gives the final counts. Raises TimeoutError if the stream has not ended
        after ``timeout`` seconds: counts so far are no final ones."""
        if self.query.awaitTermination(timeout) is False:
            raise TimeoutError(f"the stream has not ended after {timeout} seconds")
        return self.counts()


def key_hits(reads: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """(gid, class, n) of a stream of reads: how often keys of a class occur. targets: (kmer, gid, class).

    Tasks count packed k-mers, only the wanted ones if these are few, and their sums meet the targets. Hits are summed in each
    task before they are sent to their gene, so a gene with most of all hits is a few rows a task.
    """

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["gid", "class"]).aggregate([("n", "sum")]).rename_columns(["gid", "class", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(summed([pa.Table.from_batches([batch])]))
            size += len(held[-1])
            if size > 1 << 18:
                held = [summed(held)]
                if (size := len(held[0])) > 1 << 17:
                    yield from held.pop().to_batches()
                    size = 0
        if held:
            yield from summed(held).to_batches()

    if k <= packed.LONGEST:
        few = few_kmers(targets.select("kmer").distinct())
        counted = packed.unpacked(packed.read_chunks(reads, k, wanted=None if few is None else packed.Wanted(few, k)), k)
    else:
        counted = read_kmers(reads, k).select("kmer", F.lit(1).cast("long").alias("n"))
    return counted.join(targets, "kmer").select("gid", "class", "n").mapInArrow(count, "gid string, class string, n long")


#: What is known of a gene: the classes of its keys, once, and counts and shares, after each batch with a hit.
_CLASSES = "n int, names array<string>, tidx binary, weight binary, owner binary, occurrences binary"
ESTIMATES = "gid string, tidx int, n_reads_kmers double, density double, share double, rounds long"


class GeneEstimator(StatefulProcessor):
    """Keeps the counts of a gene's classes as state and estimates the gene whenever a batch has hits of it, beginning from
    the shares of its last estimate."""

    def __init__(self, options: EstimateOptions, rounds: int | None):
        self.options, self.rounds = options, rounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.classes = handle.getValueState("classes", _CLASSES)
        self.counts = handle.getValueState("counts", "counts binary, share binary")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        entries = [x["entries"] for x in initialState.classes]
        flat = [e for x in entries for e in x]
        arrays = (np.array([e["tidx"] for e in flat], np.int32), np.array([e["weight"] for e in flat], np.int32), np.repeat(np.arange(len(entries)), [len(x) for x in entries]).astype(np.int32), np.array([x["occurrences"] for x in initialState.classes], np.int64))
        self.classes.update((initialState.n, [x["class"] for x in initialState.classes], *(x.tobytes() for x in arrays)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, names, tidx, weight, owner, occurrences = self.classes.get()
        place = {name: i for i, name in enumerate(names)}
        counts, share = np.zeros(len(names), np.int64), np.zeros(n)
        if self.counts.exists():
            raw, last = self.counts.get()
            counts, share = np.frombuffer(bytes(raw), np.int64).copy(), np.frombuffer(bytes(last))
        for row in rows:
            counts[place[row["class"]]] += row.n
        tidx, weight, owner = (np.frombuffer(bytes(x), np.int32) for x in (tidx, weight, owner))
        begin = share if share.sum() > 0 else None
        density, share, size, done = sparse_maximisation(tidx, weight.astype(float), owner, counts.astype(float), np.frombuffer(bytes(occurrences), np.int64).astype(float), n, begin, self.options, self.rounds)
        self.counts.update((counts.tobytes(), share.tobytes()))
        for i in range(n):
            yield Row(gid=key[0], tidx=i, n_reads_kmers=float(density[i] * size[i]), density=float(density[i]), share=float(share[i]), rounds=done)

    def close(self) -> None:
        pass


class EstimateJob:
    """Estimates of genes that follow a stream of reads. Counts and shares are keyed state: a batch estimates the genes that
    it has hits of, and no others.

    Each batch's estimates go to ``folder``, by a sink that commits by number of the batch; so does, with ``report``,
    the profile of the batch's transcripts as tab-separated text. A job with the folder of a job before it goes on
    where that one ended; it must have the same keys and places.
    """

    def __init__(
        self, reads: DataFrame, keys: DataFrame, positions: DataFrame, transcripts: DataFrame, options: EstimateOptions, interval: str | None = "11 seconds", report: str | None = None, rounds: int | None = None, folder: str | None = None
    ):
        """interval: time between batches; without one, what is there is read and the job ends. rounds: of each estimate,
        instead of as many as it takes to settle."""
        spark = self.spark = keys.sparkSession
        self.folder = folder or scratch(spark, "estimates")
        self.lengths = transcripts.select("gid", "tidx", "tid", F.char_length("seq").alias("length"))
        classed = Cut(key_classes(keys, positions), "key-classes").df
        # one row for each orientation of a key: palindromes count for each equal one
        targets = Cut(oriented_keys(keys).join(classed.select("gid", "key", "class"), ["gid", "key"]).select("kmer", "gid", "class"), "targets").df
        sizes = transcripts.groupBy("gid").agg((F.max("tidx") + 1).alias("n"))
        by_class = classed.groupBy("gid", "class").agg(F.any_value("entries").alias("entries"), F.count("*").alias("occurrences"))
        known = by_class.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("class", "entries", "occurrences"))).alias("classes")).join(sizes, "gid").select("gid", "n", "classes")
        spark.dataSource.register(BatchSink)
        estimated = key_hits(reads, targets, options.k).groupBy("gid").transformWithState(GeneEstimator(options, rounds), ESTIMATES, "Append", "None", initialState=known.groupBy("gid"))
        named = estimated.join(self.lengths, ["gid", "tidx"])
        value = F.col("density") * F.col("length")
        line = F.concat_ws("\t", "tid", significant(value), significant(F.col("density")))
        rows = named.select("gid", "tidx", "tid", "n_reads_kmers", "density", "share", "rounds", value.alias("value"), line.alias("line"))
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(provider)
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            writer = rows.writeStream.format("batches").outputMode("append").option("checkpointLocation", f"{self.folder}/state").option("path", f"{self.folder}/rows").option("report", report or "")
            self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        finally:
            spark.conf.set(provider, before)

    def finish(self, timeout: int | None = None) -> DataFrame:
        """Waits for the end of the stream and gives the final estimates. Raises TimeoutError if it has not ended after
        ``timeout`` seconds."""
        if self.query.awaitTermination(timeout) is False:
            raise TimeoutError(f"the stream has not ended after {timeout} seconds")
        return self.estimates

    @property
    def estimates(self) -> DataFrame:
        """(gid, tidx, tid, n_reads_kmers, density, share, rounds, value) of the last batch that has hits of a gene."""
        return latest(self.spark, f"{self.folder}/rows", ["gid", "tidx"], f"{ESTIMATES}, tid string, value double").drop("batch")

    def profile(self) -> DataFrame:
        """(tid, value, per_base): density times length, and the density, of estimated transcripts."""
        return self.estimates.select("tid", "value", F.col("density").alias("per_base"))

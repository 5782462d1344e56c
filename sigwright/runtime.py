"""Session helpers shared by every operator: the shared folder, durable cuts of lineage, table access."""

from __future__ import annotations

import datetime
import logging
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("sigwright")


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local run has a folder of
    its own, and anything else is an error: executors don't see each other's disks."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has a path, which must be there, removed when the driver ends; the folder of a local run too."""
    own = [] if spark.conf.get("spark.checkpoint.dir", None) else [shared_dir(spark)]
    for name in (path, *own):
        where = spark._jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def _fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; its date tells ``sweep`` how old it is."""
    return f"{shared_dir(spark)}/{name}-{datetime.date.today():%Y%m%d}-{uuid.uuid4().hex}"


def sweep(spark: SparkSession, days: int = 7) -> int:
    """Removes what sessions that ended without cleaning up have left in the shared folder ``days`` ago or earlier; returns
    how many folders went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    limit, gone = f"{datetime.date.today() - datetime.timedelta(days):%Y%m%d}", 0
    for status in files.listStatus(path) if files.exists(path) else ():
        dated = re.fullmatch(r".+-(\d{8})-[0-9a-f]{32}", status.getPath().getName())
        if dated and dated[1] <= limit:
            gone += bool(files.delete(status.getPath(), True))
    return gone


_owners: list[Owner] = []


class Owner:
    """``with Owner(): ...`` removes, at its end, all cuts that were made inside. For long sessions: run a query and write its
    result inside, and nothing of it stays in the shared folder."""

    def __init__(self):
        self.cuts: list[Cut] = []

    def __enter__(self) -> Owner:
        _owners.append(self)
        return self

    def __exit__(self, *_) -> None:
        _owners.remove(self)
        self.close()

    def keep(self, kept: Cut) -> Cut:
        """Leaves a cut that was made inside to the owner around this one, or to the session."""
        self.cuts.remove(kept)
        for outer in _owners[: _owners.index(self)][-1:]:
            outer.cuts.append(kept)
        return kept

    def close(self) -> None:
        while self.cuts:
            self.cuts.pop().drop()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    path = _fresh(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    removed_at_exit(spark, path)
    return f"{path}/data"


def made(spark: SparkSession, name: str) -> None:
    """Makes a folder unless it is there: what nothing was written to reads as no rows, not as an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


class Cut:
    """A DataFrame written as Parquet to the shared folder and read back.

    The written copy outlives lost executors and ends the lineage. ``drop`` removes it once no plan reads it
    any more; what is left goes when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str = "cut"):
        self.spark = df.sparkSession
        self.path = _fresh(self.spark, name)
        df.write.parquet(self.path)
        for owner in _owners[-1:]:
            owner.cuts.append(self)
        removed_at_exit(self.spark, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def remove(spark: SparkSession, name: str) -> None:
    """Removes a file or folder of any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut", **measures: Column) -> DataFrame:
    """``Cut`` for results that stay in use until the session ends. Aggregates in ``measures`` are taken while it is
    written, without a pass of their own, and logged."""
    if not measures:
        return Cut(df, name).df
    seen = Observation()
    made = Cut(df.observe(seen, *(m.alias(k) for k, m in measures.items())), name).df
    log.info("%s: %s", name, seen.get)
    return made


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """From now on batches of rows for Python workers have this many bytes or little more, unless the session has a bound of its
    own: Spark's bounds rows only, and a task's rows of some 10,000 bytes are one batch, held several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(size))


def release_memory() -> None:
    """Gives memory that a finished Python task no longer uses back to the system: workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to: it does so when the driver collects them."""
    spark._jvm.System.gc()


class Progress(StreamingQueryListener):
    """Logs each batch of each stream: its number, rows, and what the plan observes (``DataFrame.observe``)."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = {name: row.asDict() for name, row in p.observedMetrics.items()}
        log.info("stream %s, batch %d: %d rows %s", p.name or p.id, p.batchId, p.numInputRows, seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended %s", event.id, event.exception or "")


def watch(spark: SparkSession) -> Progress:
    """Logs the progress of all streams of a session from now on; spark.streams.removeListener ends it."""
    listener = Progress()
    spark.streams.addListener(listener)
    return listener

"""Text formats: FASTA and FASTQ reads, gene records, genomes, GTF annotations, and the writers of reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.functions import dna
from sigwright.operators.ranges import prefix_sums
from sigwright.runtime import Cut, shuffle_partitions, small_batches

#: Transcripts of a gene that are one row on the way into its record; bytes of records in a batch, but for the last one.
PIECE, BATCH = 64, 1 << 22

Paths = str | list[str]


def fasta(spark: SparkSession, paths: Paths, least: int = 3) -> DataFrame:
    """(header, seq) of one-line records with ``least`` bases or more; splittable.

    Each record is read once, also one at the end of a file. Shorter records are left out and end nothing.
    """
    rows = spark.read.option("lineSep", ">").text(paths)
    parts = F.split(F.trim(F.regexp_replace("value", "\\s+\\z", "")), "\\s+")
    return rows.select(F.get(parts, F.lit(0)).alias("header"), F.get(parts, F.lit(1)).alias("seq")).filter(F.char_length("seq") >= least)


def uneven_records(spark: SparkSession, paths: Paths) -> DataFrame:
    """(gid, n_ids, n_seqs) of multi-transcript records that have more or fewer ids than sequences: what ``genes`` raises for."""
    ids, seqs = dna.split_record(F.col("header")), dna.split_record(F.col("seq"))
    return fasta(spark, paths).select(F.get(ids, F.lit(0)).alias("gid"), (F.size(ids) - 1).alias("n_ids"), F.size(seqs).alias("n_seqs")).filter("n_ids <> n_seqs")


def genes(spark: SparkSession, paths: Paths) -> DataFrame:
    """(idx, gid, tids, seqs) of multi-transcript records ``>gid|tid|tid`` and ``seq|seq``.

    idx orders records by file and place. Raises if a record has more or fewer ids than sequences. A record is one row: for
    large ones there is gene_transcripts.
    """
    ids, seqs = dna.split_record(F.col("header")), dna.split_record(F.col("seq"))
    rows = fasta(spark, paths).withColumn("idx", F.monotonically_increasing_id())
    rows = rows.select("idx", F.get(ids, F.lit(0)).alias("gid"), F.slice(ids, 2, 1 << 30).alias("tids"), seqs.alias("seqs"))
    checked = F.when(F.size("tids") == F.size("seqs"), F.col("seqs")).otherwise(F.raise_error(F.concat(F.lit("ids and sequences differ in number: "), "gid")).cast("array<string>"))
    return rows.withColumn("seqs", checked)


def transcripts(genes: DataFrame) -> DataFrame:
    """(gid, tidx, tid, seq) of gene records."""
    each = F.posexplode(F.arrays_zip("tids", "seqs")).alias("tidx", "t")
    return genes.select("gid", each).select("gid", "tidx", F.col("t.tids").alias("tid"), F.col("t.seqs").alias("seq"))


def gene_transcripts(spark: SparkSession, paths: Paths, least: int = 3) -> DataFrame:
    """(gid, tidx, tid, seq): what ``transcripts`` makes of ``genes``, for records of any size.

    Files are read from ``|`` to ``|`` wherever Spark splits them; no row ever holds a record. A piece's record, line and
    place there are what its part of the file has before it, and what the parts before have left open: of the parts only a
    row each is gathered. Ids meet sequences by their places.
    """
    at = F.monotonically_increasing_id()
    # the path is long, and each piece has it
    pieces = spark.read.option("lineSep", "|").text(paths).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")).withColumn("at", at)
    token = lambda text, opens, breaks: F.struct(text.alias("text"), opens.cast("int").alias("opens"), breaks.cast("int").alias("breaks"))
    words = lambda s, i: F.transform(F.split(F.when(i > 0, F.ltrim(s)).otherwise(s), "\\s+"), lambda x, j: token(x, (i > 0) & (j == 0), j > 0))
    several = F.flatten(F.transform(F.split("value", ">"), words))
    whole = F.array(token(F.col("value"), F.lit(False), F.lit(False)))
    rows = pieces.select("file", "part", "at", F.posexplode(F.when(F.col("value").rlike("[\\s>]"), several).otherwise(whole)).alias("n", "t")).select("file", "part", "at", "n", "t.*")
    in_part = Window.partitionBy("file", "part").orderBy("at", "n")
    rows = rows.withColumns({"i": F.row_number().over(in_part).cast("long"), "record": F.sum("opens").over(in_part), "line": F.sum("breaks").over(in_part)})
    # where the last line, and the last record, has begun in this part of the file
    rows = rows.withColumns({"line_at": F.max(F.when(F.col("opens") + F.col("breaks") > 0, F.col("i"))).over(in_part), "record_at": F.max(F.when(F.col("opens") > 0, F.col("line"))).over(in_part)})
    rows = Cut(rows.select("file", "part", "text", "i", "record", "line", "line_at", "record_at"), "gene-pieces").df

    parts = rows.groupBy("file", "part").agg(*(F.max(c).alias(c) for c in ("i", "record", "line", "line_at", "record_at")))
    in_file = Window.partitionBy("file").orderBy("part")
    # a run: the part that has the last beginning so far, and those behind it that have none
    parts = parts.withColumns({"line_run": F.count("line_at").over(in_file), "record_run": F.count("record_at").over(in_file), "records": F.sum("record").over(in_file)})
    places = F.sum(F.col("i") - F.coalesce("line_at", F.lit(0))).over(Window.partitionBy("file", "line_run").orderBy("part"))
    lines = F.sum(F.col("line") - F.coalesce("record_at", F.lit(0))).over(Window.partitionBy("file", "record_run").orderBy("part"))
    parts = parts.withColumns({"places": places - F.when(F.col("line_run") == 0, 1).otherwise(0), "lines": lines})
    before = lambda c, none: F.lag(c, 1, none).over(in_file)
    carried = parts.select("file", "part", before("records", 0).alias("records"), before("places", -1).alias("places"), before("lines", 0).alias("lines"))
    line = F.col("line") - F.coalesce("record_at", -F.col("lines"))
    place = F.col("i") - F.coalesce("line_at", -F.col("places"))
    placed = rows.join(F.broadcast(carried), ["file", "part"]).select("file", (F.col("record") + F.col("records")).alias("record"), line.alias("line"), place.alias("place"), "text").filter("line < 2")

    # one empty part at the end of a line is dropped
    size = lambda n: F.count_if(F.col("line") == n)
    left = lambda n: size(n) - F.when(F.max(F.when((F.col("line") == n) & (F.col("text") == ""), F.col("place"))) == size(n) - 1, 1).otherwise(0)
    length = F.sum(F.when(F.col("line") == 1, F.char_length("text"))) + size(1) - 1
    sizes = placed.groupBy("file", "record").agg(left(0).alias("head"), left(1).alias("n_seqs"), length.alias("length")).filter(F.col("length") >= least)
    names = placed.filter("line = 0 AND place = 0").select("file", "record", F.col("text").alias("gid"))
    gid = F.when(F.col("head") > 0, F.col("gid"))
    uneven = F.raise_error(F.concat(F.lit("ids and sequences differ in number: "), F.coalesce(gid, F.lit("")))).cast("string")
    records = sizes.join(names, ["file", "record"]).select("file", "record", "n_seqs", F.when(F.greatest(F.col("head") - 1, F.lit(0)) == F.col("n_seqs"), gid).otherwise(uneven).alias("gid"))
    seqs = placed.filter("line = 1").select("file", "record", "place", F.col("text").alias("seq")).join(records, ["file", "record"]).filter("place < n_seqs")
    ids = placed.filter("line = 0 AND place > 0").select("file", "record", (F.col("place") - 1).alias("place"), F.col("text").alias("tid"))
    return seqs.join(ids, ["file", "record", "place"], "left").select("gid", F.col("place").cast("int").alias("tidx"), "tid", "seq")


def numbered_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path, number, value) of the lines of files, numbered from 0 in each file; files are split like any text.

    Lines are counted in each block of a file first. Numbers inside a block follow the order in which a task reads
    it; of blocks only their counts are gathered.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", at)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n") - F.col("least")
    return lines.join(blocks.select("path", "block", before.alias("shift")), ["path", "block"]).select("path", (F.col("at") + F.col("shift")).alias("number"), "value")


def reads(spark: SparkSession, first: Paths, second: Paths | None = None, fastq: bool = False) -> DataFrame:
    """(mate, seq) of single or paired reads, any number of files a mate; ids and qualities are not read."""

    def mate(paths: Paths, number: int) -> DataFrame:
        if fastq:
            seqs = numbered_lines(spark, paths).filter(F.col("number") % 4 == 1).select(F.regexp_replace("value", "\r$", "").alias("seq"))
        else:
            seqs = fasta(spark, paths, least=1).select("seq")
        return seqs.filter("seq <> ''").select(F.lit(number).cast("tinyint").alias("mate"), "seq")

    one = mate(first, 1)
    return one if second is None else one.unionByName(mate(second, 2))


def fastq(spark: SparkSession, paths: Paths) -> DataFrame:
    """(path, record, seq, quality) of FASTQ records, from 0 in each file. Lines of a record meet by its number, as files are
    split anywhere; readers that need no qualities use ``reads``, which moves nothing."""
    lines = numbered_lines(spark, paths).filter(F.col("number") % 2 == 1)
    line = lambda n: F.max(F.when(F.col("number") % 4 == n, F.regexp_replace("value", "\r$", "")))
    return lines.groupBy("path", F.floor(F.col("number") / 4).alias("record")).agg(line(1).alias("seq"), line(3).alias("quality"))


def weighed(records: DataFrame, weigh: Callable[[Column, Column], Column]) -> DataFrame:
    """records (seq, quality, ...) with the weight that weigh(seq, quality) gives each; a null weight, or one of 0 or less,
    drops the read. weigh may be made of column functions or be a pandas UDF."""
    return records.withColumn("weight", weigh(F.col("seq"), F.col("quality"))).filter("weight > 0")


def genome(spark: SparkSession, paths: Paths) -> DataFrame:
    """(seqname, seq) of chromosomes, whose lines may be many; named by the header up to its first blank. A chromosome is
    one row: for large ones there is genome_blocks."""
    rows = spark.read.option("lineSep", ">").text(paths).filter(F.trim("value") != "")
    head = F.regexp_extract("value", "\\A([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", "\\A[^\r\n]*", ""), "\\s+", "")
    return rows.select(dna.chromosome_name(head).alias("seqname"), body.alias("seq"))


def genome_blocks(spark: SparkSession, paths: Paths, size: int = 1 << 16) -> DataFrame:
    """(seqname, block, bases): each chromosome in blocks of ``size`` bases, from 0, the last one shorter. A chromosome
    without bases has an empty block 0.

    Files are read line by line wherever Spark splits them; no row ever holds a chromosome. A line's place is the
    bases before it in its part of the file, and what the parts before have left of its chromosome: of the parts
    only a row each is gathered.
    """
    at = F.monotonically_increasing_id()
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part")).withColumn("at", at)
    text = F.regexp_replace("value", "\\s+", "")
    head = F.col("value").startswith(">")
    name = F.when(head, dna.chromosome_name(F.regexp_replace(F.substr("value", F.lit(2)), "\r$", "")))
    rows = lines.select("path", "part", "at", name.alias("name"), F.when(head, "").otherwise(text).alias("bases"))
    in_part = Window.partitionBy("path", "part").orderBy("at")
    rows = rows.withColumn("section", F.count("name").over(in_part))
    in_section = Window.partitionBy("path", "part", "section").orderBy("at")
    size_of = F.char_length("bases").cast("long")
    rows = rows.withColumns({"name": F.first("name").over(in_section), "before": F.sum(size_of).over(in_section) - size_of})
    sections = rows.groupBy("path", "part", "section").agg(F.max("name").alias("name"), F.sum(size_of).alias("n"))
    parts = sections.groupBy("path", "part").agg(F.max(F.struct("section", "name", "n")).alias("last"))
    in_file = Window.partitionBy("path").orderBy("part")
    # a run: the part that has the last header so far, and those behind it that have none
    parts = parts.withColumns({"run": F.count("last.name").over(in_file), "so_far": F.last("last.name", ignorenulls=True).over(in_file)})
    parts = parts.withColumn("bases_so_far", F.sum("last.n").over(Window.partitionBy("path", "run").orderBy("part")))
    carried = parts.select("path", "part", F.lag("so_far").over(in_file).alias("from_name"), F.lag("bases_so_far").over(in_file).alias("from_bases"))
    placed = rows.join(carried, ["path", "part"]).select(
        F.coalesce("name", "from_name").alias("seqname"), (F.col("before") + F.when(F.col("name").isNull(), F.col("from_bases")).otherwise(0)).alias("offset"), "bases"
    ).filter("seqname IS NOT NULL")
    last = F.col("offset") + F.greatest(F.char_length("bases"), F.lit(1)) - 1
    each = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor(last / size))))
    begin = F.greatest(F.col("offset"), F.col("block") * size)
    end = F.least(F.col("offset") + F.char_length("bases"), (F.col("block") + 1) * size)
    piece = F.substr("bases", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    pieces = each.select("seqname", "block", begin.alias("begin"), piece.alias("piece")).filter("piece <> '' OR begin = 0")
    return pieces.groupBy("seqname", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "piece"))), lambda x: x["piece"]), "").alias("bases"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Rows of GTF from (line, value): the nine columns, gid, gname, tid, tname and biotype.

    Comments and lines with another number of columns are left out; a place that is no number is null. Names
    default to ids.
    """
    parts = F.split(F.rtrim("value", F.lit(" \t\n\v\f\r")), "\t")
    # parts and values are exploded, though of one row each: filters stay behind, so none cuts or reads a line again
    rows = lines.select("line", F.explode(F.array(parts)).alias("p")).filter((F.size("p") == 9) & ~F.get("p", F.lit(0)).startswith("#"))
    p = [F.get("p", F.lit(i)) for i in range(9)]
    names = {"gid": "gene_id", "gname": "gene_name", "tid": "transcript_id", "tname": "transcript_name", "biotype": "gene_biotype"}
    values = F.struct(*(dna.gtf_value(F.col("items"), name).alias(c) for c, name in names.items()))
    rows = rows.select("line", "p", dna.gtf_items(p[8]).alias("items")).select("line", "p", F.explode(F.array(values)).alias("v"))
    return rows.select(
        "line", p[0].alias("seqname"), p[1].alias("source"), p[2].alias("feature"), p[3].try_cast("int").alias("start"), p[4].try_cast("int").alias("end"), p[5].alias("score"), p[6].alias("strand"), p[7].alias("frame"), p[8].alias("extra"),
        "v.gid", F.coalesce("v.gname", "v.gid").alias("gname"), "v.tid", F.coalesce("v.tname", "v.tid").alias("tname"), "v.biotype",
    )


def on_main_chromosome(seqname: Column) -> Column:
    """Whether a sequence is a chromosome with a number, X, Y or the mitochondrion (names may go on after these)."""
    numbered = (seqname != "") & (F.translate(seqname, "0123456789", "") == "")
    return numbered | seqname.startswith("X") | seqname.startswith("Y") | seqname.startswith("MT")


def gtf(spark: SparkSession, paths: Paths, main_chromosomes: bool = False) -> DataFrame:
    """parse_gtf of files, plain or gzipped; on request only rows on_main_chromosome."""
    rows = parse_gtf(spark.read.text(paths).select(F.monotonically_increasing_id().alias("line"), "value"))
    return rows.filter(on_main_chromosome(F.col("seqname"))) if main_chromosomes else rows


def write_genome(chromosomes: DataFrame, path: str, width: int = 60) -> None:
    """FASTA of (seqname, seq) with lines of a width."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    chromosomes.select(F.concat(F.lit(">"), "seqname", F.lit("\n"), lines).alias("value")).write.text(path)


def _in_order(transcripts: DataFrame) -> DataFrame:
    """(gid, line, text): ids (line 0) and sequences (line 1) of genes, joined by PIECE; a task has genes one after the other, of
    each its pieces in order. Where a piece has neither, text is null."""
    small_batches(transcripts.sparkSession)
    of_piece = F.array_sort(F.collect_list(F.struct("tidx", "tid", "seq")))
    rows = transcripts.groupBy("gid", F.floor(F.col("tidx") / PIECE).alias("piece")).agg(of_piece.alias("t"))
    some = lambda c: F.filter(F.transform("t", lambda x: x[c]), lambda x: x.isNotNull())
    joined = lambda n, c: F.struct(F.lit(n).alias("line"), F.when(F.size(some(c)) > 0, F.array_join(some(c), "|")).alias("text"))
    rows = rows.select("gid", "piece", F.explode(F.array(joined(0, "tid"), joined(1, "seq"))).alias("l")).select("gid", "l.line", "piece", "l.text")
    return rows.repartition("gid").sortWithinPartitions("gid", "line", "piece").select("gid", "line", "text")


def _glued(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None, str]]:
    """(gid, what stands before it, text) of what records are made of, from _in_order; before a record's first text stands None."""
    now, between, bare = None, "", False
    for batch in batches:
        for gid, line, text in zip(*(batch[c].to_pylist() for c in ("gid", "line", "text")), strict=True):
            if now != (gid, line):
                if line == 0:
                    yield gid, None, ">" + (gid or "")
                    between, bare = "" if gid is None else "|", True
                else:
                    if bare:
                        yield gid, between, ""
                    yield gid, "\n", ""
                    between = ""
                now = gid, line
            if text is not None:
                yield gid, between, text
                between, bare = "|", False


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, value) of whole records. Each byte is held once."""
    gids, ends, held = [], [0], bytearray()

    def out() -> pa.RecordBatch:
        nonlocal gids, ends, held
        values = pa.StringArray.from_buffers(len(gids), pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(held))
        batch = pa.RecordBatch.from_arrays([pa.array(gids, pa.string()), values], names=["gid", "value"])
        gids, ends, held = [], [0], bytearray()
        return batch

    for gid, before, text in _glued(batches):
        if before is None:
            if gids:
                ends.append(len(held))
                if len(held) >= BATCH:
                    yield out()
            gids.append(gid)
        held += (before or "").encode()
        held += text.encode()
        if len(held) >= 1 << 31:
            raise OverflowError(f"the record of {gid} has 2 GB or more, which no row can hold: see write_genes")
    if gids:
        ends.append(len(held))
        yield out()


def _between_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of a file of records, cut at some of its ``|``."""
    held, size, now, any_record = [], 0, "", False
    for _, before, text in _glued(batches):
        if before == "|":
            held.append(now)
            size += len(now)
            now = text
        else:
            now += ("\n" if any_record else "") + text if before is None else before + text
        any_record = True
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
            held, size = [], 0
    if any_record:
        yield pa.RecordBatch.from_arrays([pa.array([*held, now + "\n"], pa.string())], names=["value"])


def gene_records(transcripts: DataFrame) -> DataFrame:
    """(gid, value): each gene's record of two lines, transcripts by tidx.

    Tasks put a record together as bytes; no list of its transcripts is gathered. Behind them records move once more:
    a row from a worker has a buffer of twice its size, in which the worker's batch is held beside it, one from a shuffle has its own size."""
    whole = _in_order(transcripts).mapInArrow(_records, "gid string, value string")
    # up to 200 parts a shuffle writes rows as they come and sorts none
    return whole.repartition(min(200, shuffle_partitions(transcripts.sparkSession)), "gid")


def write_genes(transcripts: DataFrame, path: str) -> None:
    """Files of gene_records, written in pieces: no row holds a record. A file ends with a ``|`` on a line of its own, which
    readers take for a comment of its last record."""
    _in_order(transcripts).mapInArrow(_between_bars, "value string").write.option("lineSep", "|").text(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.select(F.concat(F.lit(">"), "tid", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_overlaps(pairs: DataFrame, path: str) -> None:
    """gid1, gid2, dup, total, tab-separated."""
    pairs.select("gid1", "gid2", "dup", "total").write.csv(path, sep="\t")


def read_overlaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="gid1 string, gid2 string, dup long, total long")


def significant(number: Column) -> Column:
    """A number with six significant digits and without zeros behind them: plain from 0.0001 to below a million, else
    with an exponent."""
    text = F.format_string("%.6g", number)
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+($|e)", "$1$2"), "\\.($|e)", "$1")


def abundance_lines(rows: DataFrame) -> DataFrame:
    """(value): tid, length, reads, RPKM and TPM, tab-separated, in order of tid."""
    numbers = [significant(F.col(c)) for c in ("est_reads", "rpkm", "tpm")]
    return rows.orderBy("tid").select(F.concat_ws("\t", "tid", F.col("length").cast("string"), *numbers).alias("value"))


def write_abundance(rows: DataFrame, path: str) -> None:
    abundance_lines(rows).write.text(path)


def numbered_genes(transcripts: DataFrame) -> DataFrame:
    """(idx, gid) by order of gid, for gene tables that come from no file."""
    ids = transcripts.select("gid").distinct()
    return prefix_sums(ids, [F.col("gid")], {"idx": F.lit(1).cast("long")}).select("idx", "gid")

"""A sink for streams that keeps each batch's rows under the batch's number."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from sigwright.sources.framed import _located

#: Where files lie until their batch is committed; batches follow each other, so it is cleared with each.
STAGE = "_staged"
#: Rows of one row group.
GROUP_ROWS = 50_000


class BatchSink(DataSource):
    """writeStream.format("batches"): Parquet below path/batch=N. With ``report``, a folder, the column ``line`` is written
    there too, as text below batch=N."""

    @classmethod
    def name(cls) -> str:
        return "batches"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return BatchWriter(self.options["path"], self.options.get("report") or None, schema)


@dataclass
class Staged(WriterCommitMessage):
    name: str | None


class BatchWriter(DataSourceStreamWriter):
    """Each attempt of a task writes a file of its own aside. Commit moves the files of the attempts that count into the
    folder of the batch, in place of what a first try of the same batch has left there."""

    def __init__(self, path: str, report: str | None, schema):
        self.path, self.report, self.schema = path.rstrip("/"), report and report.rstrip("/"), schema

    def _targets(self) -> list[str]:
        return [self.path] + ([self.report] if self.report else [])

    def write(self, iterator) -> WriterCommitMessage:
        kind = to_arrow_schema(self.schema)
        name, files, rows, lines, out = uuid.uuid4().hex, None, [], None, None

        def flush() -> None:
            out.write_table(pa.Table.from_pylist(rows, kind))
            if lines:
                lines.write("".join(f"{r['line']}\n" for r in rows).encode())
            rows.clear()

        for row in iterator:
            if files is None:
                for target in self._targets():
                    files, where = _located(target)
                    files.create_dir(f"{where}/{STAGE}", recursive=True)
                files, where = _located(self.path)
                out = pq.ParquetWriter(f"{where}/{STAGE}/{name}.parquet", kind, filesystem=files)
                if self.report:
                    other, there = _located(self.report)
                    lines = other.open_output_stream(f"{there}/{STAGE}/{name}.txt")
            rows.append(row.asDict())
            if len(rows) >= GROUP_ROWS:
                flush()
        if files is None:
            return Staged(None)
        flush()
        out.close()
        if lines:
            lines.close()
        return Staged(name)

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs

        names = [m.name for m in messages if m is not None and m.name]
        for target, ending in zip(self._targets(), ("parquet", "txt"), strict=False):
            files, where = _located(target)
            place = f"{where}/batch={batchId}"
            if files.get_file_info(place).type != fs.FileType.NotFound:
                files.delete_dir(place)
            if names:
                files.create_dir(place, recursive=True)
            for name in names:
                files.move(f"{where}/{STAGE}/{name}.{ending}", f"{place}/{name}.{ending}")
        self._clear()

    def abort(self, messages, batchId: int) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        for target in self._targets():
            files, where = _located(target)
            if files.get_file_info(f"{where}/{STAGE}").type != fs.FileType.NotFound:
                files.delete_dir(f"{where}/{STAGE}")


def latest(spark: SparkSession, path: str, key: list[str], schema: str) -> DataFrame:
    """The rows of all batches below path, of each key those of its last batch; no row where there is no batch yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    last = F.max_by(F.struct(*(F.col(c) for c in rows.columns if c not in key)), "batch").alias("r")
    return rows.groupBy(*key).agg(last).select(*key, "r.*")

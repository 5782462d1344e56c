"""Length-prefixed messages: a 4-byte little-endian size before each protobuf message, as a Spark data source.

``register(spark)`` makes the format ``framed``. Rows hold the encoded message in ``body``; ``decoded`` and
``encoded`` turn bodies into columns and back. Files are reached through pyarrow's file systems (local, HDFS, S3
and what else has a URI there); ``read_binary`` reads whatever Spark itself reads.

A frame tells nothing of where another one begins, so a file alone can't be split. Beside each larger file lies an index
of places at which frames begin; the parts between them are tasks of their own. Saving writes it, ``add_indexes`` makes it for
files that come from elsewhere.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sigwright.runtime import Cut

#: Messages: field name, number, type ("*" repeated, capital: another message). Fixed values of the format.
MESSAGES = {
    "Variant": (("abs_pos", 1, "int32"), ("rel_pos", 2, "int32"), ("ref_chr", 3, "string"), ("all_chr", 4, "string")),
    "Exon": (("start", 1, "int32"), ("end", 2, "int32"), ("seq", 3, "string"), ("variants", 9, "*Variant")),
    "Transcript": (("id", 1, "string"), ("seq", 2, "string"), ("exons", 3, "*Exon"), ("name", 4, "string"), ("variants", 5, "*Variant")),
    "Gene": (("id", 1, "string"), ("name", 2, "string"), ("transcripts", 3, "*Transcript"), ("seqname", 4, "string"), ("biotype", 5, "string"), ("strand", 6, "string"), ("source", 7, "string"), ("has_seq", 8, "bool")),
    "SignatureMeta": (("seq", 1, "string"), ("position", 2, "int32")),
    "TranscriptSignatures": (("id", 1, "string"), ("length", 2, "int32"), ("signatures", 3, "*SignatureMeta")),
    "GeneSignatures": (("id", 1, "string"), ("transcripts", 2, "*TranscriptSignatures")),
    "TranscriptInfo": (("tidx", 1, "int32"), ("positions", 2, "*int32")),
    "Key": (("key", 2, "string"), ("transcript_infos", 3, "*TranscriptInfo"), ("count", 4, "int32")),
    "SelectedKey": (("gid", 1, "string"), ("keys", 2, "*Key"), ("tids", 3, "*string"), ("lengths", 4, "*int32")),
}
_SQL = {"int32": "int", "string": "string", "bool": "boolean"}


def sql_type(message: str) -> str:
    """The Spark type of a message, as a DDL string."""

    def of(kind: str) -> str:
        if kind.startswith("*"):
            return f"array<{of(kind[1:])}>"
        return _SQL.get(kind) or sql_type(kind)

    return "struct<" + ", ".join(f"`{name}`: {of(kind)}" for name, _, kind in MESSAGES[message]) + ">"


def arrow_type(message: str) -> pa.StructType:
    """The Arrow type of a message."""
    plain = {"int32": pa.int32(), "string": pa.string(), "bool": pa.bool_()}

    def of(kind: str) -> pa.DataType:
        if kind.startswith("*"):
            return pa.list_(of(kind[1:]))
        return plain[kind] if kind in plain else arrow_type(kind)

    return pa.struct([(name, of(kind)) for name, _, kind in MESSAGES[message]])


@functools.cache
def message_class(message: str):
    """The protobuf class of a message, made once in a process."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    proto = descriptor_pb2.FileDescriptorProto(name="sigwright_framed.proto", package="sigwright", syntax="proto2")
    kinds = descriptor_pb2.FieldDescriptorProto
    for name, fields in MESSAGES.items():
        m = proto.message_type.add(name=name)
        for field, number, kind in fields:
            base = kind.removeprefix("*")
            f = m.field.add(name=field, number=number, label=kinds.LABEL_REPEATED if kind.startswith("*") else kinds.LABEL_OPTIONAL)
            if base in MESSAGES:
                f.type, f.type_name = kinds.TYPE_MESSAGE, f".sigwright.{base}"
            else:
                f.type = {"int32": kinds.TYPE_INT32, "string": kinds.TYPE_STRING, "bool": kinds.TYPE_BOOL}[base]
    pool = descriptor_pool.DescriptorPool()
    pool.Add(proto)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"sigwright.{message}"))


class Damaged(ValueError):
    """A frame that is cut off, has a negative size, or is above the limit."""


def frames(data: bytes, limit: int | None = None, damaged: str = "raise") -> Iterator[bytes]:
    """Bodies of framed messages. A frame that is cut off or above the limit raises Damaged; with damaged="stop" it
    ends the messages."""
    import io

    return _frames(io.BytesIO(data), limit, damaged)


def _frames(file, limit: int | None, damaged: str, until: int | None = None) -> Iterator[bytes]:
    while (until is None or file.tell() < until) and (head := file.read(4)):
        size = struct.unpack("<i", head)[0] if len(head) == 4 else -1
        body = file.read(size) if size >= 0 and (limit is None or size <= limit) else b""
        if size < 0 or len(body) < size:
            if damaged == "stop":
                return
            raise Damaged(f"a frame of {size} bytes can't be read" if len(head) == 4 else "a frame is cut off in its size")
        yield body


def framed(bodies) -> bytes:
    return b"".join(struct.pack("<i", len(b)) + bytes(b) for b in bodies)


def _located(path: str):
    """(file system, path on it) of a URI or local path."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


#: Bytes of the parts that a file is read in, at least.
SPAN = 32 << 20


def _index_of(path: str) -> str:
    """The place of a file's index; Spark's readers pass over names like this."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/_{name}.index"


def _write_index(files, path: str, size: int, starts: list[int]) -> None:
    with files.open_output_stream(_index_of(path)) as f:
        f.write(struct.pack(f"<{len(starts) + 1}q", size, *starts))


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a framed file or of those in a folder."""
    from pyarrow import fs

    files, where = _located(path)
    info = files.get_file_info(where)
    if info.type != fs.FileType.Directory:
        return [(where, info.size)]
    return sorted((x.path, x.size) for x in files.get_file_info(fs.FileSelector(where)) if x.path.endswith(".framed"))


class FramedSource(DataSource):
    """format("framed"): load(path) gives (path, body); save(path) writes one file a task. Options: limit, the bytes
    of the longest message; damaged, raise (the default) or stop; span, the bytes of a part, when saving; single, to save each
    message as a file without a size before it."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "path string, body binary"

    def reader(self, schema) -> DataSourceReader:
        return FramedReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FramedWriter(self.options["path"], overwrite, int(self.options.get("span", SPAN)), self.options.get("single", "false") == "true")


@dataclass
class Part(InputPartition):
    """Frames of a file that begin from start on and before end; the whole file where end is None."""

    path: str
    start: int = 0
    end: int | None = None

    def __post_init__(self):
        self.value = self.path


class FramedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.damaged = options.get("damaged", "raise")

    def partitions(self):
        from pyarrow import fs

        files, _ = _located(self.path)
        out = []
        for path, size in _listed(self.path):
            starts = None
            if size >= 8 and files.get_file_info(_index_of(path)).type == fs.FileType.File:
                with files.open_input_stream(_index_of(path)) as f:
                    raw = f.read()
                whole, *starts = struct.unpack(f"<{len(raw) // 8}q", raw)
                # an index of another state of the file says nothing
                starts = starts if whole == size else None
            out += [Part(path, a, b) for a, b in zip(starts, [*starts[1:], size], strict=True)] if starts else [Part(path)]
        return out

    def read(self, partition):
        files, _ = _located(self.path)
        if partition.end is None:
            with files.open_input_stream(partition.path) as f:
                for body in _frames(f, self.limit, self.damaged):
                    yield partition.path, body
            return
        with files.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for body in _frames(f, self.limit, self.damaged, partition.end):
                yield partition.path, body


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FramedWriter(DataSourceWriter):
    """Each attempt of a task writes a file of its own into a folder for this save; commit moves the files of the
    attempts that Spark names into place, and what else lies there goes."""

    def __init__(self, path: str, overwrite: bool, span: int = SPAN, single: bool = False):
        self.path, self.overwrite, self.stage, self.span, self.single = path.rstrip("/"), overwrite, f"_staged-{uuid.uuid4().hex}", span, single

    def write(self, rows) -> WriterCommitMessage:
        files, where = _located(self.path)
        files.create_dir(f"{where}/{self.stage}", recursive=True)
        place = lambda name: f"{where}/{self.stage}/{name}"
        if self.single:
            names = []
            for row in rows:
                names.append(f"{uuid.uuid4().hex}.message")
                with files.open_output_stream(place(names[-1])) as f:
                    f.write(bytes(row.body))
            return Written(names)
        name, at, starts = f"{uuid.uuid4().hex}.framed", 0, [0]
        with files.open_output_stream(place(name)) as f:
            for row in rows:
                if at - starts[-1] >= self.span:
                    starts.append(at)
                f.write(struct.pack("<i", len(row.body)) + bytes(row.body))
                at += 4 + len(row.body)
        if len(starts) == 1:
            return Written([name])
        _write_index(files, place(name), at, starts)
        return Written([f"_{name}.index", name])

    def commit(self, messages) -> None:
        from pyarrow import fs

        files, where = _located(self.path)
        files.create_dir(where, recursive=True)
        ours = (".framed", ".framed.index", ".message")
        before = [x.path for x in files.get_file_info(fs.FileSelector(where)) if x.path.endswith(ours)] if self.overwrite else []
        for message in messages:
            for name in message.names if message is not None else ():
                files.move(f"{where}/{self.stage}/{name}", f"{where}/{name}")
        for old in before:
            files.delete_file(old)
        self._clear(files, where)

    def abort(self, messages) -> None:
        self._clear(*_located(self.path))

    def _clear(self, files, where: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{where}/{self.stage}").type != fs.FileType.NotFound:
            files.delete_dir(f"{where}/{self.stage}")


def add_indexes(spark: SparkSession, path: str, span: int = SPAN) -> DataFrame:
    """(path, parts) of the framed files below path, each of which has an index from now on: a task a file goes from frame to
    frame and reads sizes only. A damaged frame ends the last part, for reading to find."""
    found = [(name, size) for name, size in _listed(path) if size > span]
    files = spark.createDataFrame(found, "path string, size long").repartition(max(1, len(found)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = _located(path)
                at, starts = 0, [0]
                with store.open_input_file(name) as f:
                    while at + 4 <= size:
                        f.seek(at)
                        (body,) = struct.unpack("<i", f.read(4))
                        if body < 0 or at + 4 + body > size:
                            break
                        if at - starts[-1] >= span:
                            starts.append(at)
                        at += 4 + body
                _write_index(store, name, size, starts)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(starts)], pa.int64())], names=["path", "parts"])

    return Cut(files.mapInArrow(scan, "path string, parts long"), "framed-indexes").df


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FramedSource)


def read_binary(spark: SparkSession, path: str, damaged: str = "raise") -> DataFrame:
    """(path, body) of framed files in any store that Spark reads; a file is one task and held whole."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bodies = list(frames(content.as_py(), damaged=damaged))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(bodies), pa.string()), pa.array(bodies, pa.binary())], names=["path", "body"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(split, "path string, body binary")


def read_single(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of files that each hold one message without a size before it."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))


def _mapped(rows: DataFrame, ddl: str, convert: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield convert(batch)

    return rows.mapInArrow(run, ddl)


def decoded(rows: DataFrame, message: str) -> DataFrame:
    """The columns of messages in ``body``; a null body gives nulls, one that is no such message raises."""

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = message_class(message)
        found = [_plain(kind.FromString(x.as_py()), message) if x.is_valid else {} for x in batch.column(0)]
        return pa.RecordBatch.from_struct_array(pa.array(found, arrow_type(message)))

    return _mapped(rows.select("body"), sql_type(message).removeprefix("struct<").removesuffix(">"), parse)


def encoded(rows: DataFrame, message: str) -> DataFrame:
    """(body) of rows that have the message's columns."""

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_message(row, message).SerializeToString() for row in batch.to_pylist()], pa.binary())], names=["body"])

    return _mapped(rows.select(*(name for name, _, _ in MESSAGES[message])), "body binary", build)


def _plain(value, message: str) -> dict:
    out = {}
    for name, _, kind in MESSAGES[message]:
        base, got = kind.removeprefix("*"), getattr(value, name)
        if kind.startswith("*"):
            out[name] = [_plain(x, base) if base in MESSAGES else x for x in got]
        elif base in MESSAGES:
            out[name] = _plain(got, base)
        else:
            out[name] = got if value.HasField(name) else None
    return out


def _message(row: dict, message: str):
    built = message_class(message)()

    def fill(target, values: dict, kind_name: str) -> None:
        for name, _, kind in MESSAGES[kind_name]:
            value, base = values.get(name), kind.removeprefix("*")
            if value is None:
                continue
            if kind.startswith("*"):
                for x in value:
                    if base in MESSAGES:
                        fill(getattr(target, name).add(), x, base)
                    else:
                        getattr(target, name).append(x)
            else:
                setattr(target, name, value)

    fill(built, row, message)
    return built

"""Media columns in ISO base media files (operator 8).

``mux`` writes a payload as one track of raw 8-bit gray frames; ``probe`` walks the nested boxes of any ISO
media file, decodes its sample tables and gives codec, duration and byte ranges of keyframes, without
touching the payload; ``samples`` gives the byte range of every sample, from which a payload is read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SIDE = 24
#: Bytes of a frame, SIDE * SIDE gray samples.
FRAME = SIDE * SIDE
PAD = b"\xff"
TIMESCALE = 600
FRAME_TICKS = 24
FRAMES_A_CHUNK = 16
#: Every so many frames one is marked as a place to start from.
KEY_EVERY = 12
#: Boxes that may stand around one another at most.
DEPTH = 16
#: Boxes that only hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


class BadMedia(ValueError):
    """The bytes are no readable ISO media file."""


@dataclass
class Track:
    codec: str = ""
    kind: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray | None = None

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of each keyframe; neighbours that touch make one range. Without a sync table all count."""
        at = np.arange(len(self.sizes)) if self.sync is None else self.sync[self.sync < len(self.sizes)]
        out: list[tuple[int, int]] = []
        for offset, size in zip(self.offsets[at].tolist(), self.sizes[at].tolist(), strict=True):
            if out and sum(out[-1]) == offset:
                out[-1] = (out[-1][0], out[-1][1] + size)
            else:
                out.append((offset, size))
        return out


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(*columns) -> bytes:
    """An entry count and the entries, big endian."""
    rows = np.column_stack(columns).astype(">u4")
    return struct.pack(">I", len(rows)) + rows.tobytes()


def mux(payload: bytes) -> bytes:
    """One file with the payload, a positive multiple of FRAME bytes, as raw gray frames."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    ticks = frames * FRAME_TICKS
    if frames * FRAME >= 1 << 32 or ticks >= 1 << 32:
        raise ValueError("the payload is too long for 32-bit tables")
    identity = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", struct.pack(">6xH16xHHII4xH32sHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 1, b"", 40, -1))
    starts = np.arange(0, frames, FRAMES_A_CHUNK)
    tail = frames % FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK)] * (frames >= FRAMES_A_CHUNK) + [(len(starts), tail)] * bool(tail)

    def head(at: int) -> bytes:
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", table([frames], [FRAME_TICKS])),
            full(b"stss", table(np.arange(0, frames, KEY_EVERY) + 1)),
            full(b"stsc", table([r[0] for r in runs], [r[1] for r in runs], [1] * len(runs))),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"stco", table(at + starts * FRAME)),
        )
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), full(b"hdlr", struct.pack(">4x4s12xx", b"vide")), minf)
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0, 0), identity, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, ticks, 1 << 16, 1 << 8), identity, bytes(24), struct.pack(">I", 2))
        return box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2") + box(b"moov", mvhd, box(b"trak", tkhd, mdia)) + struct.pack(">I4s", len(payload) + 8, b"mdat")

    return head(len(head(0))) + payload


def walk(data, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, start and end of the body) of every box, parents first; bodies of leaves are not read."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise BadMedia("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise BadMedia("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise BadMedia(f"box {kind!r} does not fit")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            if len(path) == DEPTH:
                raise BadMedia("boxes are nested too deeply")
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _entries(data, body: int, end: int, width: int, kind: str = ">u4", head: int = 4) -> np.ndarray:
    """The entries of a table box, behind ``head`` bytes and a count."""
    n = struct.unpack_from(">I", data, body + head)[0]
    step = width * np.dtype(kind).itemsize
    if body + head + 4 + n * step > end:
        raise BadMedia("a table is cut off")
    return np.frombuffer(data, kind, n * width, body + head + 4).reshape(n, width).astype(np.int64)


def probe(data) -> list[Track]:
    """The tracks of an ISO media file, with their sample tables decoded. Raises BadMedia; a file's own counts never
    make it allocate more than a few numbers for each byte of the file."""
    tracks: list[Track] = []
    raw: dict[str, np.ndarray] = {}
    try:
        for path, body, end in walk(data):
            kind = path[-1]
            if kind == b"trak":
                if tracks:
                    _place(tracks[-1], raw)
                tracks.append(Track())
                raw = {}
            elif not tracks or b"trak" not in path:
                continue
            elif kind == b"mdhd":
                form, at = (">IQ", body + 20) if data[body] == 1 else (">II", body + 12)
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(form, data, at)
            elif kind == b"hdlr" and path[-2] == b"mdia":
                tracks[-1].kind = bytes(data[body + 8 : body + 12]).decode("latin-1")
            elif kind == b"stsd":
                tracks[-1].codec = bytes(data[body + 12 : body + 16]).decode("latin-1")
            elif kind == b"stss":
                tracks[-1].sync = _entries(data, body, end, 1)[:, 0] - 1
                if (tracks[-1].sync < 0).any():
                    raise BadMedia("the sync table does not fit")
            elif kind == b"stsz":
                one, n = struct.unpack_from(">II", data, body + 4)
                if one * n > len(data):
                    raise BadMedia("the samples are longer than the file")
                raw["sizes"] = np.full(n, one, np.int64) if one else _entries(data, body, end, 1, head=8)[:, 0]
            elif kind == b"stts":
                raw["times"] = _entries(data, body, end, 2)
            elif kind == b"stsc":
                raw["runs"] = _entries(data, body, end, 3)
            elif kind in (b"stco", b"co64"):
                raw["chunks"] = _entries(data, body, end, 1, ">u8" if kind == b"co64" else ">u4")[:, 0]
    except (struct.error, IndexError) as e:
        raise BadMedia(str(e)) from e
    if not tracks:
        raise BadMedia("no track")
    _place(tracks[-1], raw)
    return tracks


def _place(track: Track, raw: dict[str, np.ndarray]) -> None:
    """Sample offsets from chunk offsets, samples per chunk and sizes."""
    sizes, chunks, runs = (raw.get(k, np.zeros((0, 3) if k == "runs" else 0, np.int64)) for k in ("sizes", "chunks", "runs"))
    if "times" in raw and not track.duration:
        track.duration = int((raw["times"][:, 0] * raw["times"][:, 1]).sum())
    if not len(sizes):
        return
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(chunks):
        raise BadMedia("the chunk table does not fit")
    # counts come from the file and may be anything: what is allocated has the size of a table that is there
    behind = np.cumsum(np.minimum(np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))), len(sizes)))
    if not len(behind) or behind[-1] < len(sizes):
        raise BadMedia("the chunks hold too few samples")
    if (chunks < 0).any():
        raise BadMedia("a chunk lies outside the file")
    owner = np.searchsorted(behind, np.arange(len(sizes)), "right")
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(owner, owner)
    track.sizes, track.offsets = sizes, chunks[owner] + before - before[first]


def read_back(data, track: Track) -> bytes:
    """The payload of a track, sample by sample."""
    view = memoryview(data)
    ends = track.offsets + track.sizes
    if len(ends) and ends.max() > len(view):
        raise BadMedia("a sample lies outside the file")
    breaks = np.flatnonzero(track.offsets[1:] != ends[:-1]) + 1
    first, last = np.append(0, breaks), np.append(breaks, len(ends))
    return b"".join(view[track.offsets[i] : ends[j - 1]] for i, j in zip(first, last, strict=True)) if len(ends) else b""


def feature(track: Track) -> str:
    keys = ",".join(f"{offset}+{length}" for offset, length in track.keyframes())
    return f"{track.kind}/{track.codec.strip()};{track.duration}/{track.timescale};frames={len(track.sizes)};keys={keys}"


def padded(payload: bytes) -> bytes:
    """With PAD bytes up to a positive multiple of FRAME."""
    return payload + PAD * (-len(payload) % FRAME if payload else FRAME)


#: Columns that store_texts can make.
OUTPUTS = {
    "n_bytes": (T.LongType(), pa.int64()),
    "media": (T.BinaryType(), pa.binary()),
    "payload_bytes": (T.LongType(), pa.int64()),
    "payload_sha256": (T.StringType(), pa.string()),
    "tail_crc32": (T.LongType(), pa.int64()),
    "media_bytes": (T.LongType(), pa.int64()),
    "media_sha256": (T.StringType(), pa.string()),
    "feature": (T.StringType(), pa.string()),
}


def describe_text(value: str | None) -> dict:
    """Stores a text, reads the stored bytes back and describes both. Null counts as empty."""
    payload = (value or "").encode()
    media = mux(padded(payload))
    track = probe(media)[0]
    back = read_back(media, track)
    return {
        "n_bytes": len(payload),
        "media": media,
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature(track),
    }


def store_texts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_bytes", "media", "feature")) -> DataFrame:
    """``keep`` columns of docs and any of OUTPUTS for each whole text; null counts as empty.

    Rows are independent: no shuffle, one file in memory at a time besides the Arrow batch. Repeated rows
    stay; other columns of docs are not read, whatever their names.
    """
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*(source.schema[i] for i in range(len(keep))), *(T.StructField(o, OUTPUTS[o][0]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch) if "media" in outputs else [batch]:
                columns: dict[str, list] = {o: [] for o in outputs}
                for value in part.column(len(keep)):
                    found = describe_text(value.as_py())
                    for o, column in columns.items():
                        column.append(found[o])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, OUTPUTS[o][1]) for o, c in columns.items())], names=schema.names)

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> list[pa.RecordBatch]:
    return [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)]


def probe_media(files: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each track of each file: keep columns, track (from 0), kind, codec, duration_s, frames,
    keyframes array<struct<offset, length>>, error.

    A null, empty or broken file gives one row with track null and the reason in error. Payloads are skipped.
    """
    source = files.select(*keep, files[media].alias("__media"))
    ranges = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))
    extra = [("track", T.IntegerType()), ("kind", T.StringType()), ("codec", T.StringType()), ("duration_s", T.DoubleType()), ("frames", T.LongType()), ("keyframes", ranges), ("error", T.StringType())]
    schema = T.StructType([*(source.schema[i] for i in range(len(keep))), *(T.StructField(n, t) for n, t in extra)])
    arrow = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])), pa.string()]

    def rows(data) -> list[tuple]:
        try:
            if not data:
                raise BadMedia("no bytes")
            return [
                (i, t.kind, t.codec.strip(), t.duration / t.timescale if t.timescale else None, len(t.sizes), [{"offset": a, "length": b} for a, b in t.keyframes()], None)
                for i, t in enumerate(probe(data))
            ]
        except BadMedia as e:
            return [(None, None, None, None, None, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows(value.as_buffer() if value.is_valid else None) for value in batch.column(len(keep))]
            owner = pa.array([i for i, r in enumerate(found) for _ in r], pa.int64())
            flat = [r for rs in found for r in rs]
            made = [pa.array([r[k] for r in flat], t) for k, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*(c.take(owner) for c in batch.columns[: len(keep)]), *made], names=schema.names)

    return source.mapInArrow(run, schema)

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sigwright.llm import media
from sigwright.llm.queries import QUERIES


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 16, 576 * 17, 576 * 200 + 3])
def test_round_trip(n):
    text = "".join(chr(97 + i * 7 % 26) for i in range(n))
    got = media.describe_text(text)
    payload = media.padded(text.encode())
    assert len(payload) % 576 == 0 and payload and payload.rstrip(b"\xff") == text.encode()
    assert got["payload_bytes"] == len(payload) and got["payload_sha256"] == hashlib.sha256(payload).hexdigest()
    assert got["tail_crc32"] == zlib.crc32(payload[-32:]) and got["n_bytes"] == n
    track = media.probe(got["media"])[0]
    assert (track.codec, track.kind, track.timescale, track.duration) == ("raw ", "vide", 600, 24 * len(payload) // 576)
    for at, size in track.keyframes():
        assert payload.find(got["media"][at : at + size]) >= 0
    assert len(track.keyframes()) == -(-len(payload) // 576 // 12) if len(payload) > 576 * 12 else 1


def movie(tables, extra=b"", wide=False):
    """A file with one track of given sample tables, its payload first."""
    stsd = media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(78)))
    mdhd = media.full(b"mdhd", struct.pack(">QQIQHH", 0, 0, 90000, 180000, 0, 0), version=1) if wide else media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90000, 180000, 0, 0))
    hdlr = media.full(b"hdlr", struct.pack(">4x4s12xx", b"vide"))
    trak = media.box(b"trak", media.box(b"mdia", mdhd, hdlr, media.box(b"minf", media.box(b"stbl", stsd, *tables))))
    return media.box(b"moov", trak, extra)


def test_variable_sizes_chunks_and_sync(spark):
    sizes = [5, 7, 11, 13, 17]
    tables = lambda wide: [
        media.full(b"stsz", struct.pack(">II", 0, 5) + np.array(sizes, ">u4").tobytes()),
        media.full(b"stsc", media.table([1, 2], [2, 3], [1, 1])),
        media.full(b"co64", struct.pack(">I", 2) + np.array([100, 1000], ">u8").tobytes()) if wide else media.full(b"stco", media.table([100, 1000])),
        media.full(b"stss", media.table([1, 4])),
    ]
    for wide in (False, True):
        track = media.probe(movie(tables(wide), wide=wide))[0]
        assert track.offsets.tolist() == [100, 105, 1000, 1011, 1024] and track.keyframes() == [(100, 5), (1011, 13)]
        assert (track.codec, track.duration / track.timescale) == ("avc1", 2.0)
    assert media.probe(movie(tables(False)[:3]))[0].keyframes() == [(100, 12), (1000, 41)]
    files = [(1, movie(tables(True), wide=True)), (2, b"junk"), (3, None), (4, b""), (5, movie(tables(False))[:-9])]
    df = spark.createDataFrame(files, "id long, media binary").selectExpr("id", "media", "'x' track", "'y' codec")
    got = {r.id: r for r in media.probe_media(df.repartition(2), keep=("id",)).collect()}
    assert got[1].codec == "avc1" and got[1].duration_s == 2 and [tuple(k) for k in got[1].keyframes] == [(100, 5), (1011, 13)] and got[1].error is None
    assert all(got[i].track is None and got[i].error for i in (2, 3, 4, 5))
    assert media.probe_media(df.limit(0), keep=("id",)).count() == 0


def test_counts_that_the_file_cannot_hold(spark):
    many = 0xFFFFFFFF
    good = [media.full(b"stsz", struct.pack(">II", 1, 5)), media.full(b"stsc", media.table([1], [5], [1])), media.full(b"stco", media.table([100]))]
    stsc = [good[0], media.full(b"stsc", media.table([1], [many], [1])), good[2]]
    assert media.probe(movie(stsc))[0].offsets.tolist() == media.probe(movie(good))[0].offsets.tolist() == [100, 101, 102, 103, 104]
    bad = [
        [media.full(b"stsz", struct.pack(">II", 1, many)), *good[1:]],
        [media.full(b"stsz", struct.pack(">II", 0, many)), *good[1:]],
        [media.full(b"stsz", struct.pack(">II", 0, 5)), *good[1:]],
        [good[0], media.full(b"stsc", media.table([1], [1], [1])), good[2]],
        [good[0], media.full(b"stsc", struct.pack(">I", many)), good[2]],
        [*good[:2], media.full(b"co64", struct.pack(">IQ", 1, 1 << 63))],
        [*good, media.full(b"stss", media.table([0]))],
    ]
    deep = b""
    for _ in range(40):
        deep = media.box(b"moov", deep)
    files = [(i, movie(t)) for i, t in enumerate(bad)] + [(99, deep)]
    got = media.probe_media(spark.createDataFrame(files, "id long, media binary"), keep=("id",)).collect()
    assert len(got) == len(files) and all(r.error and r.track is None for r in got)


def test_damaged_files_are_read_or_refused():
    r = random.Random(1)
    whole = media.mux(media.padded(b"some text" * 500))
    for _ in range(3000):
        data = bytearray(whole[:700])
        for _ in range(r.randint(1, 4)):
            data[r.randrange(len(data))] = r.choice([0, 1, 127, 128, 255, r.randrange(256)])
        try:
            for track in media.probe(bytes(data)):
                track.keyframes()
        except media.BadMedia:
            pass


def test_large_and_open_boxes():
    inner = media.box(b"free", b"x" * 10)
    large = struct.pack(">I4sQ", 1, b"moov", 16 + len(inner)) + inner
    assert [(b"/".join(p), a, b) for p, a, b in media.walk(large)] == [(b"moov", 16, 34), (b"moov/free", 24, 34)]
    assert [p for p, _, _ in media.walk(struct.pack(">I4s", 0, b"mdat") + b"rest")] == [(b"mdat",)]
    with pytest.raises(media.BadMedia):
        list(media.walk(struct.pack(">I4s", 4, b"free")))


def test_documents(documents):
    rows = [(1, None), (2, ""), (3, "é" * 100_000), (None, "x"), (3, "a"), (3, "a")]
    df = documents(rows, extra=True)
    got = media.store_texts(df, keep=("doc_id",), outputs=tuple(media.OUTPUTS)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (3, 200_000)]
    assert all(hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes for r in got)
    assert media.store_texts(documents([])).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op8_media"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.padded((texts[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))

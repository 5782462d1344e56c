"""Exact encoding and decoding with a SentencePiece BPE model (operator 10).

Encoding does not run the merge queue over a text. Longest vocabulary matches from an Aho-Corasick
automaton are tried left to right; a token is accepted after its predecessor only if merging their joined
text again gives exactly these two tokens; positions from which no continuation exists are remembered in a
bit field. A sequence whose neighbours are all compatible in that sense is the merge result, and only one
such sequence exists, so the search is exact.

A text is cut before each run of word marks (and around line breaks, which no piece contains), because no
piece holds a mark behind another character. That property is checked when the model is loaded.
"""

from __future__ import annotations

import hashlib
import re
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigwright.runtime import release_memory

MARK = "▁"
#: Chunks in one generation of a worker's cache; it holds two, and what is met again stays.
CACHE_ENTRIES = 250_000
#: Marks, a byte each, for chunks met once; a power of two.
SEEN = 1 << 21
#: Seconds for which an idle worker keeps its codec.
IDLE_SECONDS = 3.0
#: Rows of an output batch.
SLICE_ROWS = 200


class PieceCodec:
    """Encoder and decoder for BPE models with byte fallback and the identity normalizer.

    Other models are refused with ValueError: unused or user-defined pieces, other normalizers, pieces with
    a mark or a line break behind another character.
    """

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        trainer, norm = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and prefix marks are supported")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normalizer is supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.surface: list[str | int] = []
        self.controls: set[int] = set()
        self.marked: set[int] = set()
        byte_ids: dict[int, int] = {}
        automaton = ahocorasick.Automaton()
        for i, piece in enumerate(proto.pieces):
            self.surface.append("")
            if piece.type == 6:
                byte_ids[value := int(piece.piece[1:-1], 16)] = i
                self.surface[i] = value
            elif piece.type == 1:
                if re.search(f"[^{MARK}]{MARK}|\n", piece.piece):
                    raise ValueError(f"a mark behind another character: {piece.piece!r}")
                self.ids[piece.piece] = i
                self.rank[piece.piece] = -piece.score
                self.surface[i] = piece.piece.replace(MARK, " ")
                if piece.piece.startswith(MARK):
                    self.marked.add(i)
                automaton.add_word(piece.piece, len(piece.piece))
            elif piece.type == 2:
                self.surface[i] = trainer.unk_surface
            elif piece.type == 3:
                self.controls.add(i)
            else:
                raise ValueError("unused and user-defined pieces are not supported")
        automaton.make_automaton()
        self.automaton = automaton
        self.byte_ids = [byte_ids[b] for b in range(256)]
        #: Neighbouring characters inside pieces: between any others no merge ever happens.
        self.inside = {piece[i : i + 2] for piece in self.ids for i in range(len(piece) - 1)}
        self.chunks = re.compile(" *[^ \n]+| +|\n")
        self._pairs: dict[tuple[str, str], bool] = {}
        self._decimal: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._seen, self._marked = bytearray(SEEN), 0
        self._odd: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the best ranked, then leftmost, neighbouring pair."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joined text keeps exactly these two tokens (left may be empty)."""
        if (known := self._pairs.get((left, right))) is None:
            known = self.merged(left + right) == ([left, right] if left else [right])
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def tokens(self, chunk: str) -> list[str]:
        """The merge result of a chunk, found by backtracking."""
        n = len(chunk)
        fits: list[list[int]] = [[] for _ in range(n)]
        for end, length in self.automaton.iter(chunk):
            fits[end - length + 1].append(length)
        for lengths in fits:  # ascending, as ends are
            if not lengths or lengths[0] != 1:
                lengths.insert(0, 1)  # a character outside the vocabulary stands alone
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        at = [len(fits[0])] if n else []  # for each open position, how many of its lengths are untried
        pos = 0
        while pos < n:
            left = out[-1] if out else ""
            lengths, untried = fits[pos], at[-1]
            taken = 0
            while untried:
                untried -= 1
                end = pos + lengths[untried]
                if not failed[end >> 3] >> (end & 7) & 1 and self.compatible(left, chunk[pos:end]):
                    taken = end
                    break
            at[-1] = untried
            if taken:
                out.append(chunk[pos:taken])
                pos = taken
                if pos < n:
                    at.append(len(fits[pos]))
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                at.pop()
                if not out:
                    raise AssertionError(f"no token sequence for {chunk!r}")
                pos -= len(out.pop())
        return out

    def token_ids(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if (known := self.ids.get(token)) is not None:
                out.append(known)
            else:
                out.extend(self.byte_ids[b] for b in token.encode())
        return out

    def surfaces(self, ids) -> str:
        """Text of ids with marks as spaces; runs of byte tokens are read as UTF-8, each bad byte as U+FFFD."""
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                parts.append(_utf8(bytes(run)))
                run.clear()
            parts.append(s)
        if run:
            parts.append(_utf8(bytes(run)))
        return "".join(parts)

    def decimal(self, chunk: str) -> str:
        """Ids, as decimals joined by commas, of a chunk in which marks are written as spaces.

        A chunk that its ids do not decode to is noted in ``_odd``.
        """
        if (known := self._decimal.get(chunk)) is not None:
            return known
        if (known := self._older.get(chunk)) is not None:
            self._decimal[chunk] = known
            return known
        cuts = [i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1].replace(" ", MARK) not in self.inside]
        if cuts:
            parts = [chunk[i:j] for i, j in zip([0, *cuts], [*cuts, len(chunk)], strict=True)]
            known = ",".join([self.decimal(x) for x in parts])
            surface = "".join([self._odd.get(x, x) for x in parts])
        else:
            ids = self.token_ids(self.tokens(chunk.replace(" ", MARK)))
            known = ",".join(map(str, ids))
            surface = self.surfaces(ids)
        if surface != chunk:
            self._odd[chunk] = surface
        # what is met for the first time is only marked: most chunks never come again
        mark = hash(chunk) & (SEEN - 1)
        if self._seen[mark]:
            self._decimal[chunk] = known
        else:
            self._seen[mark] = 1
            self._marked += 1
            if self._marked > SEEN // 2:
                self._seen, self._marked = bytearray(SEEN), 0
        return known

    def split(self, text: str) -> list[str]:
        if len(self._decimal) >= CACHE_ENTRIES:
            self._older, self._decimal = self._decimal, {}
            if len(self._odd) >= CACHE_ENTRIES:
                self._older, self._odd = {}, {}
        return self.chunks.findall((self.prefix and " ") + text.replace(MARK, " ")) if text else []

    def encode_decimal(self, text: str) -> tuple[str, str]:
        """The ids of a text as decimals joined by commas, and what they decode to."""
        chunks = self.split(text)
        known = self._decimal.get
        decimal = ",".join([known(x) or self.decimal(x) for x in chunks])
        odd = self._odd
        decoded = "".join([odd.get(x, x) for x in chunks] if odd else chunks)
        return decimal, decoded[len(self.prefix) :]

    def encode(self, text: str) -> list[int]:
        decimal, _ = self.encode_decimal(text)
        return list(map(int, decimal.split(","))) if decimal else []

    def decode(self, ids) -> str:
        """As the library's decode(): the first token that is no control token loses one leading space."""
        text = self.surfaces(ids)
        first = next((i for i in ids if i not in self.controls), None)
        return text[1:] if self.prefix and first in self.marked else text


def _utf8(run: bytes) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (4, 3, 2, 1):
                try:
                    out.append(c := run[i : i + n].decode())
                    if len(c) == 1:
                        i += len(run[i : i + n])
                        break
                    out.pop()
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _column(output: str, found: list[tuple[str, str]]) -> pa.Array:
    """A column of encode_documents from (decimals, decoded text) rows."""
    if output == "n_tokens":
        return pa.array([d.count(",") + 1 if d else 0 for d, _ in found], pa.int64())
    if output == "ids":
        lists = [np.array(d.split(","), np.int32) if d else np.zeros(0, np.int32) for d, _ in found]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
    if output == "decoded":
        return pa.array([t for _, t in found], pa.string())
    texts = (d if output == "ids_sha256" else t for d, t in found)
    return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string())


_codecs: dict[bytes, PieceCodec] = {}
_idle: list[threading.Timer] = []
_turn = threading.Lock()


def worker_codec(model: bytes) -> PieceCodec:
    """One codec for each worker process: what it has learnt about chunks serves its next tasks."""
    key = hashlib.sha256(model).digest()
    with _turn:
        while _idle:
            _idle.pop().cancel()
        codec = _codecs.get(key)
        if codec is None:
            _codecs.clear()
            codec = _codecs[key] = PieceCodec(model)
        return codec


def _rest() -> None:
    """Forgets the codec unless a task asks for it soon: a worker lives on for other work."""

    def forget() -> None:
        with _turn:
            if timer not in _idle:  # a task came after the timer went off
                return
            _idle.remove(timer)
            _codecs.clear()
        release_memory()

    timer = threading.Timer(IDLE_SECONDS, forget)
    timer.daemon = True
    with _turn:
        _idle.append(timer)
    timer.start()


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")
) -> DataFrame:
    """Adds token columns to ``keep`` columns of docs.

    outputs, any of: n_tokens long, ids array<int>, decoded string, ids_sha256 and decoded_sha256 (lower-case
    hex of the decimal ids joined by commas, and of the decoded text in UTF-8).

    The model (bounded, about 0.5 MB) is read on the driver and broadcast. Rows are independent: no shuffle,
    and a lost executor costs only its tasks. A null text counts as empty: 0 tokens, no ids, empty decoded
    text. Repeated rows stay. Other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType(), False), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    source = docs.select(*keep, docs[text].alias("__text"))
    schema = T.StructType([*(source.schema[i] for i in range(len(keep))), *(T.StructField(o, kinds[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                found = [codec.encode_decimal(value.as_py() or "") for value in batch.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(_column(o, found) for o in outputs)], names=schema.names)
        _rest()

    return source.mapInArrow(run, schema)

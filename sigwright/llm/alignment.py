"""Alignment of two tokenizers over the same bytes (operator 12).

Every byte of a text has a label: none, an end of A's token, an end of B's token, or both. A regular expression
scans the labels for spans up to each "both"; the labels in a span say how many tokens of A and of B form the
group. Tokens whose bytes overlap are linked: between two neighbouring ends, of whichever tokenizer, stands exactly
one linked pair.

Texts are encoded in chunks and chunks are remembered: neither tokenizer joins anything across a single blank
between two other characters, so a text may be cut there. That holds for byte-level BPE, whose words have a blank
at their beginning only, and for piece models without a mark behind another character; models are checked for it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwright.llm.kept import Kept
from sigwright.llm.shingles import text_slices
from sigwright.runtime import Cut, release_memory

MARK = "▁"
#: Chunks in one generation of a worker's cache; it holds two, and what is met again stays. Longer chunks are not kept.
CACHE_ENTRIES = 200_000
CACHED_CHARS = 64
#: Characters of a text that are encoded at once: longer texts are cut at the next place where they may be.
PART_CHARS = 1 << 20
#: Id pairs that are sent to every task, those that most documents hold; the counts of all others are joined.
HEAVY = 1 << 19
#: Labels are digits: 1 an end of A's token, 2 of B's, 3 of both.
_SPAN = re.compile(rb"[^3]*3")
#: A blank at an end of the text or beside another.
_WIDE = re.compile(r"\A |\s | \s| \Z")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE writes for bytes: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Pieces of a text that can be encoded alone, without the single blanks between them."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut >= 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def chunks(text: str) -> list[str]:
    """Pieces of blank + text that can be encoded alone, each without its first blank."""
    words = text.split(" ")
    if not _WIDE.search(text):
        return words
    out = [words[0]]
    for w in words[1:]:
        if w and out[-1] and not w[0].isspace() and not out[-1][-1].isspace():
            out.append(w)
        else:
            out[-1] += " " + w
    return out


class Aligner:
    """Encodes texts with both tokenizers and aligns them. A: byte-level BPE (tokenizers), as JSON; B: a piece model
    that adds a blank (sentencepiece). ValueError for models that can't be encoded in chunks."""

    def __init__(self, byte_model: str, piece_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb
        from tokenizers import Tokenizer

        spec, proto = json.loads(byte_model), pb.ModelProto()
        proto.ParseFromString(piece_model)
        before, norm = spec.get("pre_tokenizer") or {}, proto.normalizer_spec
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("A must be byte-level BPE without a normalizer or added blanks")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("B must have the identity normalizer and add a blank at the beginning")
        if any(p.type in (1, 4) and re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces):
            raise ValueError("B has a piece with a mark behind another character")
        self.a, self.b = Tokenizer.from_str(byte_model), SentencePieceProcessor(model_proto=piece_model)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        alphabet, size = byte_alphabet(), self.a.get_vocab_size()
        entries = [self.a.id_to_token(i) for i in range(size)]
        self.a_bytes = [bytes(alphabet[c] for c in x) if x and all(c in alphabet for c in x) else (x or "").encode() for x in entries]
        self.b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.base = len(self.b_bytes)
        if size * self.base >= 1 << 31:
            raise ValueError("the vocabularies have too many pairs of ids")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.decimal = [str(i) for i in range(max(size, self.base))]
        #: chunk: (groups as text, id pairs of its links, tokens of A, of B, groups); None where bytes differ
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def _encoded(self, fresh: list[str]) -> tuple[list, list]:
        return [x.ids for x in self.a.encode_batch_fast([" " + c for c in fresh], add_special_tokens=False)], self.b.encode(fresh, num_threads=1)

    def _align(self, fresh: list[str]) -> dict[str, tuple | None]:
        made_a, made_b = self._encoded(fresh)
        raw = [(" " + c).encode() for c in fresh]
        whole = b"".join(raw)
        joined = [b"".join([size[i] for ids in made for i in ids]) for made, size in ((made_a, self.a_bytes), (made_b, self.b_bytes))]
        out: dict[str, tuple | None] = {}
        if joined != [whole, whole]:  # some chunk is not what its tokens say
            fits = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(made_a, made_b, raw, strict=True)]
            out = {c: None for c, ok in zip(fresh, fits, strict=True) if not ok}
            fresh, made_a, made_b, raw = ([x for x, ok in zip(rows, fits, strict=True) if ok] for rows in (fresh, made_a, made_b, raw))
        if not fresh:
            return out
        many_a, many_b = [len(x) for x in made_a], [len(x) for x in made_b]
        flat_a, flat_b = ([i for x in made for i in x] for made in (made_a, made_b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        ends = np.cumsum([len(x) for x in raw])
        labels = np.zeros(int(ends[-1]) + 1, np.uint8)
        labels[np.cumsum(self.a_size[ids_a])] += 1
        labels[np.cumsum(self.b_size[ids_b])] += 2
        at = np.flatnonzero(labels)
        ended = labels[at]
        of_a, of_b = (ended & 1).astype(np.int64), (ended >> 1).astype(np.int64)
        pairs = (ids_a[np.cumsum(of_a) - of_a] * self.base + ids_b[np.cumsum(of_b) - of_b]).astype(np.int32)
        # bytes without an end say nothing: what is scanned are the ends alone
        spans = _SPAN.findall((ended + ord("0")).tobytes())
        in_a, in_b = (np.fromiter([1 if x == b"3" else x.count(mark) + 1 for x in spans], np.int64, len(spans)) for mark in (b"1", b"2"))
        after_a, after_b = np.cumsum(in_a), np.cumsum(in_b)
        decimal = self.decimal
        groups = [f"{i}|{j}" for i, j in zip(ids_a[after_a - in_a].tolist(), ids_b[after_b - in_b].tolist(), strict=True)]
        for g in np.flatnonzero((in_a > 1) | (in_b > 1)).tolist():
            groups[g] = ",".join([decimal[i] for i in flat_a[after_a[g] - in_a[g] : after_a[g]]]) + "|" + ",".join([decimal[i] for i in flat_b[after_b[g] - in_b[g] : after_b[g]]])
        until = np.searchsorted(at, ends, "right").tolist()
        last_group = np.searchsorted(at[ended == 3], ends, "right").tolist()
        first = begin = 0
        for chunk, m, n, link, group in zip(fresh, many_a, many_b, until, last_group, strict=True):
            out[chunk] = (";".join(groups[begin:group]), pairs[first:link].tobytes(), m, n, group - begin)
            first, begin = link, group
        return out

    def align(self, texts: list[str | None]) -> list[tuple]:
        """(tokens of A, of B, groups, SHA-256 of the groups as text or '', id pairs, how often each is linked) of texts."""
        if any(t and len(t) > PART_CHARS for t in texts):  # one by one, part by part
            return [self._text((chunks(p) for p in parts(t)) if t else (), {}) for t in texts]
        split = [[chunks(t)] if t else [] for t in texts]
        # new chunks of all texts are encoded together
        made = self._learn({c for t in split for words in t for c in words})
        return [self._text(t, made) for t in split]

    def _text(self, split, made: dict[str, tuple | None]) -> tuple:
        digest, n, found, many = hashlib.sha256(), [0, 0, 0], [], []
        for words in split:
            entries = self._entries(words, made)
            if None in entries:
                found = []
                break
            digest.update(((";" if found else "") + ";".join([e[0] for e in entries])).encode())
            n = [n[k] + sum([e[k + 2] for e in entries]) for k in range(3)]
            pairs, times = np.unique(np.frombuffer(b"".join([e[1] for e in entries]), np.int32), return_counts=True)
            found.append(pairs)
            many.append(times)
        if not found:
            return 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int64)
        pairs, times = found[0], many[0]
        if len(found) > 1:
            pairs, where = np.unique(np.concatenate(found), return_inverse=True)
            times = np.bincount(where, np.concatenate(many)).astype(np.int64)
        return *n, digest.hexdigest(), pairs, times

    def _learn(self, wanted: set[str]) -> dict[str, tuple | None]:
        """Entries of chunks that were not known; the short ones are known from now on."""
        if len(self.known) > CACHE_ENTRIES:
            self.older, self.known = self.known, {}
        fresh = []
        for c in wanted:
            if c not in self.known:
                if c in self.older:
                    self.known[c] = self.older[c]
                else:
                    fresh.append(c)
        made = self._align(fresh) if fresh else {}
        self.known.update((c, e) for c, e in made.items() if len(c) <= CACHED_CHARS)
        return made

    def _entries(self, words: list[str], made: dict[str, tuple | None]) -> list[tuple | None]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            made = made | self._learn({w for w in words if w not in made})
            known = self.known
            return [known[w] if w in known else made[w] for w in words]


_aligners = Kept()


def worker_aligner(byte_model: str, piece_model: bytes) -> Aligner:
    """One aligner for each worker process."""
    return _aligners.get((hash(byte_model), hash(piece_model)), lambda: Aligner(byte_model, piece_model))


def rest() -> None:
    _aligners.rest()


def _aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, row (a number for each row), n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of every row."""
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))
    source = docs.select(*(F.col(k) for k in keep), docs[text].alias("__text"))
    fields = [("row", T.LongType()), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()), ("pairs", T.ArrayType(T.IntegerType(), False)), ("times", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([*(T.StructField(f"keep_{i}", source.schema[i].dataType) for i in range(len(keep))), *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = worker_aligner(*models.value)
        row = TaskContext.get().partitionId() << 33
        for batch in text_slices(batches, len(keep), 1 << 20):
            found = aligner.align(batch.column(len(keep)).to_pylist())
            n = len(found)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[4]) for x in found])]), pa.int32())
            pairs, times = (np.concatenate([x[k] for x in found]) for k in (4, 5))
            columns = [pa.array(np.arange(row, row + n)), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)), pa.array([int(x[5].sum()) for x in found], pa.int64())]
            columns += [pa.array([x[3] for x in found], pa.string()), pa.ListArray.from_arrays(ends, pa.array(pairs, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
            row += n
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)
        rest()

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): how many rows of aligned hold a pair, and whether that is the most of its id of A. pairs of a
    row are distinct, so partial counts are made before anything is shuffled."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = Cut(counts, "pair-counts").df
    a = F.expr(f"pair div {base}")
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counted.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _heavy(counts: DataFrame, most: int) -> tuple[int, pa.Table]:
    """(count from which pairs are heavy, those pairs): no more than ``most``, by classes of counts."""
    # classes of counts that differ by an eighth part or less, a few hundred at most
    step = F.floor(F.log2("n") * 6)
    held, least = 0, None
    for r in counts.groupBy(step.alias("c")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("c")).collect():
        if held + r.k > most:
            break
        held, least = held + r.k, r.least
    if least is None:
        return (1 << 62), counts.limit(0).toArrow()
    return least, counts.filter(F.col("n") >= least).toArrow()


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: tuple[str, ...] = (), heavy: int = HEAVY) -> DataFrame:
    """``keep`` columns of docs and, of every whole text, n_a and n_b (tokens), n_groups, n_links (pairs of tokens whose
    bytes overlap), n_best (links whose pair of ids is, with ties, the one that most rows hold of all with that id of A), count_sum
    (over links, the number of rows that hold their pair) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``).

    A encodes blank + text, B the text, to which it adds the blank. Null and empty texts, and texts whose joined bytes
    differ from blank + text, have no tokens: zeros and ''. Repeated rows stay and count each. Other columns are not
    read. Models (bounded, some MB) are broadcast.

    Each text is encoded once; its distinct pairs are written to the shared folder. The pairs that most rows hold, at
    most ``heavy``, are sent to all tasks with their counts, so that no pair of every row is a key of the join
    that the others go through.
    """
    with open(piece_path, "rb") as f:
        from sentencepiece import SentencePieceProcessor

        base = SentencePieceProcessor(model_proto=f.read()).get_piece_size()
    aligned = Cut(_aligned(docs, byte_path, piece_path, text, keep), "aligned").df
    counts = Cut(pair_counts(aligned.select("pairs"), base), "pair-ranks").df
    least, known = _heavy(counts, heavy)
    order = np.argsort(known.column("pair").to_numpy(), kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))
    at = aligned.columns.index("pairs")
    schema = T.StructType([*aligned.schema.fields[:at], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), *(T.StructField(n, aligned.schema[n].dataType) for n in ("pairs", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            lists, size = batch.column(at), batch.num_rows
            lengths = lists.value_lengths().to_numpy()
            flat, times, owner = lists.flatten().to_numpy(), batch.column(at + 1).flatten().to_numpy(), np.repeat(np.arange(size), lengths)
            where = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            found = pair[where] == flat if len(pair) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, owner[found], times[found] * n[where[found]])
            np.add.at(bests, owner[found], times[found] * best[where[found]])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~found], minlength=size))]), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~found], pa.int32())) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(bests), pa.array(sums), *rest], names=schema.names)
        release_memory()

    summed = Cut(aligned.mapInArrow(run, schema), "alignment-sums").df
    rare = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rare = rare.join(counts.filter(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    whole = summed.drop("pairs", "times").join(rare, "row", "left")
    zero = F.lit(0)
    return whole.select(
        *(F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)), "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256",
    )

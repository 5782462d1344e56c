"""k-mers as numbers, two bits a base, for all that explodes into k-mers before it is grouped.

Tasks pack the windows of a batch with numpy, sort them and send them on as chunks: a row for each bucket of k-mers,
with thousands of numbers in it. Spark shuffles and sorts chunks by bucket, and tasks take one bucket after the other. A k-mer
meets its orientations in one bucket, so only the canonical one of four travels. Windows with letters other than A, C, G
and T, and k above 31, take the plain way over strings: see ``other``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.runtime import release_memory

#: The largest k that fits a number.
LONGEST = 31
BUCKETS = 1024
#: Up to this k a task counts in one array of 4**k numbers.
DENSE = 12
#: Windows that a task packs at once, and rows of a batch that it gives back.
SPAN, ROWS = 1 << 21, 1 << 16

_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_SIX = np.frombuffer(b"ACGT", np.uint8)[np.arange(4096)[:, None] >> np.arange(10, -1, -2) & 3]

CHUNKS = "bucket int, kind int, gids array<string>, sizes binary, codes binary, places binary"
#: What a chunk holds: canonical k-mers of which a gene has all orientations, single k-mers of genes, k-mers of samples with
#: how often they occur, and forward windows with transcript and position.
CLOSED, SINGLE, SAMPLE, WINDOW = range(4)


def other(seq: str = "seq") -> F.Column:
    """Whether a sequence has other letters."""
    return F.translate(seq, "ACGT", "") != ""


def kind_of(k: int) -> type:
    return np.uint32 if k <= 16 else np.uint64


# ---- numbers ------------------------------------------------------------------------------------------


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings or binaries, and where each begins and ends in them."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if not len(strings):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)), at - at[0]


def _packed(base: np.ndarray, k: int) -> np.ndarray:
    """Numbers of all windows of k bases, by windows of 1, 2, 4, ... bases."""
    out, width, power, size = None, 0, base, 1
    while size <= k:
        if k & size:
            n = len(base) - width - size + 1
            out = power if out is None else (out[:n] << out.dtype.type(2 * size)) | power[width : width + n]
            width += size
        if 2 * size <= k:
            power = (power[:-size] << power.dtype.type(2 * size)) | power[size:]
        size *= 2
    return out


def windows(seqs: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, windows behind it in its row, number) of the windows without other letters, in blocks. Nulls have none."""
    data, offsets = flat(seqs)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    # characters before each byte, where some have more than one
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(data) and data.max() > 127 else None
    for begin in range(0, len(data) - k + 1, SPAN):
        base = _BASE[data[begin : begin + SPAN + k - 1]]
        n = len(base) - k + 1
        good = row[begin : begin + n] == row[begin + k - 1 : begin + k - 1 + n]
        bad = base > 3
        if bad.any():
            so_far = np.concatenate(([0], np.cumsum(bad)))
            good &= so_far[k:] == so_far[:n]
        at = np.flatnonzero(good)
        code = _packed((base & 3).astype(kind_of(k)), k)[at]
        at += begin
        own = row[at]
        place = offsets if before is None else before[offsets]
        pos = (at if before is None else before[at]) - place[own]
        yield own, pos.astype(np.int32), place[own + 1] - place[own] - k - pos, code


def reverse(code: np.ndarray, k: int) -> np.ndarray:
    bits, t = code.dtype.itemsize * 8, code.dtype.type
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        m = t(mask & ((1 << bits) - 1))
        code = ((code >> t(shift)) & m) | ((code & m) << t(shift))
    return code.byteswap() >> t(bits - 2 * k)


def orbit(code: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The four orientations: forward, reverse, reverse complement, complement."""
    every = code.dtype.type((1 << 2 * k) - 1)
    back = reverse(code, k)
    return code, back, back ^ every, code ^ every


def canonical(code: np.ndarray, k: int) -> np.ndarray:
    a, b, c, d = orbit(code, k)
    return np.minimum(np.minimum(a, b), np.minimum(c, d))


def bucket(code: np.ndarray) -> np.ndarray:
    if code.dtype == np.uint32:
        return (code * np.uint32(2654435761)) >> np.uint32(22)
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)


def spelled(code: np.ndarray, k: int) -> pa.Array:
    out = np.empty((len(code), k), np.uint8)
    for at in range(0, k, 6):
        n = min(6, k - at)
        out[:, at : at + n] = _SIX[(code >> code.dtype.type(2 * (k - at - n))) & code.dtype.type(4**n - 1)][:, 6 - n :]
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(np.arange(0, (len(code) + 1) * k, k, dtype=np.int32)), pa.py_buffer(out))


def numbers(kmers: list[str], k: int) -> np.ndarray:
    """Numbers of k-mers of A, C, G and T."""
    return np.concatenate([np.empty(0, kind_of(k)), *(code for *_, code in windows(pa.array(kmers, pa.string()), k))])


def _order(*keys: tuple[np.ndarray, int]) -> tuple[np.ndarray | None, np.ndarray]:
    """(one number for all keys, or None where they don't fit, order): keys are (values, bits), the weightiest first."""
    if sum(bits for _, bits in keys) > 64:
        return None, np.lexsort([v for v, _ in reversed(keys)])
    key = np.zeros(len(keys[0][0]), np.uint64)
    for values, bits in keys:
        key = (key << np.uint64(bits)) | values.astype(np.uint64)
    return key, np.argsort(key)


def _starts(*sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_values[0]), bool)
    new[1:] = False
    for v in sorted_values:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """data cut at ends (in items, from 0) as binaries."""
    width = data.dtype.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


# ---- chunks of genes ----------------------------------------------------------------------------------


def _chunks(kind: int, gids: pa.Array, gene: np.ndarray, code: np.ndarray, k: int, places: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each bucket; of equal k-mers of a gene one is kept, but for windows."""
    at = bucket(canonical(code, k) if kind != CLOSED else code)
    _, order = _order((at, 10), (gene, max(1, len(gids).bit_length())), (code, 2 * k))
    at, gene, code = at[order], gene[order], code[order]
    if kind == WINDOW:
        places = places[order]
    else:
        once = _starts(at, gene, code)
        if kind == SAMPLE:
            places = np.diff(np.append(once, len(code))).astype(np.int64)
        at, gene, code = at[once], gene[once], code[once]
    runs = _starts(at, gene)
    firsts = _starts(at[runs])
    in_runs = np.append(firsts, len(runs))
    in_codes = np.append(runs[firsts], len(code))
    n = len(firsts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(at[runs[firsts]].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.ListArray.from_arrays(pa.array(in_runs, pa.int32()), gids.take(pa.array(gene[runs]))),
            _binary(np.diff(np.append(runs, len(code))).astype(np.int32), in_runs), _binary(code, in_codes), pa.nulls(n, pa.binary()) if places is None else _binary(places, in_codes),
        ],
        ["bucket", "kind", "gids", "sizes", "codes", "places"],
    )


def gene_chunks(transcripts: DataFrame, k: int, forward: bool = False, samples: F.Column | None = None) -> DataFrame:
    """CHUNKS of the k-mers of genes over all orientations. Each orientation leaves out its own last window: of the first window
    a gene has the k-mer and its complement, of the last one the two reversed, of all between the four.
    forward: with WINDOW rows, which stand for CLOSED ones too. samples: an array of k-mers, with SAMPLE rows for those of length k."""

    sampled = samples is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        names, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            coded = pa.chunked_array(names, pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
            index = coded.indices.to_numpy(zero_copy_only=False)
            for kind, parts in held.items():
                gene, code, places = (np.concatenate(x) if x[0] is not None else None for x in zip(*parts, strict=True))
                if len(code):
                    yield _chunks(kind, coded.dictionary, index[gene].astype(np.int64), code, k, places)
            held.clear()
            names.clear()
            size = 0

        begin = 0
        for batch in batches:
            names.append(batch["gid"])
            tidx = batch["tidx"].to_numpy(zero_copy_only=False) if forward else None
            for row, pos, behind, code in windows(batch["seq"], k):
                add = lambda kind, where, what, places=None, row=row: held.setdefault(kind, []).append((begin + row[where].astype(np.int64), what, places))
                _, back, opposite, comp = orbit(code, k)
                first, last = (pos == 0) & (behind > 0), (behind == 0) & (pos > 0)
                inner = (pos > 0) & (behind > 0)
                add(SINGLE, first, comp[first])
                add(SINGLE, last, back[last])
                add(SINGLE, last, opposite[last])
                if forward:
                    own = behind > 0
                    add(WINDOW, own, code[own], np.stack([tidx[row[own]].astype(np.int32), pos[own]], axis=1))
                else:
                    add(SINGLE, first, code[first])
                    add(CLOSED, inner, np.minimum(np.minimum(code, back), np.minimum(opposite, comp))[inner])
                size += len(code)
            if sampled:
                lists = batch["samples"]
                row = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                for at, _, behind, code in windows(lists.flatten(), k):
                    held.setdefault(SAMPLE, []).append((begin + row[at[behind == 0]].astype(np.int64), code[behind == 0], None))
            begin += len(batch)
            if size >= SPAN:
                yield from out()
                begin = 0
        if names:
            yield from out()
        release_memory()

    columns = ["gid", *(["tidx"] if forward else []), "seq", *([] if samples is None else [samples.alias("samples")])]
    return transcripts.select(*columns).mapInArrow(pack, CHUNKS)


def by_bucket(chunks: DataFrame, each: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """``each`` over the tables of buckets, one after the other. Workers that wait for other tasks give memory back."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, now = [], None
        for batch in batches:
            values = batch["bucket"].to_numpy()
            cuts = _starts(values) if len(values) else []
            for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
                if held and values[a] != now:
                    yield pa.Table.from_batches(held)
                    held = []
                now = values[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(walk(batches))
        release_memory()

    return chunks.repartition(*([partitions] if partitions else []), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


class Bucket:
    """The genes and k-mers of a bucket."""

    def __init__(self, table: pa.Table, k: int):
        self.k, kinds = k, table["kind"].to_numpy()
        parts = {kind: table.filter(pa.array(kinds == kind)) for kind in set(kinds.tolist())}
        names = pa.chunked_array([c.flatten() for t in parts.values() for c in t["gids"].chunks], pa.string()).combine_chunks().dictionary_encode(null_encoding="encode")
        index, begin = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), 0
        self.gids, self.parts = names.dictionary, {}
        self.gene_bits = max(1, len(self.gids).bit_length())
        for kind, t in parts.items():
            sizes = flat(t["sizes"])[0].view(np.int32)
            gene = np.repeat(index[begin : begin + len(sizes)], sizes)
            begin += len(sizes)
            self.parts[kind] = gene, flat(t["codes"])[0].view(kind_of(k)), flat(t["places"])[0]

    def part(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.parts.get(kind, (np.empty(0, np.int64), np.empty(0, kind_of(self.k)), np.empty(0, np.uint8)))

    def pairs(self, gene: np.ndarray, code: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Distinct (gene, code) by code and gene, with the sum of times."""
        bits = 2 * self.k + self.gene_bits
        if times is None and bits <= 64:
            key = np.unique((code.astype(np.uint64) << np.uint64(self.gene_bits)) | gene.astype(np.uint64))
            return (key & np.uint64((1 << self.gene_bits) - 1)).astype(np.int64), (key >> np.uint64(self.gene_bits)).astype(code.dtype)
        _, order = _order((code, 2 * self.k), (gene, self.gene_bits))
        gene, code = gene[order], code[order]
        once = _starts(code, gene)
        return (gene[once], code[once]) if times is None else (gene[once], code[once], np.add.reduceat(times[order], once) if len(once) else times)

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (gene, code) of all k-mers of genes, by code."""
        gene, code, places = self.part(WINDOW)
        inner = places.view(np.int32).reshape(-1, 2)[:, 1] > 0
        closed_gene, closed, _ = self.part(CLOSED)
        some, single, _ = self.part(SINGLE)
        closed_gene, closed = self.pairs(np.concatenate([closed_gene, gene[inner]]), np.concatenate([closed, canonical(code[inner], self.k)]))
        return self.pairs(np.concatenate([*[closed_gene] * 4, some, gene[~inner]]), np.concatenate([*orbit(closed, self.k), single, code[~inner]]))


def _sliced(n: int) -> Iterator[slice]:
    return (slice(i, i + ROWS) for i in range(0, n, ROWS))


def distinct(transcripts: DataFrame, k: int) -> DataFrame:
    """(gid, kmer), distinct, over all orientations, of windows without other letters."""

    def each(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            here = Bucket(table, k)
            gene, code = here.owners()
            for s in _sliced(len(code)):
                yield pa.RecordBatch.from_arrays([here.gids.take(pa.array(gene[s])), spelled(code[s], k)], ["gid", "kmer"])

    return by_bucket(gene_chunks(transcripts, k), each, "gid string, kmer string")


def repeated(transcripts: DataFrame, k: int) -> DataFrame:
    """(kmer, n_genes) of the k-mers of ``distinct`` that two genes or more have."""

    def each(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            _, code = Bucket(table, k).owners()
            code, n = np.unique(code, return_counts=True)
            code, n = code[n > 1], n[n > 1].astype(np.int64)
            for s in _sliced(len(code)):
                yield pa.RecordBatch.from_arrays([spelled(code[s], k), pa.array(n[s])], ["kmer", "n_genes"])

    return by_bucket(gene_chunks(transcripts, k), each, "kmer string, n_genes long")


def signature(transcripts: DataFrame, k: int) -> DataFrame:
    """(gid, tidx, pos, kmer) of forward windows without other letters whose k-mer no other gene has. Windows meet the k-mers of
    all genes in their bucket: there is no join."""

    def each(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            here = Bucket(table, k)
            gene, code, places = here.part(WINDOW)
            places = places.view(np.int32).reshape(-1, 2)
            single, n = np.unique(here.owners()[1], return_counts=True)
            single = single[n == 1]
            if not len(single) or not len(code):
                continue
            at = np.minimum(np.searchsorted(single, code), len(single) - 1)
            own = np.flatnonzero(single[at] == code)
            for s in _sliced(len(own)):
                i = own[s]
                yield pa.RecordBatch.from_arrays([here.gids.take(pa.array(gene[i])), pa.array(places[i, 0]), pa.array(places[i, 1]), spelled(code[i], k)], ["gid", "tidx", "pos", "kmer"])

    return by_bucket(gene_chunks(transcripts, k, forward=True), each, "gid string, tidx int, pos int, kmer string")


#: Rows of ``overlaps``: sums of a pair of genes, a gene's samples of a heavy k-mer, a gene that owns one.
PAIR, SAMPLED, OWNER = range(3)
_PAIRS = 1 << 22


class _Sums:
    """Sums by pair of genes over buckets."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, here: Bucket, one: np.ndarray, two: np.ndarray, dup: np.ndarray) -> None:
        index = np.array([self.names.setdefault(x, len(self.names)) for x in here.gids.to_pylist()], np.uint64)
        self.held.append(((index[one] << np.uint64(32)) | index[two], dup))
        self.size += len(dup)
        if self.size > 2 * _PAIRS:
            self.merge()

    def merge(self) -> None:
        key, dup = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.argsort(key)
        key, dup = key[order], dup[order]
        once = _starts(key)
        self.held, self.size = [(key[once], np.add.reduceat(dup, once))], len(once)

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.merge()
            names, (key, dup) = pa.array(list(self.names), pa.string()), self.held[0]
            for s in _sliced(len(key)):
                yield _row(PAIR, names.take(pa.array(key[s] >> np.uint64(32))), names.take(pa.array(key[s] & np.uint64((1 << 32) - 1))), None, pa.array(dup[s]))
        self.names, self.held, self.size = {}, [], 0


def _row(kind: int, one: pa.Array | None, two: pa.Array | None, kmer: pa.Array | None, n: pa.Array | None) -> pa.RecordBatch:
    size = len(one if one is not None else two)
    filled = [pa.nulls(size, t) if x is None else x for x, t in zip((one, two, kmer, n), (*[pa.string()] * 3, pa.int64()), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *filled], ["kind", "gid1", "gid2", "kmer", "n"])


def _joined(here: Bucket, gene: np.ndarray, times: np.ndarray, first: np.ndarray, n: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(gene of a sample, owner, dup) of samples with n owners each from ``first`` on; at most _PAIRS pairs at once, but for
    those of one sample."""
    genes, ends = len(here.gids), np.cumsum(n)
    begin = 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + _PAIRS, "right")))
        some = slice(begin, end)
        row = np.repeat(np.arange(begin, end), n[some])
        two = owner[np.arange(len(row)) - (ends - n - (ends[begin] - n[begin]))[row] + first[row]]
        one = gene[row]
        other_gene = one != two
        key, weight = (one * genes + two)[other_gene], times[row][other_gene]
        if genes * genes <= _PAIRS:
            dup = np.bincount(key, weight, genes * genes)
            key = np.flatnonzero(dup)
            dup = dup[key].astype(np.int64)
        else:
            order = np.argsort(key)
            key = key[order]
            once = _starts(key)
            key, dup = key[once], np.add.reduceat(weight[order], once) if len(once) else weight
        yield key // genes, key % genes, dup
        begin = end


def overlaps(transcripts: DataFrame, k: int, samples: F.Column, heavy: int) -> DataFrame:
    """(kind, gid1, gid2, kmer, n) of windows without other letters. PAIR rows sum, by task, how many samples of gid1 are k-mers of
    gid2, over k-mers that at most ``heavy`` genes own. Of the k-mers that more own, and some gene has sampled: SAMPLED rows of
    gid1, with times n, and OWNER rows of gid2."""

    def each(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for table in tables:
            here = Bucket(table, k)
            gene, code, times = here.part(SAMPLE)
            if not len(code):
                continue
            gene, code, times = here.pairs(gene, code, times.view(np.int64))
            owner, owned = here.owners()
            first = np.searchsorted(owned, code)
            n = np.searchsorted(owned, code, "right") - first
            many = np.flatnonzero(n > heavy)
            for s in _sliced(len(many)):
                i = many[s]
                yield _row(SAMPLED, here.gids.take(pa.array(gene[i])), None, spelled(code[i], k), pa.array(times[i]))
            if len(many):
                at = np.flatnonzero(np.isin(owned, np.unique(code[many])))
                for s in _sliced(len(at)):
                    yield _row(OWNER, None, here.gids.take(pa.array(owner[at[s]])), spelled(owned[at[s]], k), None)
            few = (n > 0) & (n <= heavy)
            for one, two, dup in _joined(here, gene[few], times[few], first[few], n[few], owner):
                if len(dup):
                    sums.add(here, one, two, dup)
            if sums.size > _PAIRS and len(sums.held) == 1:
                yield from sums.out()
        yield from sums.out()

    # few tasks: each has a row for each pair of genes that it finds
    tasks = 3 * transcripts.sparkSession.sparkContext.defaultParallelism
    return by_bucket(gene_chunks(transcripts, k, samples=samples), each, "kind int, gid1 string, gid2 string, kmer string, n long", tasks)


# ---- counts of reads ----------------------------------------------------------------------------------


class Wanted:
    """A set of k-mers, to be looked up in batches."""

    def __init__(self, kmers: list[str], k: int):
        plain = [x for x in kmers if len(x) == k and not x.strip("ACGT")]
        self.others = set(kmers) - set(plain)
        self.codes = np.sort(numbers(plain, k))
        self.k, self.marks = k, np.zeros(1 << 24, bool)
        self.marks[self._mark(self.codes)] = True

    def _mark(self, code: np.ndarray) -> np.ndarray:
        return code if self.k <= DENSE else (code * code.dtype.type(0x9E3779B1)) >> code.dtype.type(code.dtype.itemsize * 8 - 24)

    def chosen(self, code: np.ndarray) -> np.ndarray:
        """Places of those that are wanted."""
        found = np.flatnonzero(self.marks[self._mark(code)])
        if self.k <= DENSE or not len(self.codes):
            return found
        at = np.minimum(np.searchsorted(self.codes, code[found]), len(self.codes) - 1)
        return found[self.codes[at] == code[found]]


class Tally:
    """Sums by k-mer; where a task holds too many, some are given on early."""

    def __init__(self, k: int, kind: type):
        self.k, self.kind, self.held, self.size, self.dense = k, kind, [], 0, None

    def add(self, code: np.ndarray, n: np.ndarray | None) -> bool:
        """Whether it is time to give on."""
        self.held.append((code, n))
        self.size += len(code)
        if self.size < 4 * SPAN:
            return False
        if self.k > DENSE:
            self.held = [self._merged()]
            self.size = len(self.held[0][0])
            return self.size > 2 * SPAN
        if self.dense is None:
            self.dense = np.zeros(4**self.k, self.kind)
        self._fill()
        return False

    def _fill(self) -> None:
        """Sums of integers below 2**53 are exact as doubles."""
        code = np.concatenate([c for c, _ in self.held])
        n = None if self.held[0][1] is None else np.concatenate([n for _, n in self.held])
        self.held, self.size = [], 0
        found = np.bincount(code, n, 4**self.k)
        self.dense += found.astype(self.kind, copy=False)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.concatenate([np.empty(0, kind_of(self.k)), *(c for c, _ in self.held)])
        if all(n is None for _, n in self.held):
            code, n = np.unique(code, return_counts=True)
            return code, n.astype(self.kind)
        n = np.concatenate([np.ones(len(c), self.kind) if n is None else n for c, n in self.held])
        order = np.argsort(code)
        code, n = code[order], n[order]
        once = _starts(code)
        return code[once], np.add.reduceat(n, once)

    def out(self) -> tuple[np.ndarray, np.ndarray]:
        if self.dense is not None:
            if self.held:
                self._fill()
            code = np.flatnonzero(self.dense).astype(kind_of(self.k))
            n = self.dense[code]
        else:
            code, n = self._merged()
        self.held, self.size, self.dense = [], 0, None
        return code, n


def _other_windows(seqs: pa.Array, k: int) -> Iterator[tuple[int, str]]:
    """(row, k-mer) of the windows with letters other than A, C, G, T and N, and without N."""
    data, offsets = flat(seqs)
    odd = (_BASE[data] > 3) & (data != ord("N"))
    if odd.any():
        for row in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist():
            text = seqs[row].as_py()
            yield from ((row, w) for w in (text[i : i + k] for i in range(len(text) - k + 1)) if "N" not in w and w.strip("ACGT"))


COUNTS = "bucket int, codes binary, n binary, kmer string, times {0}, seen long"


def read_chunks(reads: DataFrame, k: int, weight: str | None = None, wanted: Wanted | None = None, seq: str = "seq") -> DataFrame:
    """Sums by task: chunks of numbers with their sums, other k-mers one a row, and how many k-mers a batch has, without
    those with an N. weight: an integer or double column."""
    real = weight is not None and reads.schema[weight].dataType.typeName() in ("float", "double", "decimal")
    kind = np.float64 if real else np.int64
    schema = pa.schema([("bucket", pa.int32()), ("codes", pa.binary()), ("n", pa.binary()), ("kmer", pa.string()), ("times", pa.from_numpy_dtype(kind)), ("seen", pa.int64())])
    sent = None if wanted is None else reads.sparkSession.sparkContext.broadcast(wanted)

    def chunks(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = (code >> code.dtype.type(max(0, 2 * k - 10))).astype(np.int32) if k <= DENSE else bucket(code).astype(np.int32)
        if k > DENSE:
            order = np.argsort(at, kind="stable")
            at, code, n = at[order], code[order], n[order]
        first = _starts(at)
        ends, m = np.append(first, len(code)), len(first)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), _binary(code, ends), _binary(n, ends), pa.nulls(m, pa.string()), pa.nulls(m, schema.field("times").type), pa.nulls(m, pa.int64())], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, seen, others = Tally(k, kind), 0, Counter()
        lookup = sent.value if sent is not None else None
        for batch in batches:
            weights = None if weight is None else batch[weight].fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            for row, _, _, code in windows(batch["seq"], k):
                seen += len(code)
                if lookup is not None:
                    own = lookup.chosen(code)
                    row, code = row[own], code[own]
                if tally.add(code, None if weights is None else weights[row]):
                    yield from chunks(*tally.out())
            for row, kmer in _other_windows(batch["seq"], k):
                seen += 1
                if lookup is None or kmer in lookup.others:
                    others[kmer] += 1 if weights is None else weights[row].item()
            if len(others) > SPAN // 8:
                yield rest(others, 0)
                others.clear()
        yield from chunks(*tally.out())
        yield rest(others, seen)

    def rest(others: Counter, seen: int) -> pa.RecordBatch:
        rows = [{"bucket": BUCKETS + hash_of(x) % BUCKETS, "kmer": x, "times": n, "seen": 0} for x, n in others.items()]
        return pa.RecordBatch.from_pylist([*rows, {"bucket": -1, "seen": seen}], schema)

    columns = [F.col(seq).alias("seq"), *([F.col(weight).cast("double" if real else "long").alias(weight)] if weight else [])]
    return reads.select(*columns).mapInArrow(pack, COUNTS.format("double" if real else "long"))


def hash_of(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode())


def summed(chunks: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of read_chunks."""
    real = chunks.schema["times"].dataType.typeName() == "double"
    kind = np.float64 if real else np.int64

    def each(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            plain = table.filter(table["codes"].is_valid())
            if len(plain):
                code, n = flat(plain["codes"])[0].view(kind_of(k)), flat(plain["n"])[0].view(kind)
                order = np.argsort(code, kind="stable")
                code, n = code[order], n[order]
                once = _starts(code)
                code, n = code[once], np.add.reduceat(n, once)
                for s in _sliced(len(code)):
                    yield pa.RecordBatch.from_arrays([spelled(code[s], k), pa.array(n[s])], ["kmer", "n"])
            others = table.filter(table["kmer"].is_valid())
            if len(others):
                some = others.group_by("kmer").aggregate([("times", "sum")])
                yield from some.rename_columns({"times_sum": "n"}).select(["kmer", "n"]).combine_chunks().to_batches()

    return by_bucket(chunks, each, f"kmer string, n {'double' if real else 'long'}")


def unpacked(chunks: DataFrame, k: int) -> DataFrame:
    """(kmer, n) of read_chunks as they are, not summed."""
    real = chunks.schema["times"].dataType.typeName() == "double"
    kind = np.float64 if real else np.int64

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n = flat(batch["codes"])[0].view(kind_of(k)), flat(batch["n"])[0].view(kind)
            for s in _sliced(len(code)):
                yield pa.RecordBatch.from_arrays([spelled(code[s], k), pa.array(n[s])], ["kmer", "n"])
            others = batch.filter(batch["kmer"].is_valid())
            yield pa.RecordBatch.from_arrays([others["kmer"], others["times"]], ["kmer", "n"])

    return chunks.mapInArrow(each, f"kmer string, n {'double' if real else 'long'}")

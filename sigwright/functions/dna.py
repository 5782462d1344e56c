"""Column functions on sequences. All are built-in expressions: nothing leaves the JVM.

Strings compare by bytes. Letters other than A, C, G and T pass through unchanged. Nulls give nulls unless a
function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def orientations(seq: Column) -> Column:
    """Forward, reverse, reverse complement and complement; equal ones stay, so palindromes count twice."""
    return F.array(seq, F.reverse(seq), reverse_complement(seq), complement(seq))


def canonical(seq: Column) -> Column:
    """The smallest of the four orientations."""
    return F.least(seq, F.reverse(seq), reverse_complement(seq), complement(seq))


def split_record(text: Column) -> Column:
    """Parts between ``|`` or line breaks; one empty part at the end is dropped, an empty text has none."""
    parts = F.split(F.regexp_replace(text, "[|\n]\\z", ""), "[|\n]")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


def record_id(header: Column) -> Column:
    """A header without its mark."""
    return F.substr(header, F.lit(2))


def chromosome_name(header: Column) -> Column:
    """A header up to its first blank."""
    return F.substring_index(header, " ", 1)


def gtf_items(extra: Column) -> Column:
    """array<string> of a GTF line's attributes, names with values, quoted or not: what stands inside quotes is no attribute.
    A line's items are found once, for all names that are looked up in them."""
    return F.regexp_extract_all(extra, F.lit("[^\\s\";]+\\s+(?:\"[^\"]*\"|[^\";]*)"), F.lit(0))


def gtf_value(items: Column, name: str) -> Column:
    """The quoted value of the first of gtf_items with exactly this name; null where it is missing or empty. A longer name that
    begins alike is another one."""
    own = F.filter(items, lambda x: x.startswith(name) & F.substr(x, F.lit(len(name) + 1), F.lit(1)).isin(*" \t\n\v\f\r"))
    return F.nullif(F.regexp_extract(F.get(own, F.lit(0)), "\\A[^\\s\";]+ *\"([^\"]*)\"", 1), F.lit(""))


def gtf_attribute(extra: Column, name: str) -> Column:
    """gtf_value of a text that is read from its start."""
    return gtf_value(gtf_items(extra), name)


def mean_quality(quality: Column) -> Column:
    """The mean of the Phred qualities that a FASTQ line writes (codes from 33 on); null for an empty one."""
    codes = F.transform(F.sequence(F.lit(1), F.char_length(quality)), lambda i: F.ascii(F.substr(quality, i, F.lit(1))) - 33)
    return F.when(quality != "", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x) / F.char_length(quality))


def kmers(seq: Column, k: int, include_last: bool = False) -> Column:
    """array<struct<pos, kmer>> of windows from position 0. The last window belongs to it only if asked for:
    indexes leave it out, reads have it."""
    last = F.char_length(seq) - k + (1 if include_last else 0)
    windows = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("pos"), F.substr(seq, i + 1, F.lit(k)).alias("kmer")))
    return F.when(last >= 1, windows).otherwise(F.filter(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("kmer"))), lambda _: F.lit(False)))


def even_samples(seq: Column, k: int, n: int = 20) -> Column:
    """n substrings of length k at even steps from position k div 2 + 1.

    The step is (length - 2k) div (n - 1). For shorter sequences that quotient is taken of the difference
    modulo 2**64 and cut to a signed 32-bit number, of which only positive values count: in general a step far
    beyond the end, so that the first sample stands alone. Samples that begin behind the end are left out;
    those at the end may be short.
    """
    length = F.char_length(seq)
    q, r = divmod(1 << 64, n - 1)
    wrapped = F.pmod(F.lit(q % (1 << 32)) + F.floor((length - 2 * k + r) / (n - 1)), F.lit(1 << 32))
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    step = F.greatest(F.lit(0), F.when(length >= 2 * k, F.floor((length - 2 * k) / (n - 1))).otherwise(signed))
    offsets = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * step + (k // 2 + 1)), lambda o: o <= length)
    return F.transform(offsets, lambda o: F.substr(seq, (o + 1).cast("int"), F.lit(k)))


def stride(length: Column, keys_per_region: int) -> Column:
    """Step between the keys of a transcript: longer for fewer keys, never below 10."""
    m = keys_per_region
    fair = F.when(length >= 20, F.floor((length - 20) / m)).otherwise(F.ceil((length - 20) / m))
    return F.greatest(F.lit(10), F.least(F.lit(50 + (10 - m) * 10), fair)).cast("int")


def region_offsets(n_windows: Column, step: Column, start: int = 20) -> Column:
    """Offsets of keys in a region of n_windows windows; regions of ``start`` windows or fewer have none."""
    return F.when(n_windows > start, F.sequence(F.lit(start), (n_windows - 1).cast("int"), step.cast("int"))).otherwise(F.array().cast("array<int>"))


def all_positions(seq: Column, key: Column) -> Column:
    """Positions from 0 of all, also overlapping, occurrences of key."""
    last = F.char_length(seq) - F.char_length(key)
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.substr(seq, i + 1, F.char_length(key)) == key)
    return F.when(last >= 0, found).otherwise(F.array().cast("array<int>"))


def key_weight(positions: Column) -> Column:
    """The weight of a key in a transcript: how often it stands there."""
    return F.size(positions)


def covering_starts(length: Column, position: Column, k: int, fragment: int = 180, read: int = 95) -> Column:
    """From how many starts a read of a fragment covers the k-mer at a position."""
    room = length - fragment + read - k
    ways = F.least(position + 1, F.lit(read - k + 1), room - position + 1)
    return F.when(position > room, F.lit(0)).otherwise(ways)


def scaled_reads(x: Column, read_length: int, k: int) -> Column:
    """Reads behind x counted k-mers: a read of L bases counts L - k of them."""
    return x / (read_length - k)


def rpkm(reads: Column, length: Column, total_reads: Column) -> Column:
    """Reads per kilobase and million; 0 where there are no reads at all or the length is 0."""
    return F.when((total_reads > 0) & (length > 0), reads / (length / 1000.0) / (total_reads / 1e6)).otherwise(F.lit(0.0))


def tpm(reads: Column, length: Column, total_density: Column) -> Column:
    """Transcripts per million; 0 where there are no reads at all or the length is 0."""
    return F.when((total_density > 0) & (length > 0), reads / length / total_density * 1e6).otherwise(F.lit(0.0))


def float_range(start: float, stop: float, step: float) -> Column:
    """array<double> from start in steps below stop."""
    n = max(0, -int(-(stop - start) // step))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lit(float(start)) + (i - 1) * F.lit(float(step))) if n else F.array().cast("array<double>")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def zero_mean(values: Column) -> Column:
    """Aggregate: the mean, or 0 if any value is 0."""
    return F.when(F.min(values) == 0, F.lit(0.0)).otherwise(F.avg(values))


def share_of(value: Column, total: Column) -> Column:
    """value / total, 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(value / total)


def polynomial_hash(text: Column, base: int = 33) -> Column:
    """sum of code * base ** (characters behind it), modulo 2**32, as a long."""
    codes = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("long"))
    return F.when(F.char_length(text) > 0, F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * base + c) % (1 << 32))).otherwise(F.lit(0).cast("long"))


def polynomial_roll(h: Column, size: int, incoming: Column, outgoing: Column, base: int = 33) -> Column:
    """The hash of a window of ``size`` characters after one came in and one went out."""
    gone = F.ascii(outgoing).cast("long") * (pow(base, size, 1 << 32)) % (1 << 32)
    return F.pmod(h * base + F.ascii(incoming) - gone, F.lit(1 << 32))


def last_index(text: Column, part: Column) -> Column:
    """Position from 0 of the last occurrence of part; -1 where there is none."""
    at = F.instr(F.reverse(text), F.reverse(part))
    return F.when(at > 0, F.char_length(text) - F.char_length(part) - at + 1).otherwise(F.lit(-1))

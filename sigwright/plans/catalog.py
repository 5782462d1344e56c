"""Registered queries of the library's own operators and their SQL equivalents.

Every query runs one operator over whole tables. The SQL is built from common table expressions of its own
and shares nothing with the operators but the definition of the synthetic sequences.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwright.functions import bloom, dna
from sigwright.operators import count, estimate, index, kmers, prepare, select, similarity
from sigwright.operators.ranges import prefix_sums
from sigwright.options import ClusterOptions, EstimateOptions, SelectOptions
from sigwright.plans import synth
from sigwright.plans.stages import Keys, build_keys
from sigwright.runtime import Cut, cut, made, release_memory, release_shuffles, scratch, shuffle_partitions, table
from sigwright.sources import framed, store, text
from sigwright.streaming.counts import CountJob, EstimateJob

K, M, READ = synth.K, synth.KEYS_PER_REGION, synth.READ
ROUNDS = 5
OPTIONS = EstimateOptions(k=K, read_length=READ)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _with(sql)
        return f

    return add


# ---- common table expressions -------------------------------------------------------------------------


def _dna(x: str) -> str:
    return f"translate(md5({x}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _comp(x: str) -> str:
    return f"translate({x}, 'ACGT', 'TGCA')"


def _canon(x: str) -> str:
    return f"least({x}, reverse({x}), reverse({_comp(x)}), {_comp(x)})"


def _four(x: str) -> str:
    return f"[{x}, reverse({x}), reverse({_comp(x)}), {_comp(x)}]"


def _attribute(name: str) -> str:
    """SQL of a quoted attribute: text between quotes is every other part, and the part before it ends in the name."""
    odd = f"list_filter(range(1, len(string_split(p[9], chr(34)))), lambda i: i % 2 = 1 AND regexp_full_match(string_split(p[9], chr(34))[i], '(.*[; ])?{name} +'))"
    return f"nullif(string_split(p[9], chr(34))[{odd}[1] + 1], '')"


_GID = "p_name || '#' || p_brand"
_SEQ = " || ".join((_dna("p_brand"), _dna(f"'g' || {_GID}"), _dna("'p' || p_partkey"), _dna("'q' || p_partkey")))
_READ_SQL = f"substring(seq, CAST(1 + (({{start}}) % (len(seq) - {READ} + 1)) AS BIGINT), {READ})"
#: name: (what it reads, SQL)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "tx": ((), f"SELECT {_GID} AS gid, CAST(row_number() OVER (PARTITION BY {_GID} ORDER BY p_partkey) - 1 AS INTEGER) AS tidx, 'T' || p_partkey AS tid, {_SEQ} AS seq FROM part"),
    "win": (("tx",), f"SELECT gid, tidx, CAST(pos AS INTEGER) AS pos, substring(seq, pos + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, len(seq) - {K})) AS pos FROM tx)"),
    "gk": (("tx",), f"SELECT DISTINCT gid, substring(s, pos + 1, {K}) AS kmer FROM (SELECT gid, s, unnest(range(0, len(s) - {K})) AS pos FROM (SELECT gid, unnest({_four('seq')}) AS s FROM tx))"),
    "dup": (("gk",), "SELECT kmer, count(*) AS n_genes FROM gk GROUP BY kmer HAVING count(*) >= 2"),
    "sig": (("win", "dup"), "SELECT * FROM win WHERE kmer NOT IN (SELECT kmer FROM dup)"),
    "reg": (("sig", "tx"), f"""SELECT i.gid, i.tidx, t.tid, CAST(len(t.seq) AS INTEGER) AS length, i.position, i.n_windows, substring(t.seq, i.position + 1, i.n_windows + {K}) AS seq
        FROM (SELECT gid, tidx, min(pos) AS position, CAST(count(*) AS INTEGER) AS n_windows
              FROM (SELECT *, pos - row_number() OVER (PARTITION BY gid, tidx ORDER BY pos) AS island FROM sig) GROUP BY gid, tidx, island) i
        JOIN tx t ON t.gid = i.gid AND t.tidx = i.tidx"""),
    "keys": (("reg",), f"""SELECT DISTINCT gid, {_canon('s')} AS key FROM (
        SELECT gid, substring(seq, o + 1, {K}) AS s FROM (
          SELECT gid, seq, unnest(range(20, len(seq) - {K}, greatest(10, least({50 + (10 - M) * 10}, CAST(trunc((length - 20) / {M}) AS BIGINT))))) AS o FROM reg WHERE len(seq) - {K} > 20))"""),
    "okey": (("keys",), f"SELECT gid, key, unnest({_four('key')}) AS kmer FROM keys"),
    "occ": (("okey", "reg"), f"""SELECT o.gid, o.key, r.tidx, CAST(r.position + r.p AS INTEGER) AS position FROM okey o
        JOIN (SELECT gid, tidx, position, p, substring(seq, p + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, len(seq) - {K})) AS p FROM reg)) r ON r.gid = o.gid AND r.kmer = o.kmer"""),
    "perk": (("occ",), "SELECT gid, tidx, count(DISTINCT key) AS n_keys FROM occ GROUP BY gid, tidx"),
    "kpos": (("occ", "perk"), "SELECT o.* FROM occ o JOIN perk USING (gid, tidx) WHERE n_keys > 2"),
    "r1": ((), f"""SELECT l_orderkey * 10 + l_linenumber AS read_id, CASE WHEN l_linenumber = 7 THEN left(s, 29) || 'N' || substring(s, 31) ELSE s END AS seq
        FROM (SELECT l_orderkey, l_linenumber, {_READ_SQL.format(start='l_orderkey')} AS s FROM lineitem JOIN (SELECT p_partkey, {_SEQ} AS seq FROM part) ON l_partkey = p_partkey)"""),
    "r2": ((), f"SELECT reverse({_comp('s')}) AS seq FROM (SELECT {_READ_SQL.format(start='l_suppkey + l_orderkey')} AS s FROM lineitem JOIN (SELECT p_partkey, {_SEQ} AS seq FROM part) ON l_partkey = p_partkey)"),
    "rk": (("r1",), f"SELECT kmer FROM (SELECT substring(seq, p + 1, {K}) AS kmer FROM (SELECT seq, unnest(range(0, len(seq) - {K} + 1)) AS p FROM r1)) WHERE kmer NOT LIKE '%N%'"),
    "kc": (("okey", "rk"), "SELECT gid, key, CAST(sum(coalesce(n, 0)) AS BIGINT) AS count FROM okey LEFT JOIN (SELECT kmer, count(*) AS n FROM rk GROUP BY kmer) USING (kmer) GROUP BY gid, key"),
    "cls": (("kc", "kpos", "tx"), """SELECT gid, weights, CAST(sum(count) AS BIGINT) AS total_counts, count(*) AS occurrences FROM (
        SELECT kc.gid, kc.key, any_value(kc.count) AS count, list(coalesce(w.n, 0) ORDER BY t.tidx) AS weights
        FROM kc JOIN tx t ON t.gid = kc.gid LEFT JOIN (SELECT gid, key, tidx, count(*) AS n FROM kpos GROUP BY ALL) w ON w.gid = kc.gid AND w.key = kc.key AND w.tidx = t.tidx
        GROUP BY kc.gid, kc.key) GROUP BY gid, weights"""),
    "cw": (("cls",), "SELECT * FROM (SELECT gid, weights, total_counts, occurrences, CAST(unnest(range(0, len(weights))) AS INTEGER) AS tidx, unnest(weights) AS w FROM cls) WHERE w > 0"),
    "kt": (("cw",), "SELECT gid, tidx, CAST(sum(w * occurrences) AS BIGINT) AS n_kmers FROM cw GROUP BY gid, tidx"),
    "live": (("cls",), "SELECT gid FROM cls GROUP BY gid HAVING max(total_counts) > 0"),
    "even": (("tx", "live"), "SELECT gid, tidx, 1.0 / count(*) OVER (PARTITION BY gid) AS pi FROM tx WHERE gid IN (SELECT gid FROM live)"),
    "smp": (("tx",), f"""SELECT gid, substring(seq, o + 1, {K}) AS kmer FROM (
        SELECT gid, seq, {K // 2 + 1} + i * ((len(seq) - {2 * K}) // 19) AS o FROM (SELECT *, unnest(range(0, 20)) AS i FROM tx))"""),
    "cont": (("smp", "gk"), """SELECT s.gid AS gid1, g.gid AS gid2, count(*) AS dup, any_value(t.total) AS total FROM smp s JOIN gk g ON g.kmer = s.kmer AND g.gid <> s.gid
        JOIN (SELECT gid, count(*) AS total FROM smp GROUP BY gid) t ON t.gid = s.gid GROUP BY s.gid, g.gid"""),
    "edge": (("cont",), "SELECT DISTINCT least(gid1, gid2) AS src, greatest(gid1, gid2) AS dst FROM cont WHERE dup / total >= 0.1"),
    "gene": (("tx",), "SELECT CAST(row_number() OVER (ORDER BY gid) - 1 AS BIGINT) AS idx, gid FROM (SELECT DISTINCT gid FROM tx)"),
    "iedge": (("edge", "gene"), "SELECT a.idx AS a, b.idx AS b FROM edge JOIN gene a ON a.gid = src JOIN gene b ON b.gid = dst UNION ALL SELECT b.idx, a.idx FROM edge JOIN gene a ON a.gid = src JOIN gene b ON b.gid = dst"),
    "reach": (("iedge", "gene"), "SELECT idx, idx AS other FROM gene UNION SELECT r.idx, e.b FROM reach r JOIN iedge e ON e.a = r.other"),
    "root": (("reach",), "SELECT idx, min(other) AS root FROM reach GROUP BY idx"),
    "gtfl": ((), f"""SELECT p_partkey * 3 + e AS line, concat_ws(chr(9), CASE WHEN p_partkey % 13 = 0 THEN 'GL1' ELSE CAST(len({_GID}) % 3 + 1 AS VARCHAR) END, 'synth', CASE WHEN (p_partkey + e) % 4 = 0 THEN 'CDS' ELSE 'exon' END,
          CAST((p_partkey * 37 + e * 101) % 1900 + 1 AS VARCHAR), CAST((p_partkey * 37 + e * 101) % 1900 + 1 + p_size % 40 + 9 AS VARCHAR), '.', CASE WHEN len({_GID}) % 2 = 0 THEN '+' ELSE '-' END, '.',
          concat(CASE WHEN p_partkey % 17 = 0 THEN 'ref_gene_id "R1"; note "x; gene_id "; ' ELSE '' END, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'gene_id "' || {_GID} || '"; ' END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'gene_name "' || p_name || '"; ' END,
                 'transcript_id "T' || p_partkey || '"; gene_biotype "' || CASE WHEN p_partkey % 7 = 0 THEN 'pseudogene' ELSE 'protein_coding' END || '";')) AS value
        FROM (SELECT *, unnest(range(0, 3)) AS e FROM part)"""),
    "gtf": (("gtfl",), f"""SELECT line, p[1] AS seqname, p[3] AS feature, CAST(p[4] AS INTEGER) AS "start", CAST(p[5] AS INTEGER) AS "end", p[7] AS strand,
        {_attribute('gene_id')} AS gid, coalesce({_attribute('gene_name')}, {_attribute('gene_id')}) AS gname, {_attribute('transcript_id')} AS tid, {_attribute('gene_biotype')} AS biotype
        FROM (SELECT line, string_split(value, chr(9)) AS p FROM gtfl)"""),
    "exon": (("gtf",), """SELECT gid, gname, tid, seqname, strand, "start", "end" + 1 AS "end", line FROM gtf WHERE feature = 'exon' AND gid IS NOT NULL AND biotype = 'protein_coding'"""),
    "geno": ((), f"SELECT CAST(c AS VARCHAR) AS seqname, string_agg(s, '' ORDER BY n_nationkey) AS seq FROM (SELECT n_nationkey % 3 + 1 AS c, n_nationkey, {' || '.join(_dna(chr(39) + f'n{i}-' + chr(39) + ' || n_nationkey') for i in range(8))} AS s FROM nation) WHERE c < 3 GROUP BY c"),
    "oex": (("exon",), """SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS ord, CAST(coalesce(sum("end" - "start") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM exon WINDOW w AS (PARTITION BY gid, tid ORDER BY CASE WHEN strand = '+' THEN line ELSE -line END)"""),
}


def _rounds(mark: str, classes: str, begin: str) -> None:
    """Adds ROUNDS rounds over the class weights ``classes`` from the shares ``begin``, as pi<mark><round>, and their result
    em<mark>."""
    _CTES[f"pi{mark}0"] = ((begin,), f"SELECT gid, tidx, pi, 0.0::DOUBLE AS found FROM {begin}")
    for i in range(ROUNDS):
        _CTES[f"part{mark}{i}"] = ((classes, "kt", f"pi{mark}{i}"), f"SELECT c.gid, weights, total_counts, c.tidx, w * occurrences / n_kmers * pi AS x, sum(w * occurrences / n_kmers * pi) OVER (PARTITION BY c.gid, weights) AS s FROM {classes} c JOIN kt USING (gid, tidx) JOIN pi{mark}{i} p ON p.gid = c.gid AND p.tidx = c.tidx")
        _CTES[f"sum{mark}{i}"] = ((f"part{mark}{i}",), f"SELECT gid, tidx, sum(CASE WHEN s > 0 THEN total_counts * x / s ELSE 0 END) AS found FROM part{mark}{i} GROUP BY gid, tidx")
        _CTES[f"pi{mark}{i + 1}"] = ((f"sum{mark}{i}", f"pi{mark}{i}"), f"SELECT gid, tidx, CASE WHEN all_found > 0 THEN found / all_found ELSE 0 END AS pi, found FROM (SELECT *, sum(found) OVER (PARTITION BY gid) AS all_found FROM (SELECT p.gid, p.tidx, CASE WHEN coalesce(s.found, 0) < 1e-7 THEN 0 ELSE s.found END AS found FROM pi{mark}{i} p LEFT JOIN sum{mark}{i} s ON s.gid = p.gid AND s.tidx = p.tidx))")
    _CTES[f"em{mark}"] = ((f"pi{mark}{ROUNDS}", "kt"), f"SELECT p.gid, p.tidx, p.found, coalesce(p.found / k.n_kmers, 0) AS density FROM pi{mark}{ROUNDS} p LEFT JOIN kt k ON k.gid = p.gid AND k.tidx = p.tidx")


_rounds("", "cw", "even")
# reads in two batches, those with even ids first: counts and estimates after the first, and what the second touches
for _m, _of in (("a", "read_id % 2 = 0"), ("b", "read_id % 2 = 1")):
    _CTES[f"r1{_m}"] = (("r1",), f"SELECT * FROM r1 WHERE {_of}")
    for _name in ("rk", "kc", "cls", "cw", "live"):
        _below, _text_of = _CTES[_name]
        for _other in ("r1", "rk", "kc", "cls"):
            _text_of = re.sub(rf"\b{_other}\b", f"{_other}{_m}", _text_of)
        _CTES[f"{_name}{_m}"] = (tuple(f"{x}{_m}" if x in ("r1", "rk", "kc", "cls") else x for x in _below), _text_of)
_CTES["evena"] = (("tx", "livea"), "SELECT gid, tidx, 1.0 / count(*) OVER (PARTITION BY gid) AS pi FROM tx WHERE gid IN (SELECT gid FROM livea)")
_rounds("a", "cwa", "evena")
_CTES["evenb"] = (("tx", "liveb", "ema"), "SELECT gid, tidx, CASE WHEN whole > 0 THEN density / whole ELSE fair END AS pi FROM (SELECT t.gid, t.tidx, 1.0 / count(*) OVER (PARTITION BY t.gid) AS fair, coalesce(density, 0) AS density, sum(coalesce(density, 0)) OVER (PARTITION BY t.gid) AS whole FROM tx t LEFT JOIN ema e ON e.gid = t.gid AND e.tidx = t.tidx WHERE t.gid IN (SELECT gid FROM liveb))")
_rounds("b", "cw", "evenb")
_CTES["online"] = (("ema", "emb"), "SELECT * FROM emb UNION ALL SELECT * FROM ema WHERE gid NOT IN (SELECT gid FROM emb)")
_CTES["settled"] = (("cw", "kt", "even"), """SELECT gid, tidx, pi, 0.0::DOUBLE AS found, CAST(0 AS BIGINT) AS it, true AS active FROM even
  UNION ALL SELECT gid, tidx, new_pi, found, it + 1, max(abs(new_pi - pi)) OVER (PARTITION BY gid) >= 1e-10 AND it < 500000
  FROM (SELECT *, CASE WHEN sum(found) OVER (PARTITION BY gid) > 0 THEN found / sum(found) OVER (PARTITION BY gid) ELSE 0 END AS new_pi
    FROM (SELECT gid, tidx, pi, it, CASE WHEN coalesce(sum(y), 0) < 1e-7 THEN 0 ELSE sum(y) END AS found
      FROM (SELECT gid, tidx, pi, it, CASE WHEN s > 0 THEN total_counts * x / s ELSE 0 END AS y
        FROM (SELECT e.gid, e.tidx, e.pi, e.it, c.total_counts, c.w * c.occurrences / k.n_kmers * e.pi AS x, sum(c.w * c.occurrences / k.n_kmers * e.pi) OVER (PARTITION BY e.gid, c.weights) AS s
          FROM settled e LEFT JOIN kt k ON k.gid = e.gid AND k.tidx = e.tidx LEFT JOIN cw c ON c.gid = e.gid AND c.tidx = e.tidx WHERE e.active))
      GROUP BY gid, tidx, pi, it))""")


def _with(sql: str) -> str:
    """sql behind the expressions that it names as {name}, and those they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in _CTES[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in _CTES:
        if "{" + name + "}" in sql:
            visit(name)
            sql = sql.replace("{" + name + "}", name)
    if not order:
        return sql
    recursive = "RECURSIVE " * bool({"reach", "settled"} & set(order))
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order) + "\n" + sql


# ---- what several queries begin with ------------------------------------------------------------------


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.transcripts(spark, sf_dir)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.signature_regions(_tx(spark, sf_dir), K)


def _built(spark: SparkSession, sf_dir: str) -> Keys:
    return build_keys(cut(_tx(spark, sf_dir), "transcripts"), SelectOptions(K, M))


def _classes(spark: SparkSession, sf_dir: str) -> tuple[Keys, DataFrame]:
    built = _built(spark, sf_dir)
    counts = count.key_counts(built.keys, synth.first_mates(spark, sf_dir), K)
    return built, cut(estimate.weight_classes(counts, built.positions, built.transcripts), "classes")


def _text() -> F.Column:
    return F.concat_ws(",", estimate.dense_weights(F.col("n"), F.col("entries")).cast("array<string>")).alias("weights")


# ---- scalar functions ---------------------------------------------------------------------------------


@register(f"SELECT tid, {_comp('seq')} AS seq FROM {{tx}}")
def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).select("tid", dna.complement(F.col("seq")).alias("seq"))


@register(f"SELECT tid, reverse({_comp('seq')}) AS seq FROM {{tx}}")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).select("tid", dna.reverse_complement(F.col("seq")).alias("seq"))


@register(f"SELECT tid, CAST(i AS INTEGER) AS i, seq FROM (SELECT tid, unnest(range(0, 4)) AS i, unnest({_four('seq')}) AS seq FROM {{tx}})")
def orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).select("tid", F.posexplode(dna.orientations(F.col("seq"))).alias("i", "seq"))


@register(f"SELECT gid, tidx, pos, {_canon('kmer')} AS kmer FROM {{win}}")
def canonical_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.windows(_tx(spark, sf_dir), K).withColumn("kmer", dna.canonical(F.col("kmer")))


_RECORD = "CASE p_partkey % 5 WHEN 0 THEN p_name || '|' WHEN 1 THEN p_name || '||' || p_brand WHEN 2 THEN '' WHEN 3 THEN p_name || chr(10) || p_brand || '|' ELSE '|' || p_type END"


@register(f"""SELECT p_partkey, CAST(len(parts) AS INTEGER) AS n, array_to_string(parts, ',') AS parts FROM (
  SELECT p_partkey, CASE WHEN x = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(CASE WHEN right(x, 1) IN ('|', chr(10)) THEN left(x, len(x) - 1) ELSE x END, '[|\n]') END AS parts
  FROM (SELECT p_partkey, {_RECORD} AS x FROM part))""")
def split_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", dna.split_record(F.expr(_RECORD.replace("chr(10)", "'\\n'"))).alias("p"))
    return parts.select("p_partkey", F.size("p").alias("n"), F.array_join("p", ",").alias("parts"))


@register(f"""SELECT tid, n, CAST(i AS INTEGER) AS i, substring(seq, o + 1, {K}) AS sample FROM (
  SELECT tid, n, seq, i, {K // 2 + 1} + i * (CASE WHEN n < {2 * K} THEN 1000000 ELSE (n - {2 * K}) // 19 END) AS o
  FROM (SELECT tid, left(seq, n) AS seq, n, unnest(range(0, 20)) AS i FROM (SELECT tid, seq, CAST(unnest([1 + substring(tid, 2)::BIGINT % 70, len(seq)]) AS INTEGER) AS n FROM {{tx}}))) WHERE o <= n""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences, and besides them short ones, which have a rule of their own."""
    short = (1 + F.substr("tid", F.lit(2)).cast("long") % 70).cast("int")
    both = _tx(spark, sf_dir).select("tid", "seq", F.explode(F.array(short, F.char_length("seq"))).alias("n"))
    return both.select("tid", "n", F.substr("seq", F.lit(1), F.col("n")).alias("seq")).select("tid", "n", F.posexplode(dna.even_samples(F.col("seq"), K)).alias("i", "sample"))


@register("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, m, CAST(greatest(10, least(50 + (10 - m) * 10, CAST(trunc((p_partkey - 20) / m) AS BIGINT))) AS INTEGER) AS stride FROM (SELECT p_partkey, CAST(unnest([3, 5, 10, 14]) AS INTEGER) AS m FROM part)")
def stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    rows = [part.select("p_partkey", F.lit(m).alias("m"), dna.stride(F.col("p_partkey"), m).alias("stride")) for m in (3, 5, 10, 14)]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


@register("""WITH words AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS similarity FROM words a JOIN words b ON b.item_id = a.item_id + 1""")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    other = words.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("w").alias("v"))
    return words.join(other, F.col("item_id") == F.col("a")).select("a", "b", F.round(dna.jaccard(F.col("w"), F.col("v")), 9).alias("similarity"))


@register("""SELECT p_partkey, p_size, CAST(ceil(bits / 8.0) AS BIGINT) AS n_bytes, CAST(round(ln(2) * (CAST(ceil(bits / 8.0) AS BIGINT) * 8) / capacity) AS INTEGER) AS hashes,
  round(exp(-(CAST(ceil(bits / 8.0) AS BIGINT) * 8.0 / capacity) * ln(2) * ln(2)), 12) AS rate, CAST(floor(-(CAST(ceil(bits / 8.0) AS BIGINT) * 8 / ln(fp) * ln(2) * ln(2))) AS BIGINT) AS capacity
FROM (SELECT *, ceil(-(capacity * ln(fp)) / (ln(2) * ln(2))) AS bits FROM (SELECT p_partkey, p_size, p_partkey * 10 + 1 AS capacity, CAST(1.0 / (p_size * 100) AS DOUBLE) AS fp FROM part))""")
def bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") * 10 + 1).alias("items"), (1.0 / (F.col("p_size") * 100)).alias("fp"))
    rows = rows.withColumn("n_bytes", bloom.bytes_for(F.col("items"), F.col("fp")))
    n, items, fp = F.col("n_bytes"), F.col("items"), F.col("fp")
    return rows.select("p_partkey", "p_size", "n_bytes", bloom.hashes_for(n, items).alias("hashes"), F.round(bloom.rate_for(n, items), 12).alias("rate"), bloom.capacity_for(n, fp).alias("capacity"))


@register("SELECT gid, tidx, pos, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 13), lambda i: CAST(ascii(substring(kmer, i, 1)) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS BIGINT) AS hash FROM {win}")
def rolling_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.windows(_tx(spark, sf_dir), K).select("gid", "tidx", "pos", dna.polynomial_hash(F.col("kmer")).alias("hash"))


@register(f"""SELECT gid, tidx, pos, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 13), lambda i: CAST(ascii(substring(kmer, i, 1)) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS BIGINT) AS hash
FROM (SELECT gid, tidx, pos, substring(seq, pos + 2, {K}) AS kmer FROM (SELECT gid, tidx, seq, CAST(unnest(range(0, len(seq) - {K})) AS INTEGER) AS pos FROM {{tx}}))""")
def rolling_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kmers.windows(_tx(spark, sf_dir), K).join(_tx(spark, sf_dir).select("gid", "tidx", "seq"), ["gid", "tidx"])
    rolled = dna.polynomial_roll(dna.polynomial_hash(F.col("kmer")), K, F.substr("seq", F.col("pos") + K + 1, F.lit(1)), F.substr("kmer", F.lit(1), F.lit(1)))
    return rows.select("gid", "tidx", "pos", rolled.alias("hash"))


@register("SELECT tid, key, CAST(len(p) AS INTEGER) AS n, array_to_string(p, ',') AS positions FROM (SELECT tid, key, list_filter(range(0, len(seq) - len(key) + 1), lambda i: substring(seq, i + 1, len(key)) = key) AS p FROM (SELECT tid, seq, unnest(['A', 'ACG', 'AAAA']) AS key FROM {tx}))")
def find_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tx(spark, sf_dir).select("tid", "seq", F.explode(F.array(*map(F.lit, ("A", "ACG", "AAAA")))).alias("key"))
    found = rows.select("tid", "key", dna.all_positions(F.col("seq"), F.col("key")).alias("p"))
    return found.select("tid", "key", F.size("p").alias("n"), F.concat_ws(",", F.col("p").cast("array<string>")).alias("positions"))


@register("""SELECT CAST(l AS INTEGER) AS length, CAST(p AS INTEGER) AS position, CAST(CASE WHEN p > l - 180 + 95 - 40 THEN 0 ELSE least(p + 1, 56, l - 180 + 95 - p - 40 + 1) END AS INTEGER) AS ways
FROM (SELECT DISTINCT CAST(100 + p_partkey % 300 AS INTEGER) AS l, CAST(p_size AS INTEGER) AS p FROM part)""")
def covering_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((100 + F.col("p_partkey") % 300).cast("int").alias("length"), F.col("p_size").cast("int").alias("position")).distinct()
    return rows.withColumn("ways", dna.covering_starts(F.col("length"), F.col("position"), 40))


@register("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS i, round(0.5 + (i - 1) * 0.25, 6) AS x FROM (SELECT p_partkey, unnest(range(1, 7)) AS i FROM part)")
def float_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(dna.float_range(0.5, 2.0, 0.25)).alias("i", "x"))
    return rows.withColumn("x", F.round("x", 6))


@register("""SELECT tid, starts_with(seq, 'AC') AS starts, ends_with(seq, 'GT') AS ends, CAST(strpos(seq, 'GA') - 1 AS INTEGER) AS first_at,
  CAST(CASE WHEN strpos(reverse(seq), 'AG') = 0 THEN -1 ELSE len(seq) - 2 - strpos(reverse(seq), 'AG') + 1 END AS INTEGER) AS last_at, seq < reverse(seq) AS smaller, substring(seq, 4, 5) AS middle FROM {tx}""")
def string_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("seq")
    return _tx(spark, sf_dir).select(
        "tid", s.startswith("AC").alias("starts"), s.endswith("GT").alias("ends"), (F.instr(s, "GA") - 1).alias("first_at"), dna.last_index(s, F.lit("GA")).alias("last_at"), (s < F.reverse(s)).alias("smaller"), F.substr(s, F.lit(4), F.lit(5)).alias("middle")
    )


@register("SELECT p_brand, CASE WHEN min(p_size) = 1 THEN 0.0 ELSE round(avg(p_size - 1), 9) END AS mean, CAST(max(abs(p_size - 25)) AS INTEGER) AS spread FROM part GROUP BY p_brand")
def zero_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy("p_brand").agg(F.round(dna.zero_mean(F.col("p_size") - 1), 9).alias("mean"), F.max(F.abs(F.col("p_size") - 25)).cast("int").alias("spread"))


@register("SELECT p_partkey, CASE WHEN s = 0 THEN 0.0 ELSE round(x / s, 9) END AS share FROM (SELECT p_partkey, p_size % 7 AS x, sum(p_size % 7) OVER (PARTITION BY p_name) AS s FROM part)")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 7).alias("x"))
    total = part.groupBy("p_name").agg(F.sum("x").alias("s"))
    return part.join(total, "p_name").select("p_partkey", F.round(dna.share_of(F.col("x"), F.col("s")), 9).alias("share"))


# ---- k-mers, index, regions ---------------------------------------------------------------------------


@register("SELECT gid, tidx, pos, kmer FROM {win}")
def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.windows(_tx(spark, sf_dir), K)


@register("SELECT kmer, count(*) AS n FROM {rk} GROUP BY kmer")
def read_kmers_no_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count.all_counts(synth.first_mates(spark, sf_dir), K)


@register("SELECT gid, kmer FROM {gk}")
def gene_distinct_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmers.gene_kmers(_tx(spark, sf_dir), K)


@register("SELECT kmer, n_genes FROM {dup}")
def dup_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.duplicated_kmers(_tx(spark, sf_dir), K)


@register("SELECT gid, tidx, pos, kmer FROM {sig}")
def sigmer_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.signature_windows(_tx(spark, sf_dir), K)


@register("SELECT gid, tidx, tid, length, position, n_windows, seq FROM {reg}")
def sigmer_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir)


# ---- keys ---------------------------------------------------------------------------------------------


@register("SELECT gid, key FROM {keys}")
def selected_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.selected_keys(_regions(spark, sf_dir), K, M)


@register("SELECT gid, key, tidx, position FROM {kpos}")
def key_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).positions


@register("SELECT gid, tidx, n_keys FROM {perk} WHERE n_keys > 2")
def keys_per_transcript_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = cut(_regions(spark, sf_dir), "regions")
    return select.keys_per_transcript(select.key_occurrences(regions, select.selected_keys(regions, K, M), K)).filter("n_keys > 2")


@register("SELECT gid, tidx, n_keys FROM {perk} WHERE n_keys <= 2")
def skipped_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = cut(_regions(spark, sf_dir), "regions")
    return select.skipped_transcripts(select.key_occurrences(regions, select.selected_keys(regions, K, M), K))


@register(f"SELECT (SELECT count(*) FROM {{keys}}) AS selected, CAST(coalesce(sum(len(seq) - {K} + 1), 0) AS BIGINT) AS scanned FROM {{reg}}")
def select_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = cut(_regions(spark, sf_dir), "regions")
    return select.totals(regions, select.selected_keys(regions, K, M), K)


@register("""SELECT gid, key, coalesce(infos, '') AS infos FROM {keys} LEFT JOIN (
  SELECT gid, key, string_agg(tidx || ':' || positions, ';' ORDER BY tidx) AS infos FROM (SELECT gid, key, tidx, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM {kpos} GROUP BY ALL) GROUP BY gid, key) USING (gid, key)""")
def nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    info = F.transform("transcript_infos", lambda x: F.concat(x["tidx"].cast("string"), F.lit(":"), F.concat_ws(",", x["positions"].cast("array<string>"))))
    return select.nested_keys(built.keys, built.positions).select("gid", "key", F.array_join(info, ";").alias("infos"))


@register("SELECT k.gid, k.tidx, count(*) AS n FROM (SELECT gid, tidx, position + CASE WHEN tidx % 3 = 1 THEN 60 ELSE 0 END AS position FROM {kpos}) k JOIN {tx} t ON t.gid = k.gid AND t.tidx = k.tidx WHERE k.position >= len(t.seq) GROUP BY ALL")
def positions_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every third transcript are moved, so that there is something to find."""
    built = _built(spark, sf_dir)
    moved = built.positions.withColumn("position", F.col("position") + F.when(F.col("tidx") % 3 == 1, 60).otherwise(0))
    return select.out_of_bounds(moved, built.transcripts)


@register("""SELECT n.gid, array_to_string(tids, ',') AS tids, array_to_string(lengths, ',') AS lengths, keys FROM (
  SELECT gid, list(tid ORDER BY tidx) AS tids, list(len(seq) ORDER BY tidx) AS lengths FROM {tx} GROUP BY gid) n
JOIN (SELECT gid, string_agg(key || '=' || count || '@' || coalesce(infos, ''), ' ' ORDER BY key) AS keys FROM {kc} LEFT JOIN (
  SELECT gid, key, string_agg(tidx || ':' || positions, ';' ORDER BY tidx) AS infos FROM (SELECT gid, key, tidx, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM {kpos} GROUP BY ALL) GROUP BY gid, key) USING (gid, key) GROUP BY gid) USING (gid)""")
def key_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of counted keys, written as framed messages and read back."""
    built = _built(spark, sf_dir)
    records = select.key_records(count.key_counts(built.keys, synth.first_mates(spark, sf_dir), K), built.positions, built.transcripts)
    framed.register(spark)
    path = scratch(spark, "records")
    framed.encoded(records, "SelectedKey").write.format("framed").mode("append").save(path)
    info = lambda x: F.concat(x["tidx"].cast("string"), F.lit(":"), F.concat_ws(",", x["positions"].cast("array<string>")))
    one = lambda k: F.concat(k["key"], F.lit("="), k["count"].cast("string"), F.lit("@"), F.array_join(F.transform(k["transcript_infos"], info), ";"))
    back = framed.decoded(spark.read.format("framed").load(path), "SelectedKey")
    return back.select("gid", F.array_join("tids", ",").alias("tids"), F.concat_ws(",", F.col("lengths").cast("array<string>")).alias("lengths"), F.array_join(F.transform("keys", one), " ").alias("keys"))


@register("SELECT gid, key, tidx, CAST(count(*) AS INTEGER) AS weight FROM {kpos} GROUP BY ALL")
def key_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = _built(spark, sf_dir)
    nested = select.nested_keys(built.keys, built.positions).select("gid", "key", F.explode("transcript_infos").alias("i"))
    return nested.select("gid", "key", "i.tidx", dna.key_weight(F.col("i.positions")).alias("weight"))


# ---- counts -------------------------------------------------------------------------------------------


@register("SELECT gid, key, count FROM {kc}")
def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    return count.key_counts(keys, synth.first_mates(spark, sf_dir), K)


@register(f"""SELECT gid, key, CAST(sum(coalesce(n, 0)) AS BIGINT) AS count FROM {{okey}} LEFT JOIN (
  SELECT kmer, count(*) AS n FROM (SELECT substring(seq, p + 1, {K}) AS kmer FROM (SELECT seq, unnest(range(0, len(seq) - {K} + 1)) AS p FROM (SELECT seq FROM {{r1}} UNION ALL SELECT seq FROM {{r2}}))) WHERE kmer NOT LIKE '%N%' GROUP BY kmer) USING (kmer) GROUP BY gid, key""")
def key_counts_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    return count.key_counts(keys, count.both_mates(synth.first_mates(spark, sf_dir), synth.second_mates(spark, sf_dir)), K)


_QUALITY = "(33 + (read_id * 7 + {i} * 3) % 41)"


@register(f"""SELECT gid, key, CAST(sum(coalesce(n, 0)) AS BIGINT) AS count FROM {{okey}} LEFT JOIN (
  SELECT kmer, sum(weight) AS n FROM (SELECT weight, substring(seq, p + 1, {K}) AS kmer FROM (
    SELECT seq, weight, unnest(range(0, len(seq) - {K} + 1)) AS p FROM (
      SELECT seq, CAST(floor(list_avg(list_transform(range(0, len(seq)), lambda i: {_QUALITY.format(i='i')} - 33))) AS BIGINT) - 14 AS weight FROM {{r1}}) WHERE weight > 0)) WHERE kmer NOT LIKE '%N%' GROUP BY kmer) USING (kmer) GROUP BY gid, key""")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of keys in FASTQ reads, each read with a weight from its mean quality, or none."""
    path = scratch(spark, "fastq")
    codes = F.transform(F.sequence(F.lit(0), F.char_length("seq") - 1), lambda i: F.char(F.lit(33) + (F.col("read_id") * 7 + i * 3) % 41))
    record = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.array_join(codes, ""))
    synth.first_mates(spark, sf_dir).select(record.alias("value")).write.text(path)
    reads = text.weighed(text.fastq(spark, path), lambda seq, quality: F.floor(dna.mean_quality(quality)) - 14)
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    return count.key_counts(keys, reads, K, weight="weight")


@register("SELECT kmer, CAST(sum(n) AS BIGINT) AS n FROM (SELECT kmer, 0 AS n FROM {okey} UNION ALL SELECT kmer, 1 FROM {rk} WHERE kmer IN (SELECT kmer FROM {okey})) GROUP BY kmer")
def exact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    return count.exact_counts(count.oriented_keys(keys), synth.first_mates(spark, sf_dir), K)


@register("SELECT count(*) FILTER (kmer IN (SELECT kmer FROM {okey})) AS hits, count(*) FILTER (kmer NOT IN (SELECT kmer FROM {okey})) AS misses FROM {rk}")
def lookup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    return count.lookup_statistics(synth.first_mates(spark, sf_dir), count.oriented_keys(keys).select("kmer").distinct(), K)


#: A filter far too small for its keys, so that there are false positives to agree on.
_CAPACITY, _RATE = 2000, 0.1
_BITS, _HASHES = bloom.size_for(_CAPACITY, _RATE)


def _member_rows(name: str) -> str:
    """SQL of the rows of maybe_members for the k-mers of reads against a filter of oriented keys."""
    places = lambda x: f"unnest(list_transform(range(0, {_HASHES}), lambda i: ((('0x' || substring(md5({x}), 1, 15))::BIGINT % {_BITS}) + i * (('0x' || substring(md5({x}), 16, 15))::BIGINT % {_BITS})) % {_BITS}))"
    return f"""(SELECT kmer, bool_and(p IN (SELECT {places('kmer')} FROM {{okey}})) AS member FROM (SELECT kmer, {places('kmer')} AS p FROM (SELECT DISTINCT kmer FROM {{rk}})) GROUP BY kmer) {name}"""


@register(f"SELECT m.kmer, m.member FROM {_member_rows('m')}")
def bloom_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read k-mers against a Bloom filter of keys, false positives and all."""
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    bitmaps = bloom.filter_table(count.oriented_keys(keys), "kmer", _CAPACITY, _RATE)
    return bloom.maybe_members(count.all_counts(synth.first_mates(spark, sf_dir), K), "kmer", bitmaps, _CAPACITY, _RATE).withColumnRenamed("value", "kmer")


@register("SELECT count(*) FILTER (kmer IN (SELECT kmer FROM {okey})) AS wanted, 0::BIGINT AS missed, true AS few FROM (SELECT DISTINCT kmer FROM {rk})")
def bloom_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No wanted k-mer is missed by a filter of the right size, and of the others few pass: at most twice the rate, and 20."""
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    wanted = cut(count.oriented_keys(keys).select("kmer").distinct(), "wanted")
    n = max(1, wanted.count())
    found = bloom.maybe_members(count.all_counts(synth.first_mates(spark, sf_dir), K), "kmer", bloom.filter_table(wanted, "kmer", n, 0.01), n, 0.01)
    full = found.join(wanted.withColumn("wanted", F.lit(True)), found["value"] == wanted["kmer"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    passed = F.count_if(F.col("member") & ~F.col("wanted")) <= 20 + 0.02 * F.count_if(~F.col("wanted"))
    return full.agg(F.count_if("wanted").alias("wanted"), F.count_if(F.col("wanted") & ~F.col("member")).alias("missed"), passed.alias("few"))


@register(f"SELECT tid, CAST(i - 1 AS INTEGER) AS i, p FROM (SELECT tid, unnest(range(1, 8)) AS i, unnest(list_transform(range(0, 7), lambda i: ((('0x' || substring(md5(seq), 1, 15))::BIGINT % 1000003) + i * (('0x' || substring(md5(seq), 16, 15))::BIGINT % 1000003)) % 1000003)) AS p FROM {{tx}})")
def bloom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tx(spark, sf_dir).select("tid", F.posexplode(bloom.probe_positions(F.col("seq"), 7, 1_000_003)).alias("i", "p"))


@register("SELECT gid, key, count FROM {kc}")
def streaming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cut(select.selected_keys(_regions(spark, sf_dir), K, M), "keys")
    staged = Cut(synth.first_mates(spark, sf_dir).repartition(8), "reads")
    arriving = spark.readStream.schema(staged.df.schema).option("maxFilesPerTrigger", 4).parquet(staged.path)
    return CountJob(arriving, keys, K).finish()


# ---- estimates ----------------------------------------------------------------------------------------


@register("SELECT gid, array_to_string(weights, ',') AS weights, total_counts, occurrences FROM {cls}")
def weight_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)[1].select("gid", _text(), "total_counts", "occurrences")


@register("SELECT gid, tidx, n_kmers FROM {kt}")
def effective_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.effective_kmers(_classes(spark, sf_dir)[1])


@register("SELECT gid FROM {live}")
def counted_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimate.counted_genes(_classes(spark, sf_dir)[1])


@register("SELECT gid, tidx, round(found, 6) AS n_reads_kmers, round(density, 6) AS density FROM {em}")
def em_fixed_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estimate.estimate_genes(_classes(spark, sf_dir)[1], OPTIONS, ROUNDS)
    return rows.select("gid", "tidx", F.round("n_reads_kmers", 6).alias("n_reads_kmers"), F.round("density", 6).alias("density"))


@register("SELECT gid, round(sum(total_counts), 3) AS total, true AS settled FROM {cls} WHERE gid IN (SELECT gid FROM {live}) AND list_sum(weights) > 0 GROUP BY gid HAVING sum(total_counts) > 0")
def em_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converged estimates by what defines them: counts are conserved, and another round, as a DataFrame, moves nothing."""
    classes = _classes(spark, sf_dir)[1]
    found = cut(estimate.estimate_genes(classes, OPTIONS), "converged")
    again = estimate.one_round(classes, found.select("gid", "tidx", F.col("n_reads_kmers").alias("found")))
    both = found.join(again, ["gid", "tidx"], "left").withColumn("moved", F.abs(F.coalesce("again", F.lit(0.0)) - F.col("n_reads_kmers")))
    rows = both.groupBy("gid").agg(F.round(F.sum("n_reads_kmers"), 3).alias("total"), (F.max(F.col("moved")) <= F.lit(1e-6) * F.greatest(F.lit(1.0), F.sum("n_reads_kmers"))).alias("settled"))
    return rows.filter("total > 0")


@register("""SELECT e.gid, e.tidx, round(found, 4) AS n_reads_kmers, round(coalesce(found / n_kmers, 0), 6) AS density,
  round(CASE WHEN sum(coalesce(found / n_kmers, 0)) OVER (PARTITION BY e.gid) > 0 THEN coalesce(found / n_kmers, 0) / sum(coalesce(found / n_kmers, 0)) OVER (PARTITION BY e.gid) ELSE 0 END, 6) AS share
FROM {settled} e LEFT JOIN {kt} k ON k.gid = e.gid AND k.tidx = e.tidx WHERE NOT active""")
def em_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = estimate.estimate_genes(_classes(spark, sf_dir)[1], OPTIONS)
    return rows.select("gid", "tidx", F.round("n_reads_kmers", 4).alias("n_reads_kmers"), F.round("density", 6).alias("density"), F.round("share", 6).alias("share"))


@register("""SELECT a.gid, a.tidx AS covering, b.tidx AS covered FROM {tx} a JOIN {tx} b ON a.gid = b.gid AND a.tidx <> b.tidx
WHERE a.gid IN (SELECT gid FROM {cls}) AND NOT EXISTS (SELECT 1 FROM {cls} c WHERE c.gid = a.gid AND c.weights[a.tidx + 1] = 0 AND c.weights[b.tidx + 1] <> 0)""")
def covered_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, classes = _classes(spark, sf_dir)
    return estimate.covered_transcripts(classes, built.transcripts.join(classes.select("gid").distinct(), "gid", "left_semi"))


@register("""SELECT gid, round(sum(CASE WHEN p > 0 AND total_counts > 0 THEN total_counts * ln(p) ELSE 0.0 END), 6) AS log_likelihood FROM (
  SELECT cw.gid, cw.weights, total_counts, sum(1.0 / n * w * occurrences / n_kmers) AS p FROM {cw} cw JOIN {kt} USING (gid, tidx) JOIN (SELECT gid, count(*) AS n FROM {tx} GROUP BY gid) t ON t.gid = cw.gid GROUP BY ALL) GROUP BY gid""")
def loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, classes = _classes(spark, sf_dir)
    sizes = built.transcripts.groupBy("gid").agg(F.count("*").alias("n"))
    shares = built.transcripts.select("gid", "tidx").join(sizes, "gid").select("gid", "tidx", (1.0 / F.col("n")).alias("share"))
    return estimate.log_likelihood(classes, shares).select("gid", F.round("log_likelihood", 6).alias("log_likelihood"))


@register(f"""SELECT tid, CAST(length AS INTEGER) AS length, round(est_reads, 6) AS est_reads, round(CASE WHEN s > 0 THEN est_reads / (length / 1000.0) / (s / 1e6) ELSE 0 END, 4) AS rpkm,
  round(CASE WHEN d > 0 THEN est_reads / length / d * 1e6 ELSE 0 END, 4) AS tpm
FROM (SELECT *, sum(est_reads) OVER () AS s, sum(est_reads / length) OVER () AS d FROM (
  SELECT tid, length, (CASE WHEN x < 0.1 THEN 0 ELSE x END) / {READ - K} AS est_reads FROM (SELECT t.tid, len(t.seq) AS length, coalesce(e.density, 0) * len(t.seq) AS x FROM {{tx}} t LEFT JOIN {{em}} e ON e.gid = t.gid AND e.tidx = t.tidx)))""")
def rpkm_tpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, classes = _classes(spark, sf_dir)
    rows = estimate.abundance(built.transcripts, estimate.estimate_genes(classes, OPTIONS, ROUNDS), OPTIONS)
    return rows.select("tid", "length", F.round("est_reads", 6).alias("est_reads"), F.round("rpkm", 4).alias("rpkm"), F.round("tpm", 4).alias("tpm"))


# ---- similarity and clusters --------------------------------------------------------------------------


@register("SELECT gid1, gid2, dup, total FROM {cont}")
def containment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.containment(_tx(spark, sf_dir), K)


@register("SELECT src, dst FROM {edge}")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_edges(similarity.containment(_tx(spark, sf_dir), K))


def _roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tx = cut(_tx(spark, sf_dir), "transcripts")
    genes = cut(text.numbered_genes(tx), "genes")
    return tx, genes, similarity.clusters(genes, similarity.Overlaps(tx, K).links())


@register("SELECT idx, root FROM {root}")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roots(spark, sf_dir)[2]


@register("""SELECT h.gid, CAST(row_number() OVER (PARTITION BY r.root ORDER BY g.idx, t.tidx) - 1 AS INTEGER) AS tidx, t.tid, t.seq
FROM {tx} t JOIN {gene} g ON g.gid = t.gid JOIN {root} r ON r.idx = g.idx JOIN {gene} h ON h.idx = r.root""")
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, genes, roots = _roots(spark, sf_dir)
    return similarity.merged(tx, genes, roots)


# ---- annotations and genomes --------------------------------------------------------------------------


@register('SELECT line, seqname, feature, "start", "end", strand, gid, gname, tid, biotype FROM {gtf}')
def gtf_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_gtf(synth.gtf_lines(spark, sf_dir)).select("line", "seqname", "feature", "start", "end", "strand", "gid", "gname", "tid", "biotype")


def _exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.exon_rows(text.parse_gtf(synth.gtf_lines(spark, sf_dir)))


@register('SELECT gid, gname, tid, seqname, strand, "start", "end", line FROM {exon}')
def exon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exons(spark, sf_dir).drop("tname")


@register("""SELECT seqname, feature, "start", "end", strand, gid, gname, tid, biotype FROM {gtf} WHERE regexp_full_match(seqname, '[0-9]+|(X|Y|MT).*')""")
def main_chromosomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotation file, written and read, without what lies elsewhere."""
    path = scratch(spark, "gtf")
    synth.gtf_lines(spark, sf_dir).select("value").write.text(path)
    return text.gtf(spark, path, main_chromosomes=True).select("seqname", "feature", "start", "end", "strand", "gid", "gname", "tid", "biotype")


@register("SELECT gname AS gid, count(DISTINCT strand) AS n_strands FROM {exon} GROUP BY gname HAVING count(DISTINCT strand) > 1")
def mixed_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.mixed_strands(_exons(spark, sf_dir).withColumn("gid", F.col("gname")))


@register('SELECT gid, tid, line, ord, "offset" FROM {oex}')
def exon_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.ordered_exons(_exons(spark, sf_dir)).select("gid", "tid", "line", "ord", "offset")


_CONCAT = """SELECT gid, CAST(row_number() OVER (PARTITION BY gid ORDER BY line, tid) - 1 AS INTEGER) AS tidx, tid, seq, has_seq FROM (
  SELECT o.gid, o.tid, min(o.line) AS line, string_agg(coalesce(substring(g.seq, o."start", o."end" - o."start"), ''), '' ORDER BY o.ord) AS seq, bool_and(g.seq IS NOT NULL) AS has_seq
  FROM {oex} o LEFT JOIN {geno} g USING (seqname) GROUP BY o.gid, o.tid)"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genome is a file, read in blocks."""
    path = scratch(spark, "genome")
    text.write_genome(synth.genome(spark, sf_dir), path)
    return prepare.assembled(prepare.with_sequence(cut(_exons(spark, sf_dir), "exons"), text.genome_blocks(spark, path, prepare.BLOCK)))


@register(_CONCAT)
def exon_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assembled(spark, sf_dir)


@register("SELECT seqname, CAST(b AS BIGINT) AS block, substring(seq, b * 100 + 1, 100) AS bases FROM (SELECT seqname, seq, unnest(range(0, (len(seq) + 99) // 100)) AS b FROM {geno})")
def genome_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes in blocks that lines of the file do not fit."""
    path = scratch(spark, "genome")
    text.write_genome(synth.genome(spark, sf_dir).withColumn("seqname", F.concat("seqname", F.lit(" dna:chromosome x"))), path)
    return text.genome_blocks(spark, path, 100)


@register(f"SELECT gid, '>' || gid || '|' || string_agg(tid, '|' ORDER BY tidx) || chr(10) || string_agg(seq, '|' ORDER BY tidx) AS value FROM ({_CONCAT}) WHERE has_seq GROUP BY gid")
def gene_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.gene_records(_assembled(spark, sf_dir).filter("has_seq"))


@register(f"SELECT gid, sum(len(seq))::BIGINT AS bases FROM ({_CONCAT}) WHERE gid >= 'b' AND gid < 'p' AND has_seq GROUP BY gid")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = store.KeyedStore(spark, scratch(spark, "store"))
    # each put reads its rows twice, as ranges are drawn from a sample of them
    rows = cut(_assembled(spark, sf_dir).groupBy("gid").agg(F.sum(F.char_length("seq")).cast("long").alias("bases"), F.bool_or("has_seq").alias("has_seq")), "bases")
    genes.put(rows.withColumn("bases", F.lit(-1).cast("long")), version=0)
    genes.put(rows, version=1)
    return genes.scan("b", "p").filter("has_seq").select("gid", "bases")


# ---- files --------------------------------------------------------------------------------------------


@register("SELECT tid AS header, seq FROM {tx}")
def transcript_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "transcripts")
    text.write_transcripts(_tx(spark, sf_dir), path)
    return text.fasta(spark, path)


def _unspaced(rows: DataFrame) -> DataFrame:
    """With gene ids that have no blanks: a FASTA header ends at one."""
    return rows.withColumn("gid", F.translate("gid", " ", "_"))


@register("SELECT replace(gid, ' ', '_') AS gid, tidx, tid, seq FROM {tx}")
def gene_fasta_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "genes")
    text.write_genes(_unspaced(_tx(spark, sf_dir)), path)
    return text.transcripts(text.genes(spark, path))


@register("SELECT CAST(mate AS TINYINT) AS mate, seq, count(*) AS n FROM (SELECT 1 AS mate, seq FROM {r1} UNION ALL SELECT 2, seq FROM {r2}) GROUP BY ALL")
def paired_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [scratch(spark, "mate") for _ in range(2)]
    for path, mate in zip(paths, (synth.first_mates(spark, sf_dir), synth.second_mates(spark, sf_dir)), strict=True):
        text.write_transcripts(mate.select(F.col("read_id").cast("string").alias("tid"), "seq"), path)
    return text.reads(spark, paths[0], paths[1]).groupBy("mate", "seq").agg(F.count("*").alias("n"))


@register("SELECT CAST(1 AS TINYINT) AS mate, seq, count(*) AS n FROM {r1} GROUP BY ALL")
def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualities begin with @ and +, as they may."""
    path = scratch(spark, "fastq")
    quality = F.concat(F.when(F.col("read_id") % 2 == 0, "@").otherwise("+"), F.repeat(F.lit("I"), F.char_length("seq") - 1))
    record = F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), quality)
    synth.first_mates(spark, sf_dir).select(record.alias("value")).write.text(path)
    return text.reads(spark, path, fastq=True).groupBy("mate", "seq").agg(F.count("*").alias("n"))


@register("SELECT seqname, seq FROM {geno}")
def genome_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosomes in lines of 60 bases, with more than a name in the header."""
    path = scratch(spark, "genome")
    text.write_genome(synth.genome(spark, sf_dir).withColumn("seqname", F.concat("seqname", F.lit(" dna:chromosome x"))), path)
    return text.genome(spark, path)


@register("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(tid) + len(seq) + 3) AS BIGINT) AS bytes FROM {tx}")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sized")
    text.write_transcripts(_tx(spark, sf_dir), path)
    return text.fasta(spark, path).agg(F.count("*").alias("n")).withColumn("bytes", F.lit(store.total_size(spark, path)))


@register("SELECT gid1, gid2, dup, total FROM {cont}")
def overlap_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "overlaps")
    text.write_overlaps(similarity.containment(_tx(spark, sf_dir), K), path)
    return text.read_overlaps(spark, path)


_MERGED = """SELECT replace(h.gid, ' ', '_') AS gid, row_number() OVER (PARTITION BY r.root ORDER BY g.idx, t.tidx) AS place, t.tid, t.seq FROM {tx} t JOIN {gene} g ON g.gid = t.gid JOIN {root} r ON r.idx = g.idx JOIN {gene} h ON h.idx = r.root"""


@register(f"SELECT gid, '>' || gid || '|' || string_agg(tid, '|' ORDER BY place) || chr(10) || string_agg(seq, '|' ORDER BY place) AS value FROM ({_MERGED}) GROUP BY gid")
def clustered_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes as a file, clustered, written and read back as records."""
    path = scratch(spark, "clusters")
    tx = cut(_tx(spark, sf_dir), "transcripts")
    text.write_genes(_unspaced(similarity.cluster_transcripts(tx, cut(text.numbered_genes(tx), "genes"), ClusterOptions(K))), path)
    # tables that were sent to all tasks go before records of a whole cluster need room
    back = cut(text.gene_transcripts(spark, path), "clusters")
    release_memory()
    release_shuffles(spark)
    return text.gene_records(back)


@register("SELECT gid, tid, seq, CAST(length AS INTEGER) AS length, position FROM (SELECT r.gid, t.tid, r.seq, len(t.seq) AS length, r.position FROM {reg} r JOIN {tx} t ON t.gid = r.gid AND t.tidx = r.tidx)")
def framed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as nested messages, a frame for each gene, read through Spark's reader of binary files."""
    framed.register(spark)
    path = scratch(spark, "regions")
    per = _regions(spark, sf_dir).groupBy("gid", "tid", "length").agg(F.collect_list(F.struct("seq", "position")).alias("signatures"))
    genes = per.groupBy(F.col("gid").alias("id")).agg(F.collect_list(F.struct(F.col("tid").alias("id"), "length", "signatures")).alias("transcripts"))
    framed.encoded(genes, "GeneSignatures").write.format("framed").mode("append").save(path)
    back = framed.decoded(framed.read_binary(spark, path), "GeneSignatures").select(F.col("id").alias("gid"), F.explode("transcripts").alias("t"))
    return back.select("gid", F.col("t.id").alias("tid"), F.col("t.length").alias("length"), F.explode("t.signatures").alias("s")).select("gid", "tid", "s.seq", "length", "s.position")


@register("SELECT tid AS id, seq FROM {tx}")
def framed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of one file, which is read in parts of 16 kB by its index."""
    framed.register(spark)
    path = scratch(spark, "ranges")
    rows = _tx(spark, sf_dir).select(F.col("tid").alias("id"), "seq", *(F.lit(None).cast(kind).alias(name) for name, kind in (("exons", "array<string>"), ("name", "string"), ("variants", "array<string>"))))
    framed.encoded(rows.coalesce(1), "Transcript").coalesce(1).write.format("framed").option("span", 16 << 10).mode("append").save(path)
    return framed.decoded(spark.read.format("framed").load(path), "Transcript").select("id", "seq")


@register("SELECT s_name AS id, CAST(s_suppkey AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS seqname, s_acctbal > 0 AS has_seq FROM supplier")
def single_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are a file each, without a size before them."""
    framed.register(spark)
    path = scratch(spark, "messages")
    nothing = {name: F.lit(None).cast("array<string>" if kind.startswith("*") else kind.replace("32", "").replace("bool", "boolean")) for name, _, kind in framed.MESSAGES["Gene"]}
    own = {"id": F.col("s_name"), "name": F.col("s_suppkey").cast("string"), "seqname": F.col("s_nationkey").cast("string"), "has_seq": F.col("s_acctbal") > 0}
    rows = table(spark, sf_dir, "supplier").select(*(c.alias(name) for name, c in (nothing | own).items()))
    framed.encoded(rows, "Gene").write.format("framed").option("single", "true").mode("append").save(path)
    return framed.decoded(framed.read_single(spark, path), "Gene").select("id", "name", "seqname", "has_seq")


@register(f"""SELECT tid, CAST(length AS INTEGER) AS length, CAST(format('{{:.5e}}', est_reads) AS DOUBLE) AS est_reads, CAST(format('{{:.5e}}', CASE WHEN s > 0 THEN est_reads / (length / 1000.0) / (s / 1e6) ELSE 0 END) AS DOUBLE) AS rpkm,
  CAST(format('{{:.5e}}', CASE WHEN d > 0 THEN est_reads / length / d * 1e6 ELSE 0 END) AS DOUBLE) AS tpm
FROM (SELECT *, sum(est_reads) OVER () AS s, sum(est_reads / length) OVER () AS d FROM (
  SELECT tid, length, (CASE WHEN x < 0.1 THEN 0 ELSE x END) / {READ - K} AS est_reads FROM (SELECT t.tid, len(t.seq) AS length, coalesce(e.density, 0) * len(t.seq) AS x FROM {{tx}} t LEFT JOIN {{em}} e ON e.gid = t.gid AND e.tidx = t.tidx)))""")
def abundance_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, as numbers of six significant digits."""
    path = scratch(spark, "report")
    built, classes = _classes(spark, sf_dir)
    text.write_abundance(estimate.abundance(built.transcripts, estimate.estimate_genes(classes, OPTIONS, ROUNDS), OPTIONS), path)
    return spark.read.csv(path, sep="\t", schema="tid string, length int, est_reads double, rpkm double, tpm double")


@register("SELECT row_number() OVER (ORDER BY tid) - 1 AS place, tid FROM {tx}")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's lines in the order of its files: by transcript id."""
    path = scratch(spark, "report")
    rows = _tx(spark, sf_dir).select("tid", F.char_length("seq").alias("length"), *(F.lit(0.0).alias(c) for c in ("est_reads", "rpkm", "tpm")))
    text.write_abundance(rows, path)
    lines = prefix_sums(text.numbered_lines(spark, path), [F.col("path"), F.col("number")], {"place": F.lit(1).cast("long")})
    return lines.select("place", F.split("value", "\t")[0].alias("tid"))


@register("SELECT replace(gid, ' ', '_') AS gid, CAST(count(*) AS INTEGER) AS n_ids, CAST(count(*) + 1 AS INTEGER) AS n_seqs FROM {tx} GROUP BY gid HAVING count(*) % 2 = 0")
def uneven_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with an even number of transcripts get a sequence too many; a scan finds them."""
    path = scratch(spark, "uneven")
    records = text.gene_records(_unspaced(_tx(spark, sf_dir)))
    more = F.when(F.size(F.split(F.substring_index("value", "\n", 1), "[|]")) % 2 == 1, F.concat("value", F.lit("|ACGT"))).otherwise(F.col("value"))
    records.select(more.alias("value")).write.text(path)
    return text.uneven_records(spark, path)


@register("SELECT gid, tidx, position, n_windows FROM {reg}")
def remembered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once, then read: the second call would raise if it made them again."""
    folder = scratch(spark, "remembered")
    columns = ("gid", "tidx", "position", "n_windows")
    store.remembered(spark, "regions", 1, lambda: _regions(spark, sf_dir).select(*columns), folder)

    def never() -> DataFrame:
        raise RuntimeError("made again")

    return store.remembered(spark, "regions", 1, never, folder)


def _online(spark: SparkSession, sf_dir: str, report: str | None = None) -> EstimateJob:
    """Estimates of reads that arrive in two batches; between them the job ends and is taken up again."""
    built, reads = _built(spark, sf_dir), synth.first_mates(spark, sf_dir)
    staged, folder = scratch(spark, "arriving"), scratch(spark, "online")
    for part in range(2):
        reads.filter(F.col("read_id") % 2 == part).repartition(max(4, shuffle_partitions(spark))).write.mode("append").parquet(staged)
        arriving = spark.readStream.schema(reads.schema).parquet(staged)
        job = EstimateJob(arriving, built.keys, built.positions, built.transcripts, OPTIONS, interval=None, report=report, rounds=ROUNDS, folder=folder)
        job.finish()
    return job


@register("SELECT gid, tidx, round(found, 6) AS n_reads_kmers, round(density, 6) AS density FROM {online}")
def streaming_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by transcript after two batches, the second of which begins from the first and looks at its own genes only."""
    return _online(spark, sf_dir).estimates.select("gid", "tidx", F.round("n_reads_kmers", 6).alias("n_reads_kmers"), F.round("density", 6).alias("density"))


@register("""SELECT t.tid, CAST(format('{:.5e}', density * len(seq)) AS DOUBLE) AS value, CAST(format('{:.5e}', density) AS DOUBLE) AS per_base FROM {online} e JOIN {tx} t ON t.gid = e.gid AND t.tidx = e.tidx""")
def online_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a stream, read back: of each transcript the line of the last batch that has one."""
    report = scratch(spark, "profile")
    _online(spark, sf_dir, report)
    made(spark, report)
    # not as text: a folder without a batch has no column of that name, which only formats with several columns can lack
    lines = spark.read.csv(report, sep="\t", quote="", schema="tid string, value double, per_base double, batch int")
    last = F.max_by(F.struct("value", "per_base"), "batch").alias("r")
    return lines.groupBy("tid").agg(last).select("tid", "r.value", "r.per_base")

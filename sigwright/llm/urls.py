"""URL filter (operator 7): rules first, gradient-boosted trees on lexical features for the rest.

Only DataFrame functions run here. Features are column expressions; a split is chosen from grouped sums of
gradients over the binned labelled sample; the finished trees are one CASE expression over the features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwright.runtime import Cut

#: (allow or block, host, path start) of the rules that the query judges by.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "depth", "digit_ratio", "entropy", "params", "labels", "hyphens", "suffix_blocked", "suffix_seen")
#: Bound of the labelled sample: different URLs, chosen by their hashes.
SAMPLE_ROWS = 50_000
#: Parts that labelled URLs are dealt to by their hashes; a URL's suffix is judged by the other parts alone.
FOLDS = 5
TREES = 12
DEPTH = 3
BINS = 16
RATE = 0.4
#: Regularisation of leaf values, and labelled URLs that the global share counts as in a suffix's share.
SHRINK = 1.0
PRIOR_ROWS = 8.0
#: Gradients are summed as whole numbers of this unit, so that sums do not depend on the order of tasks.
UNIT = 1 << 30


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path. The host follows the first ``://`` up to /, ?, # or the end, with A-Z lower-cased; the path
    goes on up to ?, # or the end. Without ``://``, and for null, both are empty."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_name(host: str, path: str) -> str:
    return host + path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule fits its host and all subdomains if the
    path starts with its own; of rules of one length the first in code point order wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (-len(rule_name(r[1], r[2])), rule_name(r[1], r[2])), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(rule_name(h, p))).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a text; 0 for an empty one. Characters are sorted and their runs
    counted, so a long text costs little more than its length."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weighed = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    begin = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"))).otherwise(
        F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["sum"] + weighed(a["n"])).alias("sum"))
    )
    return F.aggregate(chars, begin, step, lambda a: F.when(F.size(chars) > 0, F.log2(F.size(chars)) - (a["sum"] + weighed(a["n"])) / F.size(chars)).otherwise(F.lit(0.0)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need the URL alone."""
    whole = F.coalesce(url, F.lit(""))
    n = F.char_length(whole)
    query = F.regexp_extract(whole, "\\?([^#]*)", 1)
    return {
        "url_length": n,
        "host_length": F.char_length(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": F.coalesce(F.regexp_count(whole, F.lit("[0-9]")) / F.nullif(n, F.lit(0)), F.lit(0.0)),
        "entropy": entropy(host),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "labels": F.size(F.filter(F.split(host, "\\."), lambda x: x != "")),
        "hyphens": F.char_length(host) - F.char_length(F.translate(host, "-", "")),
    }


@dataclass
class Tree:
    """Node 1 is the root, 2i and 2i+1 are below i: rows with feature names[i] <= edges[i] go to 2i. A name is
    None where a node has no split; leaves has the values of the last level."""

    names: list
    edges: list
    leaves: list

    def at_depth(self, depth: int, give, at: int = 1, level: int = 0) -> Column:
        """give(number) of the node that a row reaches at a depth; rows of a node without split go left."""
        if level == depth:
            return F.lit(give(at))
        left = self.at_depth(depth, give, 2 * at, level + 1)
        if self.names[at] is None:
            return left
        return F.when(F.col(self.names[at]) <= F.lit(self.edges[at]), left).otherwise(self.at_depth(depth, give, 2 * at + 1, level + 1))

    def node(self, depth: int) -> Column:
        return self.at_depth(depth, int)

    def value(self) -> Column:
        return self.at_depth(DEPTH, self.leaves.__getitem__)


@dataclass
class UrlModel:
    bias: float
    trees: list[Tree]

    def raw(self) -> Column:
        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + tree.value()
        return out


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES) -> UrlModel:
    """Boosted trees on rows with FEATURES, ``url`` and ``blocked`` 0/1, a repeated URL as one.

    If there are more than sample_rows different URLs (by an estimate that is 15 % on the safe side), those whose
    hashes lie below the share that is wanted are taken. With one class only, or no row, there are no trees and the
    bias is the smoothed log odds (no row: allow). What reaches the driver is bounded: quantiles, and sums by node,
    feature and bin.
    """
    doubles = [F.col(f).cast("double").alias(f) for f in FEATURES]
    there = 1.15 * labelled.agg(F.approx_count_distinct("url").alias("n")).first().n
    if there > sample_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64("url", F.lit(1)), F.lit(1 << 31)) < int(sample_rows / there * (1 << 31)))
    sample = Cut(labelled.select("url", *doubles, F.col("blocked").cast("double").alias("y")).dropDuplicates(["url"]).drop("url").repartition(4), "url-sample")
    try:
        return _fit(sample.df, trees)
    finally:
        sample.drop()


def _fit(sample: DataFrame, trees: int) -> UrlModel:
    steps = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    head = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"), *(F.percentile(f, steps).alias(f) for f in FEATURES)).first()
    n, p = head["n"], head["p"]
    bias = math.log((p + 0.5) / (n - p + 1.5))
    if not 0 < p < n:
        return UrlModel(bias, [])
    edges = {f: sorted(set(head[f])) for f in FEATURES}
    model = UrlModel(bias, [])
    binned = sample.select("*", *(sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)).alias(f"bin_{f}") for f in FEATURES))
    for _ in range(trees):
        share = 1 / (1 + F.exp(-model.raw()))
        g = F.round((share - F.col("y")) * UNIT).cast("long")
        h = F.round(share * (1 - share) * UNIT).cast("long")
        tree = Tree([None] * (1 << DEPTH), [0.0] * (1 << DEPTH), [0.0] * (2 << DEPTH))
        for depth in range(DEPTH):
            bins = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"bin_{f}").alias("b")) for i, f in enumerate(FEATURES))))
            sums = binned.select(tree.node(depth).alias("node"), g.alias("g"), h.alias("h"), bins.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            by: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
            for r in sums.collect():
                by.setdefault((r.node, r.f), {})[r.b] = (r.g, r.h)
            for node in range(1 << depth, 2 << depth):
                tree.names[node], tree.edges[node] = _split({f: by[node, f] for f in range(len(FEATURES)) if (node, f) in by}, edges)
                if depth == DEPTH - 1:
                    _leaves(tree, node, by, edges)
        model.trees.append(tree)
        if tree.names[1] is None:
            break
    return model


def _worth(g: float, h: float) -> float:
    return g * g / (h + SHRINK)


def _split(sums: dict[int, dict[int, tuple[int, int]]], edges: dict[str, list[float]]) -> tuple[str | None, float]:
    """The best (feature, edge) of a node; the first of equals. None where no split gains."""
    best, out = 1e-6, (None, 0.0)
    for f, bins in sorted(sums.items()):
        name = FEATURES[f]
        g, h = (sum(x[i] for x in bins.values()) / UNIT for i in (0, 1))
        left_g = left_h = 0
        for b, edge in enumerate(edges[name]):
            one = bins.get(b, (0, 0))
            left_g, left_h = left_g + one[0], left_h + one[1]
            a, c = left_g / UNIT, left_h / UNIT
            gain = _worth(a, c) + _worth(g - a, h - c) - _worth(g, h)
            if 0 < left_h and h - c > 1e-9 and gain > best * (1 + 1e-9):
                best, out = gain, (name, edge)
    return out


def _leaves(tree: Tree, node: int, by: dict, edges: dict[str, list[float]]) -> None:
    """Values of the two leaves below a node of the last level, from the sums its split was chosen by."""
    name = tree.names[node]
    last_left = edges[name].index(tree.edges[node]) if name else BINS
    sides = [[0, 0], [0, 0]]
    for b, (g, h) in by.get((node, FEATURES.index(name) if name else 0), {}).items():
        sides[b > last_left][0] += g
        sides[b > last_left][1] += h
    for i, (g, h) in enumerate(sides):
        tree.leaves[2 * node + i] = -RATE * (g / UNIT) / (h / UNIT + SHRINK)


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, host, path, rule, verdict and score of every row of pages.

    URLs that a rule fits are the labelled ones: the trees learn from them and give the verdict of all others
    (block where the score is 0.5 or more). Suffix statistics are the share of blocked ones among the labelled URLs
    with the same last host label, shrunk to the global share, and their number (log2); for a labelled URL they are
    taken over the parts that it is not in, so that no label stands among its own features.
    A null URL, or one without ``://``, has empty host and path and is judged by its features. Repeated rows
    stay. Other columns of pages are not read.
    """
    u = F.col(url)
    host, path = url_parts(u)
    parts = pages.select(F.col(id_col).alias(id_col), u.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "known": verdict, "suffix": F.substring_index("host", ".", -1)})
    parts = parts.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    parts = parts.withColumn("fold", F.when(F.col("known").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    blocked = (F.col("known") == "block").cast("int")
    by_fold = parts.filter("known IS NOT NULL").groupBy("suffix", "fold").agg(F.sum(blocked).alias("own_b"), F.count("*").alias("own_n"))
    by_fold = Cut(by_fold, "url-suffixes").df
    by_suffix = by_fold.groupBy("suffix").agg(F.sum("own_b").alias("b"), F.sum("own_n").alias("n"))
    total = by_fold.agg(F.sum("own_b").alias("b"), F.sum("own_n").alias("n")).first()
    prior = ((total.b or 0) + 0.5) / ((total.n or 0) + 1)
    none = F.lit(0).cast("long")
    b, n = (F.coalesce(F.col(c), none) - F.coalesce(F.col(f"own_{c}"), none) for c in "bn")
    full = parts.join(by_suffix, "suffix", "left").join(by_fold, ["suffix", "fold"], "left").withColumns(
        {"suffix_blocked": (b + PRIOR_ROWS * prior) / (n + PRIOR_ROWS), "suffix_seen": F.log2(n + 1), "blocked": blocked}
    )
    model = fit(full.filter("known IS NOT NULL"), sample_rows)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.raw()))
    judged = full.withColumn("score", score)
    return judged.select(id_col, "host", "path", "rule", F.coalesce("known", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")

"""Connected components of an undirected graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.runtime import Cut


#: Nodes of a round at most whose lowest neighbours are sent to all tasks; above that they meet edges in a shuffle.
SENT_NODES = 1 << 14


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches.

    Alternating star contraction: the large step links every neighbour above a node to the smallest of its
    neighbourhood, the small step does so for those below. Both are one aggregation, which combines before it
    shuffles, and one join; no neighbour list is ever gathered. Rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder, so lineage stays short and lost executors cost little. The
    aggregation that begins a round also says whether stars are all that is left: then it is the result, and edges
    that come as stars take no round at all.

    Edges with a null end are left out; loops give a node that is its own root; repeated edges count once.
    """
    ends = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    now = Cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components")
    for _ in range(max_rounds + 1):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = Cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.max(F.nullif("v", "u")).alias("most")), "components-low")
        # of a star every node but the root has one neighbour, and that below itself
        nodes, open_, alone = lows.df.agg(F.count("*"), F.expr("count_if(m < u AND m < most)"), F.expr("count_if(most IS NULL)")).first()
        if not open_:
            now.drop()
            return lows.df.select(F.col("u").alias("node"), F.col("m").alias("root"))
        sent = F.broadcast if nodes <= SENT_NODES else lambda df: df
        large = both.join(sent(lows.df.select("u", "m")), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = small.select("e.u", "e.v").filter("u <> v")
        if alone:
            after = after.unionByName(now.df.filter("u = v"))
        after = Cut(after.distinct(), "components")
        now.drop()
        lows.drop()
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components of an edge table, smallest label wins. Nothing is collected.

Large-star / small-star rounds (Kiveris et al. 2014): every node keeps an edge to the smallest node it
knows until all edges are stars. Each round is two joins on node ids, which Spark may split where a hub
has many edges, and is checkpointed in the shared folder. Rounds end when no edge has changed.

Defined cases: edges from a node to itself and repeated edges don't count, direction doesn't matter; nodes
are longs and not null; nodes without an edge to another are not in the result; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bindery.llm.common import cut, utf8


def stars(edges: DataFrame, hub: str, leaf: str, upper: bool) -> DataFrame:
    """Joins each hub's leaves to the smallest node among hub and leaves. upper: only leaves above the hub move."""
    least = edges.groupBy(F.col(hub).alias("u")).agg(F.min(leaf).alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = edges.select(F.col(hub).alias("u"), F.col(leaf).alias("v")).join(least, "u")
    if upper:
        return moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of all nodes of edges(a, b)."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars(both, "a", "b", True).distinct()
        before, n_before = edges, n
        edges = cut(stars(large, "a", "b", False).distinct())
        n = edges.count()
        if n == n_before and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def node_of(text_col: str) -> Column:
    return F.xxhash64(utf8(text_col))


def one_of_each(docs: DataFrame, roots: DataFrame, node: Column, id_col="doc_id") -> DataFrame:
    """One row of docs for each group: the one of the smallest id (null ids last), of these the one of the smallest text hash.

    roots(node, root) names the groups of more than one node; of rows that repeat an id and text, one is taken.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    own = docs.withColumn("_node", node).toDF(*names, "_node")
    ident = F.col(of[id_col])
    keys = ["_none", "_id", "_node"]
    own = own.withColumn("_none", ident.isNull()).withColumn("_id", F.coalesce(ident.cast("long"), F.lit(0)))
    ranked = own.select(*keys).join(roots.select(F.col("node").alias("_node"), "root"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    first = ranked.groupBy("root").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")
    kept = own.dropDuplicates(keys).join(first, keys, "left_semi")
    return kept.select(*[F.col(n).alias(c) for c, n in of.items()])

"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflife.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in edges (a, b); root is the smallest node of the component.

    Large stars hang a node's larger neighbours on its smallest one, small stars its
    smaller ones; both keep components, and together end in one star for each. Hot nodes
    are minima, which are summed before the shuffle, and joins, which Spark can split.
    A round begins by counting each node's smaller and larger neighbours, and if these are stars it is the last."""
    now = written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(
            both.groupBy("a").agg(
                F.least(F.min("b"), F.col("a")).alias("m"), F.count_if(F.expr("b < a")).alias("below"), F.count_if(F.expr("b > a")).alias("above")
            ),
            "least",
        )
        # In stars a node has one smaller neighbour, or larger ones only.
        if least.where("below > 1 OR (below = 1 AND above > 0)").isEmpty():
            break
        # Repeated rows change no minimum, and there are no more of them than edges.
        large = both.where("b > a").join(least.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a != b"), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
    return least.select(F.col("a").alias("node"), F.col("m").alias("root"))


def merged_components(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) as components() would give for the edges behind `roots` (its result) and `links` (a, b) together; both
    are stored tables. Only what the links join is contracted anew, by its roots."""
    if links.isEmpty():
        return roots

    def rooted(end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))

    ends = [F.coalesce(f"_{end}", end).alias(end) for end in ("a", "b")]
    joined = components(links.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").select(*ends))
    # A node without a link before has itself as its root, and is in the new links only.
    known = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left")
    single = joined.join(roots.select("node"), "node", "left_anti")
    return known.select("node", F.coalesce("_root", "root").alias("root")).unionByName(single)

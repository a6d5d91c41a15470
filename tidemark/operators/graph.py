"""Connected components by iterated joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, discard


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component.

    ``nodes``: node. ``edges``: a, b (either direction). Every round lets a
    node take the smallest grand-root among its neighbours, passes it on to the
    node's own root, and shortens its path, which needs about log(n) rounds.
    Minima combine before they shuffle, so a node with very many neighbours is
    no bottleneck. Each round's labels are written once, those of the round
    before are deleted, and the loop only asks whether any of them changed.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select("b", "a")).filter(F.col("a") != F.col("b")).distinct()
    )
    labels = cut_lineage(nodes.select("node").distinct().withColumn("root", F.col("node")))
    while True:
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        seen = labels.join(above, "root").select("node", "root", "grand")
        lowest = (
            both.join(seen.select(F.col("node").alias("b"), "grand"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("grand").alias("low"))
        )
        none = F.lit(None).cast(labels.schema["node"].dataType)
        offers = (
            seen.select("node", F.col("grand").alias("offer"), F.col("root").alias("old"))
            .union(lowest.select("node", "low", none.alias("old")))
            .union(lowest.join(labels, "node").select(F.col("root").alias("node"), "low", none.alias("old")))
        )
        moved = cut_lineage(offers.groupBy("node").agg(F.min("offer").alias("root"), F.max("old").alias("old")))
        discard(labels)
        labels = moved.select("node", "root")
        if moved.filter(F.col("root") != F.col("old")).isEmpty():
            discard(both)
            return labels

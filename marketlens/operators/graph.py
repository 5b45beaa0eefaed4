"""Connected components for the core: labels fall to the least id that can be reached, in stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.sources.store import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, root: the least node of the component. Nodes without an edge to another don't appear.

    Each round takes the least label among a node's neighbours, hands it on to the node's present root, and jumps to the root's
    root, so long chains halve. All minima combine on the map side and join as one row for each key: a hub is no hot task.
    """
    e = edges.where("a <> b")
    e = stored(e.select("a", "b").union(e.select("b", "a")).distinct(), "edges")
    labels = stored(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "labels")
    before = None
    while (now := tuple(labels.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first())) != before:
        near = e.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = stored(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")), "low")
        hook = low.groupBy("root").agg(F.min("low").alias("hook"))
        hooked = stored(low.join(hook, "root").select("node", F.least("low", "hook").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        before, labels = now, stored(hooked.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
    return labels

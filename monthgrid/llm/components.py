"""Connected components of links, by hooking to the least neighbour and pointer jumping.

Every round is a few partially aggregated joins over tables in the shared folder; nothing is collected, and a round's
tables are deleted once the next one's are written.  A label that very many nodes share is the key of left joins with
one row a label, which are broadcast under a measured bound and else split by AQE.

Defined results: links with a null end are ignored; a link of a node with itself names no node; repeated links count
once; an empty table gives an empty table.  Nodes may be of any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import forget, small_side, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the least node reachable; nodes without a link to another are absent."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    # The least neighbour, or the node itself.
    label = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        # Each root hooks to the least label that any of its nodes sees; then labels jump to their root's label.
        seen = written(
            edges.join(label.withColumnRenamed("node", "u").withColumnRenamed("label", "lu"), "u")
            .join(label.withColumnRenamed("node", "v").withColumnRenamed("label", "lv"), "v")
            .filter("lv < lu").groupBy(F.col("lu").alias("root")).agg(F.min("lv").alias("to")), "hooks"
        )
        if not seen.limit(1).count() and not label.join(label.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").filter("up <> label").limit(1).count():
            forget(edges, seen)
            return label
        moved = label.join(small_side(seen), label["label"] == seen["root"], "left").select("node", F.coalesce("to", "label").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        fresh = written(moved.join(jump, "label", "left").select("node", F.least(F.coalesce("up", "label"), "label").alias("label")), "labels")
        forget(label, seen)
        up = fresh.select(F.col("node").alias("label"), F.col("label").alias("up"))
        label = written(fresh.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        forget(fresh)

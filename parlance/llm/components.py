"""Connected components over an edge list, in Spark joins and aggregations.

Each round gives a node the smallest label among itself and its neighbours and
then the label of its label.  A hub costs one partial aggregate per task, never
a collected group.  Rounds grow with the logarithm of the longest path; each is
cut off through the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, label): label is the smallest node reachable.

    Nodes without an edge are not listed.  Self links and repeated links are
    harmless; rows with a null end are ignored; an empty list gives no rows.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = durable(near.join(jump, "label", "left").select("node", "was", F.least("label", "up").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels

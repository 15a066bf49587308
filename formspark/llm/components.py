"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (u, v: bigint); label is the least node of its component.

    Each round lowers a node's label, and the label of its former label, to the least label next to
    it, and then follows labels once. Rounds grow as the logarithm of a component's diameter. Rounds
    are written to the shared folder; joins have a checkpointed table on either side, so that Spark
    can split a hub's rows. Nothing is collected but the number of changes.
    """
    both = materialise(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels = materialise(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        of_end = labels.select(F.col("node").alias("v"), F.col("label").alias("seen"))
        near = both.join(of_end, "v").groupBy(F.col("u").alias("node")).agg(F.min("seen").alias("least"))
        near = materialise(labels.join(near, "node").select("node", "label", F.least("label", "least").alias("least")))
        hooked = near.select(F.col("label").alias("node"), "least").union(near.select("node", "least")).groupBy("node").agg(F.min("least").alias("label"))
        hooked = materialise(hooked)
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("top"))
        # dealt by node again: the join leaves all nodes of a large component together
        jumped = materialise(hooked.join(up, "label").select("node", F.least("label", "top").alias("label")).repartition("node"))
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels

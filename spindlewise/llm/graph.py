"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindlewise.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the component is its smallest node.

    Each round takes the smallest label of the neighbours and then the label of that label, so that rounds grow with the
    logarithm of a chain's length. Rounds are stored tables; labels are grouped by sums that combine before shuffling,
    and the rows of a hub are spread by the engine's split of skewed joins. Nulls and links of a node with itself are no links.
    """
    links = links.where("a is not null and b is not null and a != b")
    both = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "seen").alias("new"))
        jumps = labels.select(F.col("node").alias("to"), F.col("label").alias("jump"))
        following = stored(
            lower.join(jumps, lower["new"] == jumps["to"]).select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") < F.col("label")).alias("moved")),
            "labels",
        )
        labels = following.select("node", "label")
        if following.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))

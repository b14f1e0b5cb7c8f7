"""Connected components of links in a table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node with a link. links: (a, b), of any sortable type.

    Labels spread along links to the smallest neighbour and then jump to their label's label, until none changes: about
    log(longest path) rounds. Every step is an aggregate that combines before the shuffle, or a join that can be split.
    Each round is written to the shared folder.
    """
    both = materialize(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("component").alias("new"))
        spread = labels.join(near, "node").select("node", F.least("component", "new").alias("component"), F.col("component").alias("old"))
        parents = spread.select(F.col("node").alias("p"), F.col("component").alias("q"))
        jumped = materialize(spread.join(parents, spread.component == parents.p).select("node", F.least("component", "q").alias("component"), (F.least("component", "q") != F.col("old")).alias("moved")))
        moving = jumped.where("moved").limit(1).count()
        discard(labels)
        labels = jumped
        if not moving:
            discard(both)
            return labels.select("node", "component")

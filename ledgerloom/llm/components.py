"""Connected components of an edge table, by label propagation with pointer jumping.

Labels start as the node ids; each pass gives every node the smallest label among its
neighbours, then follows each label once.  Every pass is a join and an aggregate with
partial sums, and is stored in the shared folder, so lineage stays short and a hot node
(a star's centre) is split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, stored_so_far


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b.  Returns node, label: the smallest node reachable, for nodes with edges."""
    before = stored_so_far()
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        nearer = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = stored(nearer.join(onward, "label", "left").select("node", "was", F.coalesce("next", "label").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("was <> label").limit(1).count() == 0:
            discard(edges.sparkSession, before, keep=[step])
            return labels

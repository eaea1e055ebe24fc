"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.skew import HOT_ROWS, hot_key_join, hot_keys, salted_join
from reviewmill.session import staged


def connected_components(edges: DataFrame, group: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Smallest node reachable from each node, inside each group.

    `edges` has the `group` columns and long columns `a`, `b`. Each round takes
    the smallest label among a node's neighbours, then follows that label to its
    own label, which roughly halves the distance to the root. It ends when no
    label moves. Every round is written, so a lost executor costs one round, and the planner sees
    the size of the files: a checkpoint keeps the estimate of its plan, a product over all joins
    before it, whose digits multiply with every round. Nodes with
    more than `hot_rows` neighbours are found once, and their edges are spread in every round.
    """
    key = [*group, "node"]
    both = staged(
        edges.select(*group, F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(edges.select(*group, F.col("b").alias("node"), F.col("a").alias("other")))
        .distinct()
    )
    degrees = both.groupBy(*group, "other").agg(F.count("*").alias("n"))
    hot = staged(hot_keys(degrees, [*group, "other"], "n", hot_rows))
    join = (lambda big, small, keys: big.join(small, keys)) if hot.isEmpty() else (
        lambda big, small, keys: hot_key_join(big, small, keys, hot, ["node"]))
    labels = staged(both.select(*key).distinct().withColumn("label", F.col("node")))
    while True:
        of_others = labels.select(*group, F.col("node").alias("other"), "label")
        offered = (
            join(both, of_others, [*group, "other"])
            .groupBy(*key).agg(F.min("label").alias("offer"))
        )
        stepped = staged(labels.join(offered, key).select(
            *key, F.col("label").alias("was"), F.least("label", "offer").alias("label")
        ))
        roots = stepped.select(*group, F.col("node").alias("label"), F.col("label").alias("root"))
        # The label of a giant component is a hot key.
        jumped = staged(salted_join(stepped, roots, [*group, "label"], ["node"]).select(
            *key, "was", F.col("root").alias("label")
        ))
        labels = jumped.drop("was")
        if jumped.where(F.col("label") != F.col("was")).isEmpty():
            return labels

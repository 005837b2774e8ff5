"""Connected components of a link table by minimum labels with pointer jumping.

Links and labels stay in Spark; each iteration writes its labels to the shared
checkpoint folder and deletes those of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import discard, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an undirected link table; the label is the smallest node of the
    component. Self links make single nodes; repeated links and ties have no effect; null ends are left
    out. A hub's links are combined map-side and its join is split by AQE."""
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = written(one.union(one.select("v", "u")).distinct(), "links")
    labels = written(both.groupBy("u").agg(F.min("v").alias("m"))
                     .select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m")))
        low = (labels.join(near, F.col("node") == F.col("u"), "left")
               .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("mid")))
        far = labels.select(F.col("node").alias("mid"), F.col("label").alias("jump"))
        nxt = written(low.join(far, "mid", "left")
                      .select("node", "old", F.least("mid", F.coalesce("jump", "mid")).alias("label")), "labels")
        moved = nxt.where("label <> old").limit(1).count()
        discard(labels)
        labels = nxt
        if not moved:
            discard(both)
            return labels.select("node", "label")

"""Connected components of a link table, by smallest labels and pointer jumping. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purlin.llm.common import discard, freeze


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node with a link: comp is the smallest node that links lead to.

    Each round a node takes the smallest label around it, then its label's label; rounds needed grow with the
    logarithm of the longest chain, and labels only ever fall, so the loop ends. Every round's labels are frozen, so a lost
    executor costs one round at most, and the round before is deleted.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    ends = freeze(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "ends")
    labels = freeze(ends.groupBy("x").agg(F.min("y").alias("least")).select(F.col("x").alias("node"), F.least("x", "least").alias("comp")), "labels")
    while True:
        around = ends.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        nearer = labels.select("node", "comp").join(around, F.col("node") == F.col("x")).select("node", F.least("comp", "near").alias("now"), F.col("comp").alias("was"))
        jump = nearer.alias("p").join(labels.alias("q"), F.col("p.now") == F.col("q.node"), "left")
        moved = freeze(jump.select(F.col("p.node").alias("node"), F.least("p.now", F.coalesce("q.comp", "p.now")).alias("comp"), F.col("p.was").alias("was")), "labels")
        discard(labels)
        labels = moved
        if moved.where("comp != was").isEmpty():
            discard(ends)
            return moved.select("node", "comp")

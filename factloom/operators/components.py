"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node and label, the smallest node of its component, of every node that has a link.

    Each round a node takes the smallest label around it and then that label's own label, so the rounds follow the logarithm of
    a component's width. Only links and labels are shuffled, a hub's links are added up map-side, and each round's labels are
    written to the checkpoint folder. Nodes of any type that can be ordered and compared.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(links.select(F.col(b), F.col(a))).distinct().persist()
    labels = cut(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"))
    while True:
        around = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        took = labels.join(around, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        # mid is a node of the same component; its label may be smaller still.
        of = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = cut(took.join(of, F.col("mid") == F.col("at")).select("node", "old", F.least("mid", "further").alias("label")))
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            both.unpersist()
            return labels

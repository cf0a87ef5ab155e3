"""Connected components of a link table without collecting it: least labels with pointer jumping, a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, hot_keys, written


def components(links: DataFrame, a: str = "a", b: str = "b", hot: int = 0) -> DataFrame:
    """(node, label) of every node that has a link; the label is the least node that it reaches.

    Each round takes the least label among a node's neighbours (pre-aggregated before the shuffle, so a hub is no hot
    group) and then the label of its label, so the number of rounds is logarithmic in the length of a chain.
    With `hot`, nodes and labels that hold more than 1/hot of a join's rows are joined by broadcast; without, that is left to
    adaptive execution."""
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    hubs = hot_keys(both, "x", hot) if hot else None
    while True:
        to = labels.withColumnRenamed("node", "x")
        near = (by_key(both, to, "x", hot, keys=hubs) if hot else both.join(to, "x")).groupBy("y").agg(F.min("label").alias("near"))
        found = labels.join(near, labels.node == near.y, "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("onward"))
        if hot:
            found, jump = written(found, "labels"), jump.withColumnRenamed("at", "label")
            new = written(by_key(found, jump, "label", hot, "left").select("node", "was", F.least("label", "onward").alias("label")), "labels")
        else:
            new = written(found.join(jump, found.label == jump["at"], "left").select("node", "was", F.least("label", "onward").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (a, b), which join whole components: only the links' ends are walked."""

    def at(frame: DataFrame, col: str) -> DataFrame:
        to = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        return frame.join(to, frame[col] == to["_n"], "left").withColumn(col, F.coalesce("_l", col)).drop("_n", "_l")

    roots = components(at(at(links.select("a", "b"), "a"), "b")).select(F.col("node").alias("root"), F.col("label").alias("least"))
    known = labels.join(roots, labels["label"] == roots["root"], "left").select("node", F.coalesce("least", "label").alias("label"))
    return known.unionByName(roots.join(labels.select("node"), roots["root"] == F.col("node"), "left_anti").select(F.col("root").alias("node"), F.col("least").alias("label")))

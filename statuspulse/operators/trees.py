"""A trained forest as a table of nodes, and its prediction as joins.

A row of the table is a node of a tree: the feature and threshold it asks (or the categories
that go left), its children, and its share of votes per class.  Rows to be scored walk all
trees at once, one equality join on (tree, node) a level; the votes of the leaves are added in
the order of the trees, so that sums equal the model's own to the last bit.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.session import materialise

#: Nodes up to this number are broadcast to the rows; a node is below 200 bytes.
BROADCAST_NODES = 200_000


def save_nodes(model, path: str) -> DataFrame:
    """Write a forest classification model below ``path/model`` and its nodes to ``path/nodes``."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    nodes = nodes_of(spark, f"{path}/model", classes=model.numClasses)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    return spark.read.parquet(f"{path}/nodes")


def nodes_of(spark: SparkSession, model_path: str, *, classes: int) -> DataFrame:
    """tree, node, feature, threshold, categories, left, right, votes of a saved forest.

    A leaf has no children (-1).  ``categories`` are those that go left at a split of a
    categorical feature, where ``threshold`` is null.
    """
    stored = spark.read.parquet(f"{model_path}/data").select(
        F.col("treeID").cast("int").alias("tree"), "nodeData.*"
    )
    leaf = F.col("leftChild") < 0
    categorical = F.col("split.numCategories") >= 0
    given = F.col("split.leftCategoriesOrThreshold")
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v)
    share = F.transform(
        F.slice("impurityStats", 1, classes), lambda v: F.when(total != 0, v / total).otherwise(0.0)
    )
    return stored.select(
        "tree",
        F.col("id").cast("int").alias("node"),
        F.when(~leaf, F.col("split.featureIndex")).cast("int").alias("feature"),
        F.when(~leaf & ~categorical, F.get(given, F.lit(0))).alias("threshold"),
        F.when(~leaf & categorical, given).alias("categories"),
        F.col("leftChild").cast("int").alias("left"),
        F.col("rightChild").cast("int").alias("right"),
        share.alias("votes"),
    )


def walk(rows: DataFrame, nodes: DataFrame, *, key: list[str], features: str = "features") -> DataFrame:
    """``key``, prediction and probability (array) of every row, by joins with the node table.

    ``key`` tells rows apart; ``features`` is their vector.  Every tree has a row's copy, which
    moves one level a join; inner nodes are joined by (tree, node), and the number of joins is the
    depth of the deepest tree.
    """
    size = nodes.agg(F.count("*"), F.max("tree")).first()
    trees, small = size[1] + 1, size[0] <= BROADCAST_NODES
    inner = nodes.where(F.col("left") >= 0).drop("votes")
    asked = F.broadcast(inner) if small else inner
    at = rows.select(*key, vector_to_array(F.col(features)).alias("_x")).withColumns(
        {"tree": F.explode(F.sequence(F.lit(0), F.lit(trees - 1))), "node": F.lit(0)}
    )
    value = F.get("_x", F.col("feature"))
    left = F.when(F.col("threshold").isNotNull(), value <= F.col("threshold")).otherwise(
        F.array_contains("categories", value)
    )
    for _ in range(_depth(inner)):
        met = at.join(asked, ["tree", "node"], "left")
        child = F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left"))
        at = met.select(*key, "_x", "tree", child.otherwise(F.col("right")).alias("node"))
    leaves = nodes.select("tree", "node", "votes")
    voted = at.drop("_x").join(F.broadcast(leaves) if small else leaves, ["tree", "node"])
    in_order = F.sort_array(F.collect_list(F.struct("tree", "votes")))  # one vote a tree
    summed = F.aggregate(
        F.transform("_votes", lambda v: v["votes"]),
        F.transform(F.get("_votes", F.lit(0))["votes"], lambda v: F.lit(0.0)),
        lambda a, v: F.zip_with(a, v, lambda x, y: x + y),
    )
    total = F.aggregate("_raw", F.lit(0.0), lambda a, v: a + v)
    return (
        voted.groupBy(*key)
        .agg(in_order.alias("_votes"))
        .withColumn("_raw", summed)
        .withColumns(
            {
                "probability": F.transform("_raw", lambda v: v / total),
                "prediction": (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"),
            }
        )
        .drop("_votes", "_raw")
    )


def _depth(inner: DataFrame) -> int:
    """Levels of inner nodes: each level's children are found by a join, and counted."""
    level = inner.where("node = 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
    depth = 1 if not inner.isEmpty() else 0
    children = inner.select("tree", "node", F.array("left", "right").alias("_next"))
    while depth:
        level = materialise(level.join(children, ["tree", "node"]), "forest_level")
        if level.isEmpty():
            break
        depth += 1
        level = level.select("tree", F.explode("_next").alias("node"))
    return depth

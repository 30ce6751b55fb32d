"""A fitted forest as a table of nodes, and what follows from it."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import shared_folder


def forest_nodes(model: PipelineModel, columns: list[str]) -> DataFrame:
    """(tree, node, feature, threshold, impurity, gain, rows, left, right, prediction) of a fitted pipeline's forest.

    A node without a feature is a leaf; rows whose feature is at most the threshold go left. The table is
    the one the model is stored as, in the shared folder; columns are the names of its inputs, in order.
    """
    forest = model.stages[-1]
    if not hasattr(forest, "trees"):
        raise ValueError(f"{type(forest).__name__} has no trees")
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    forest.write().overwrite().save(path)
    stored = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    feature = F.when(F.col("split.featureIndex") >= 0, F.get(F.array(*(F.lit(c) for c in columns)), F.col("split.featureIndex")))
    return stored.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), feature.alias("feature"), F.when(feature.isNotNull(), F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        "impurity", "gain", F.aggregate("impurityStats", F.lit(0.0), lambda s, x: s + x).alias("rows"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), "prediction",
    )


def forest_importances(nodes: DataFrame, n: int | None = 12) -> DataFrame:
    """(feature, importance, splits): each feature's share of what the splits gain, weighed by their rows; trees count alike.

    Importances add up to 1 over all features that split anything. The first n by importance, then name.
    """
    gains = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("g"), F.count("*").alias("splits"))
    whole = gains.groupBy("tree").agg(F.sum("g").alias("all"))
    share = gains.join(whole, "tree").select("feature", F.try_divide("g", "all").alias("share"), "splits")
    trees = whole.where("all > 0").agg(F.count("*").alias("trees"))
    out = share.groupBy("feature").agg(F.sum("share").alias("share"), F.sum("splits").alias("splits"))
    out = out.join(F.broadcast(trees)).select("feature", (F.col("share") / F.col("trees")).alias("importance"), "splits").orderBy(F.desc("importance"), "feature")
    return out if n is None else out.limit(n)

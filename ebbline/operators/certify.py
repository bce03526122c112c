"""What can be proved of a fitted model from its training rows and its own saved tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ebbline.schemas import LABEL
from ebbline.session import scratch_dir


@dataclass(frozen=True)
class Gradient:
    """The slope of the training loss at a fitted logistic regression; zero at the optimum.

    ``gap`` bounds how far the loss is above its minimum: the penalty makes the
    loss strongly convex in the coefficients, whose slope squared over twice the
    penalty is that bound. The intercept has no penalty; its slope stands apart.
    """

    rows: int
    largest: float
    intercept: float
    gap: float


def logistic_gradient(rows: DataFrame, model: LogisticRegressionModel) -> Gradient:
    """Gradient over prepared rows (``features``, label, ``class_weight``): one aggregate, vectors of the model's size.

    The model is a classifier of one coefficient vector and L2 penalty, without standardisation.
    """
    weight, label = F.col("class_weight"), F.col(LABEL).cast("double")
    rated = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    sums = rated.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(weight).alias("weight"),
        F.sum(weight * (F.col("p") - label)).alias("off"),
        Summarizer.sum(F.col("features"), weight * F.col("p")).alias("rated"),
        Summarizer.sum(F.col("features"), weight * label).alias("labelled"),
    ).first()
    penalty = model.getRegParam()
    slope = (sums["rated"].toArray() - sums["labelled"].toArray()) / sums["weight"] + penalty * model.coefficients.toArray()
    return Gradient(
        rows=sums["n"],
        largest=float(np.abs(slope).max(initial=0.0)),
        intercept=float(abs(sums["off"]) / sums["weight"]),
        gap=float(slope @ slope / (2 * penalty)) if penalty else float("inf"),
    )


@dataclass(frozen=True)
class ForestShape:
    """What the node table of a forest says of it."""

    trees: int
    depth: int
    smallest_leaf: int
    largest_feature: int
    uneven_nodes: int


def forest_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """The nodes of a saved forest: tree, node, rows, children and split feature; leaves have neither of the last."""
    stage = len(PipelineModel.load(model_path).stages) - 1
    table = spark.read.parquet(f"{model_path}/stages/{stage}_*/data")
    node = F.col("nodeData")
    inner = node["leftChild"] >= 0
    return table.select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["rawCount"].alias("rows"),
        F.when(inner, F.array(node["leftChild"], node["rightChild"])).alias("children"),
        F.when(inner, node["split"]["featureIndex"]).alias("feature"),
    )


def forest_shape(nodes: DataFrame) -> ForestShape:
    """Size and depth of a forest, and nodes whose rows are not those of their children.

    Depths are found by doubling: every node knows an ancestor and how far above
    it is, and takes over what that ancestor knows until all are at their root,
    so there are as many joins as the depth has binary digits. Nodes that no root
    reaches have no depth.
    """
    nodes = nodes.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        own = nodes.agg(
            F.count_distinct("tree").alias("trees"),
            F.count(F.lit(1)).alias("nodes"),
            F.min(F.when(F.col("children").isNull(), F.col("rows"))).alias("smallest"),
            F.max("feature").alias("feature"),
        ).first()
        below = nodes.select("tree", F.col("rows").alias("whole"), F.col("node").alias("above"), F.explode("children").alias("node"))
        split = nodes.select("tree", "node", "rows").join(below, ["tree", "node"]).groupBy("tree", "above")
        uneven = split.agg(F.sum("rows").alias("parts"), F.max("whole").alias("whole")).where("parts <> whole").count()
        depth = _depth(below.select("tree", "node", "above", F.lit(1).cast("bigint").alias("far")), own["nodes"])
    finally:
        nodes.unpersist()
    return ForestShape(own["trees"], depth, own["smallest"], -1 if own["feature"] is None else own["feature"], uneven)


def _depth(links: DataFrame, nodes: int) -> int:
    """The longest way from a node to the root, node 0, of its tree, from links between each node and the one above."""
    spark = links.sparkSession
    for _ in range(nodes.bit_length() + 1):
        path = scratch_dir(spark, "depths")
        links.write.parquet(path)
        links = spark.read.schema(links.schema).parquet(path)
        found = links.agg(F.max(F.when(F.col("above") == 0, F.col("far"))).alias("depth"), F.count_if(F.col("above") != 0).alias("open")).first()
        if not found["open"]:
            break
        next_up = links.select("tree", F.col("node").alias("above"), F.col("above").alias("top"), F.col("far").alias("more"))
        risen = links.where("above <> 0").join(next_up, ["tree", "above"])
        risen = risen.select("tree", "node", F.col("top").alias("above"), (F.col("far") + F.col("more")).alias("far"))
        links = links.where("above = 0").unionByName(risen)
    return found["depth"] or 0

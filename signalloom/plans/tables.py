"""Fitted models as tables: coefficients and tree nodes as rows, and predictions made from them by joins.

A model in this form can be read, compared and checked without the class that fitted it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.plans.arms import stacked
from signalloom.runtime import attach, literal_table, scratch_path

#: Slot of the number that is added whatever the features are.
INTERCEPT = -1


# --- linear models ----------------------------------------------------------


def coefficient_rows(spark: SparkSession, model: Model) -> DataFrame:
    """(class, slot, weight) of a linear model; a model of two classes has rows of class 1 only."""
    if isinstance(model, OneVsRestModel):
        lines = [(c, [*m.coefficients.toArray().tolist(), m.intercept]) for c, m in enumerate(model.models)]
    elif hasattr(model, "coefficientMatrix") and model.numClasses > 2:
        weights = model.coefficientMatrix.toArray().tolist()
        lines = [(c, [*w, b]) for c, (w, b) in enumerate(zip(weights, model.interceptVector.toArray().tolist()))]
    else:
        lines = [(1, [*model.coefficients.toArray().tolist(), model.intercept])]
    width = len(lines[0][1])
    slots = [*range(width - 1), INTERCEPT]
    columns = {
        "class": [c for c, _ in lines for _ in slots],
        "slot": [s for _ in lines for s in slots],
        "weight": [w for _, row in lines for w in row],
    }
    return literal_table(spark, columns, "class int, slot int, weight double")


def _likeliest(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, prediction): the class of highest score, the smallest of equal ones.

    With one class only its sign decides between 0 and 1.
    """
    best = scores.groupBy(*keys).agg(
        F.max(F.struct("score", (-F.col("class")).alias("c"))).alias("best"), F.count(F.lit(1)).alias("n")
    )
    single = F.when(F.col("best.score") > 0, 1).otherwise(0)
    return best.select(*keys, F.when(F.col("n") == 1, single).otherwise(-F.col("best.c")).cast("int").alias("prediction"))


def linear_predictions(
    rows: DataFrame, coefficients: DataFrame, keys: Sequence[str], features: str = "features"
) -> DataFrame:
    """(keys, prediction) by dot products: every value of a row joined with the coefficients of its slot."""
    values = F.concat(vector_to_array(features), F.array(F.lit(1.0)))
    last = F.size(values) - 1
    cells = rows.select(*keys, last.alias("__last"), F.posexplode(values).alias("slot", "value"))
    cells = cells.withColumn("slot", F.when(F.col("slot") == F.col("__last"), F.lit(INTERCEPT)).otherwise(F.col("slot")))
    scores = attach(cells, coefficients, ["slot"], how="inner", max_rows=1_000_000)
    return _likeliest(scores.groupBy(*keys, "class").agg(F.sum(F.col("value") * F.col("weight")).alias("score")), keys)


# --- trees ------------------------------------------------------------------


def _stored_nodes(spark: SparkSession, model: Model) -> DataFrame:
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(node["leftChild"] >= 0, node["split"]["featureIndex"]).alias("slot"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["gain"].alias("gain"),
        node["prediction"].alias("value"),
        node["impurityStats"].alias("stats"),
    )
    weights = literal_table(
        spark,
        {"tree": list(range(len(model.treeWeights))), "tree_weight": [float(w) for w in model.treeWeights]},
        "tree int, tree_weight double",
    )
    return nodes.join(F.broadcast(weights), "tree")  # a row per tree


def node_rows(spark: SparkSession, model: Model) -> DataFrame:
    """(class, tree, node, slot, threshold, left, right, gain, value, stats, tree_weight) of a tree ensemble.

    Node 0 is a tree's root; leaves have no slot. Thresholds are those of continuous values:
    at most the threshold goes left. ``class`` is that of a one-against-all model, else 1.
    """
    if isinstance(model, OneVsRestModel):
        parts = [_stored_nodes(spark, m).withColumn("class", F.lit(c)) for c, m in enumerate(model.models)]
        return stacked(parts)
    return _stored_nodes(spark, model).withColumn("class", F.lit(1))


def leaves(rows: DataFrame, nodes: DataFrame, depth: int, keys: Sequence[str], features: str = "features") -> DataFrame:
    """(keys, class, tree, value, stats, tree_weight) of the leaf that every row reaches in every tree.

    One join per level; a row that has reached its leaf waits there.
    """
    trees = nodes.where("node = 0").select("class", "tree").collect()
    roots = F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.lit(r["tree"]).alias("tree"), F.lit(0).alias("node")) for r in trees])
    at = rows.select(*keys, vector_to_array(features).alias("__x"), F.inline(roots))
    steps = nodes.select("class", "tree", "node", "slot", "threshold", "left", "right")
    goes_left = F.get("__x", F.col("slot")) <= F.col("threshold")
    then = F.when(F.col("slot").isNull(), F.col("node")).when(goes_left, F.col("left")).otherwise(F.col("right"))
    for _ in range(depth):
        found = at.join(steps, ["class", "tree", "node"])
        at = found.select(*keys, "__x", "class", "tree", then.alias("node"))
    ends = nodes.select("class", "tree", "node", "value", "stats", "tree_weight")
    return at.drop("__x").join(ends, ["class", "tree", "node"]).drop("node")


def forest_predictions(reached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, prediction) of a random forest: every tree votes with the class shares of its leaf."""
    total = F.aggregate("stats", F.lit(0.0), lambda acc, x: acc + x)
    votes = reached.select(*keys, total.alias("__total"), F.posexplode("stats").alias("class", "n"))
    return _likeliest(votes.groupBy(*keys, "class").agg(F.sum(F.col("n") / F.col("__total")).alias("score")), keys)


def boosted_predictions(reached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, prediction) of boosted trees: weighted leaf values add up to a class's margin."""
    margin = F.sum(F.col("value") * F.col("tree_weight")).alias("score")
    return _likeliest(reached.groupBy(*keys, "class").agg(margin), keys)


def importances_from_nodes(nodes: DataFrame) -> DataFrame:
    """(slot, importance): the gain of every split times the weight of its rows, a tree and then the whole adding to one."""
    weight = F.aggregate("stats", F.lit(0.0), lambda acc, x: acc + x)
    gains = nodes.where("slot is not null").groupBy("tree", "slot").agg(F.sum(F.col("gain") * weight).alias("gain"))
    per_tree = gains.groupBy("tree").agg(F.sum("gain").alias("all"))
    shares = gains.join(per_tree, "tree").groupBy("slot").agg(F.sum(F.col("gain") / F.col("all")).alias("share"))
    whole = F.sum("share").over(Window.partitionBy())  # a row per feature
    return shares.select("slot", (F.col("share") / whole).alias("importance"))


# --- metrics ----------------------------------------------------------------


def plain_scores(predictions: DataFrame) -> DataFrame:
    """(n, macro_f1, accuracy) of stored predictions in one SQL statement, for checking reports."""
    return predictions.sparkSession.sql(
        """WITH marks AS (
          SELECT label AS class, IF(label = prediction, 1, 0) AS hit, 1 AS truth, 0 AS guess FROM {rows}
          UNION ALL SELECT prediction, 0, 0, 1 FROM {rows}),
        classes AS (SELECT class, sum(hit) AS hits, sum(truth) AS truths, sum(guess) AS guesses FROM marks GROUP BY class)
        SELECT sum(truths) AS n, avg(2 * hits / (truths + guesses)) AS macro_f1, sum(hits) / sum(truths) AS accuracy FROM classes""",
        rows=predictions,
    )

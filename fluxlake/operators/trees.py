"""Fitted tree ensembles as flat arrays: errors after every boosting round, and several models scored in one scan.

The arrays hold the model alone, whose size the settings bound, and are sent to the tasks; the rows stay where they are.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlake.session import fresh_path

# Executors need not have this package: the functions sent to them carry it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def model_metadata(path: str) -> dict:
    """What a saved model says of itself: its settings and its number of trees."""
    from pyspark.sql import SparkSession

    return json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])


@dataclass
class FlatTrees:
    """Nodes of all trees, tree by tree. A leaf's ``feature`` is -1 and its children are itself, so that walking on from it stays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    @staticmethod
    def of(model: GBTRegressionModel) -> FlatTrees:
        """From the table of nodes that the model's own writer makes."""
        from pyspark.sql import SparkSession

        path = fresh_path(SparkSession.active(), "flat_trees")
        model.write().save(path)
        return FlatTrees.read(path)

    @staticmethod
    def read(path: str) -> FlatTrees:
        """From a saved model."""
        from pyspark.sql import SparkSession

        spark, about = SparkSession.active(), model_metadata(path)
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").toPandas().sort_values("tree")["weight"].to_numpy()
        node = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select(
            "treeID", node["id"].alias("id"), node["prediction"].alias("value"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
            node["split"]["featureIndex"].alias("feature"), F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        ).toPandas().sort_values(["treeID", "id"])
        sizes = nodes.groupby("treeID").size().to_numpy()
        roots = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        base = roots[nodes["treeID"].to_numpy()]
        own, leaf = np.arange(len(nodes)), nodes["left"].to_numpy() < 0
        left, right = np.where(leaf, own, base + nodes["left"]), np.where(leaf, own, base + nodes["right"])
        feature = np.where(leaf, -1, nodes["feature"])
        return FlatTrees(
            feature.astype(np.int32), nodes["threshold"].fillna(0.0).to_numpy(), left.astype(np.int64), right.astype(np.int64), nodes["value"].to_numpy(),
            roots, weights, int((about["defaultParamMap"] | about["paramMap"])["maxDepth"]),
        )

    def rounds(self, rows: np.ndarray) -> np.ndarray:
        """The ensemble's forecast of each row after each round."""
        out = np.empty((len(rows), len(self.roots)))
        each = np.arange(len(rows))
        for i, root in enumerate(self.roots):
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                goes_left = rows[each, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(goes_left, self.left[at], self.right[at])
            out[:, i] = self.value[at] * self.weights[i]
        return np.cumsum(out, axis=1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        return self.rounds(rows)[:, -1]


def round_errors(trees: FlatTrees, rows: DataFrame, inputs: str = "inputs", target: str = "y") -> list[float]:
    """Root mean squared error on ``rows`` after every round, in one scan: tasks send one number per round and batch."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                gap = trees.rounds(np.stack(frame["x"].to_numpy())) - frame["y"].to_numpy()[:, None]
                yield pd.DataFrame({"round": np.arange(gap.shape[1]), "sse": (gap * gap).sum(axis=0), "n": len(gap)})

    parts = rows.select(vector_to_array(inputs).alias("x"), F.col(target).alias("y")).mapInPandas(run, "round int, sse double, n bigint")
    sums = parts.groupBy("round").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    return [row["rmse"] for row in sums.orderBy("round").collect()]


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round with the least error, the first of equals, and whether ``patience`` rounds passed without a gain.

    Rounds after that don't count: boosting would have stopped there.
    """
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            return best, True
    return best, False


def score_trees(rows: DataFrame, models: Mapping[str, FlatTrees], inputs: Sequence[str]) -> DataFrame:
    """``rows`` with a forecast column per model, all from one scan of the inputs."""
    names = list(models)
    if not names:
        return rows
    known = rows.sparkSession.sparkContext.broadcast(dict(models))

    @F.pandas_udf(", ".join(f"`{name}` double" for name in names))
    def score(x: pd.Series) -> pd.DataFrame:
        matrix = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(inputs)))
        return pd.DataFrame({name: known.value[name].predict(matrix) for name in names}, columns=names)

    scored = rows.withColumn("_scored", score(F.array(*[F.col(c).cast("double") for c in inputs])))
    return scored.select(*rows.columns, "_scored.*")

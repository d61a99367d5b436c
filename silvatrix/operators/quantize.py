"""Thresholds in 128 steps a feature, and whether scores bear it.

Quantization is a window over the node table: least and largest threshold by
feature, a rounded step, and the threshold that the step stands for. Tips and
categorical nodes stay as they are.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import Forest
from .scoring import predict

LEVELS = 127


def quantize_nodes(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Numeric inner nodes with q (0 to ``levels``) and the decoded threshold."""
    numeric = nodes.where("not is_leaf and categories is null")
    by = Window.partitionBy("feature")
    lo, hi = F.min("threshold").over(by), F.max("threshold").over(by)
    step = F.when(hi > lo, F.floor((F.col("threshold") - lo) / (hi - lo) * levels + 0.5)).otherwise(0)
    at = numeric.select("tree_id", "node_id", "feature", "threshold", step.cast("int").alias("q"), lo.alias("lo"), (hi - lo).alias("span"))
    return at.select("tree_id", "node_id", "feature", "threshold", "q", (F.col("lo") + F.col("q") / F.lit(float(levels)) * F.col("span")).alias("decoded"))


def quantize(spark, m: Forest, levels: int = LEVELS) -> Forest:
    """The model with decoded thresholds."""
    out = copy.deepcopy(m)
    for r in quantize_nodes(m.node_table(spark), levels).collect():  # a row a node of the model
        out.trees[r["tree_id"]].threshold[r["node_id"]] = r["decoded"]
    return out


def parity(df: DataFrame, exact: Forest, rough: Forest, features: list[str], limit: float = 0.15) -> DataFrame:
    """One row: rows, largest and mean difference of margins, share over ``limit``, whether it passes."""
    at = predict(predict(df, exact, features, "margin", "_a"), rough, features, "margin", "_b")
    if exact.n_outputs > 1:
        diff = F.array_max(F.zip_with("_a", "_b", lambda a, b: F.abs(a - b)))
    else:
        diff = F.abs(F.col("_a") - F.col("_b"))
    over = F.avg(F.when(diff > limit, 1.0).otherwise(0.0))
    return at.agg(F.count(F.lit(1)).alias("n_rows"), F.max(diff).alias("max_diff"), F.avg(diff).alias("mean_diff"), over.alias("fail_rate")).withColumn("passes", F.col("max_diff") <= limit)

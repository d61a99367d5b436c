"""From margins to values: raw, logistic, softmax, exponential, argmax.

All are array expressions in generated code. Softmax subtracts the largest
margin first, so large margins don't overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("raw", "logistic", "softmax", "exponential", "argmax", "leaf_index")

#: Objective (as model files name it) to transform.
OF_OBJECTIVE = {
    "binary:logistic": "logistic",
    "reg:logistic": "logistic",
    "binary": "logistic",
    "cross_entropy": "logistic",
    "multi:softprob": "softmax",
    "multi:softmax": "argmax",
    "multiclass": "softmax",
    "reg:gamma": "exponential",
    "reg:tweedie": "exponential",
    "count:poisson": "exponential",
    "survival:cox": "exponential",
    "survival:aft": "exponential",
    "poisson": "exponential",
    "gamma": "exponential",
    "tweedie": "exponential",
}


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(a: Column) -> Column:
    """Position of the first largest, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def apply(name: str, margins: Column, n_outputs: int) -> Column:
    first = F.get(margins, F.lit(0))
    if name == "softmax":
        return softmax(margins)
    if name == "argmax":
        return argmax(margins)
    one = {"raw": lambda x: x, "logistic": sigmoid, "exponential": F.exp}.get(name)
    if one is None:
        raise ValueError(f"no such transform: {name}")
    return one(first) if n_outputs == 1 else F.transform(margins, one)

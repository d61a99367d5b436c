"""Evaluation metrics as aggregations over (label, prediction[, group]).

Each is a function ``(df, label, pred, **options) -> DataFrame`` with one row
``(value)``, or one row a group before :func:`by_group` averages them. AUC is
computed from counts by distinct score, so its one ordered pass is over
distinct scores in range-partitioned blocks, never over all rows in one task.
Ties of a score get mid-ranks; ranking metrics break ties by ``tie``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_sum

EPS = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _one(df: DataFrame, value: Column) -> DataFrame:
    return df.agg(value.alias("value"))


def rmse_of(label, pred) -> Column:
    return F.sqrt(F.avg((_c(label) - _c(pred)) * (_c(label) - _c(pred))))


def mae_of(label, pred) -> Column:
    return F.avg(F.abs(_c(label) - _c(pred)))


def logloss_of(label, pred) -> Column:
    p = F.least(F.greatest(_c(pred), F.lit(EPS)), F.lit(1 - EPS))
    y = _c(label)
    return F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))


def error_of(label, pred) -> Column:
    return F.avg(F.when(F.when(_c(pred) > 0.5, 1.0).otherwise(0.0) != F.when(_c(label) > 0.5, 1.0).otherwise(0.0), 1.0).otherwise(0.0))


def mape_of(label, pred) -> Column:
    """Over rows with a label other than zero; an error if there are none."""
    y = _c(label)
    mean = F.avg(F.when(y != 0, F.abs((y - _c(pred)) / y)))
    return F.coalesce(mean, F.raise_error(F.lit("mape needs a label other than zero")).cast("double"))


def rmsle_of(label, pred) -> Column:
    low = F.min(F.least(_c(label), _c(pred)))
    d = F.log1p(F.greatest(_c(label), F.lit(0.0))) - F.log1p(F.greatest(_c(pred), F.lit(0.0)))
    return F.when(low < 0, F.raise_error(F.lit("rmsle needs labels and predictions of zero or more")).cast("double")).otherwise(F.sqrt(F.avg(d * d)))


def mlogloss_of(label, probs) -> Column:
    p = F.get(_c(probs), _c(label).cast("int"))
    return F.avg(-F.log(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0))))


def merror_of(label, probs) -> Column:
    best = F.array_position(_c(probs), F.array_max(_c(probs))) - 1
    return F.avg(F.when(best != _c(label).cast("int"), 1.0).otherwise(0.0))


POINTWISE = {"rmse": rmse_of, "mae": mae_of, "logloss": logloss_of, "error": error_of, "mape": mape_of, "rmsle": rmsle_of, "mlogloss": mlogloss_of, "merror": merror_of}


def auc(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Area under the ROC curve by rank sums with mid-ranks; an error without both classes."""
    by_score = df.groupBy(_c(pred).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(_c(label) > 0.5, 1.0).otherwise(0.0)).alias("pos"))
    ranked = running_sum(by_score, "score", "n", "upto")
    rank = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    p, n = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    area = (F.sum(rank * F.col("pos")) - p * (p + 1) / 2) / (p * n)
    return _one(ranked, F.when((p == 0) | (n == 0), F.raise_error(F.lit("auc needs both classes")).cast("double")).otherwise(area))


#: Distinct scores that are ranked on the driver.
FEW_SCORES = 50_000


def auc_of_few(df: DataFrame, label: str, pred: str, most: int = FEW_SCORES) -> float | None:
    """The area where at most ``most`` scores differ, as those of a few trees; else None."""
    by_score = df.groupBy(_c(pred).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.when(_c(label) > 0.5, 1.0).otherwise(0.0)).alias("pos"))
    t = by_score.limit(most + 1).toPandas().sort_values("score")
    if len(t) > most:
        return None
    pos, neg = t["pos"].sum(), (t["n"] - t["pos"]).sum()
    if not pos or not neg:
        raise ValueError("auc needs both classes")
    rank = t["n"].cumsum() - t["n"] + (t["n"] + 1) / 2
    return float(((rank * t["pos"]).sum() - pos * (pos + 1) / 2) / (pos * neg))


def ndcg_by_group(df: DataFrame, label: str, pred: str, group: str, tie: str, k: int | None = None) -> DataFrame:
    """(group, value): gain 2^label - 1 over log2 of the rank; 0 where no label has a gain."""
    by_pred = Window.partitionBy(group).orderBy(_c(pred).desc(), _c(tie))
    by_label = Window.partitionBy(group).orderBy(_c(label).desc(), _c(tie))
    gain = F.pow(F.lit(2.0), _c(label)) - 1
    at = df.select(_c(group), gain.alias("g"), F.row_number().over(by_pred).alias("r"), F.row_number().over(by_label).alias("i"))
    top = lambda r: F.sum(F.when(F.col(r) <= F.lit(k if k else 2**31 - 1), F.col("g") / F.log2(F.col(r) + 1)).otherwise(0.0))
    return at.groupBy(group).agg(top("r").alias("dcg"), top("i").alias("best")).select(group, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("value"))


def map_by_group(df: DataFrame, label: str, pred: str, group: str, tie: str, k: int | None = None) -> DataFrame:
    """(group, value): average precision over all relevant rows (label over 0.5)."""
    w = Window.partitionBy(group).orderBy(_c(pred).desc(), _c(tie))
    at = df.select(_c(group), F.when(_c(label) > 0.5, 1.0).otherwise(0.0).alias("rel"), F.row_number().over(w).alias("r"), F.sum(F.when(_c(label) > 0.5, 1.0).otherwise(0.0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"))
    found = F.sum(F.when((F.col("rel") > 0) & (F.col("r") <= F.lit(k if k else 2**31 - 1)), F.col("hits") / F.col("r")).otherwise(0.0))
    return at.groupBy(group).agg(found.alias("s"), F.sum("rel").alias("n")).select(group, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("value"))


def of_one_group(df: DataFrame, name: str, label: str, pred: str, tie: str, k: int | None = None) -> DataFrame:
    """NDCG or MAP of the whole table as one group: ranks are running counts over ranges, so no task orders all rows."""
    at = df.select(_c(label).cast("double").alias("y"), _c(pred).alias("p"), _c(tie).alias("t")).withColumns({"one": F.lit(1), "rel": F.when(F.col("y") > 0.5, 1.0).otherwise(0.0)})
    most = k if k else 2**62
    by_pred = [F.col("p").desc(), F.col("t").asc()]
    if name == "map":
        ranked = running_sum(at, by_pred, ["one", "rel"], ["r", "hits"])
        found, n = F.sum(F.when((F.col("rel") > 0) & (F.col("r") <= most), F.col("hits") / F.col("r")).otherwise(0.0)), F.sum("rel")
        return _one(ranked, F.when(n > 0, found / n).otherwise(0.0))
    gains = F.sum(F.when(F.col("r") <= most, (F.pow(F.lit(2.0), F.col("y")) - 1) / F.log2(F.col("r") + 1)).otherwise(0.0))
    dcg = running_sum(at, by_pred, "one", "r").agg(gains.alias("dcg"))
    best = running_sum(at, [F.col("y").desc(), F.col("t").asc()], "one", "r").agg(gains.alias("best"))
    return _one(dcg.crossJoin(best), F.max(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0)))  # a row each


def by_group(df: DataFrame, metric, label: str, pred: str, group: str) -> DataFrame:
    """Unweighted mean over groups of a pointwise metric (a name or a function)."""
    of = POINTWISE[metric] if isinstance(metric, str) else metric
    return _one(df.groupBy(group).agg(of(label, pred).alias("v")), F.avg("v"))


#: User metrics: name to ``function(df, label, pred, group, tie) -> DataFrame(value)``.
_CUSTOM: dict = {}


def register(name: str, function) -> None:
    _CUSTOM[name] = function


def names() -> list[str]:
    return sorted([*POINTWISE, "auc", "aucpr", "ndcg", "map", *_CUSTOM])


def larger_is_better(name: str) -> bool:
    return re.split("[@:]", name.lower())[0] in ("auc", "aucpr", "ndcg", "map")


def default_for(objective: str, k: int | None = None) -> str:
    if objective == "binary:logistic":
        return "auc"
    if objective.startswith("multi:"):
        return "mlogloss"
    if objective.startswith("rank:"):
        return f"ndcg@{k}" if k else "ndcg"
    return "rmse"


def evaluate(df: DataFrame, name: str, label: str = "label", pred: str = "prediction", group: str | None = None, tie: str | None = None) -> DataFrame:
    """One row (value). Names: see :func:`names`; ``ndcg@k`` and ``map@k`` cut; ``aucpr`` is ``auc``."""
    name = name.strip().lower()
    if name in _CUSTOM:
        return _CUSTOM[name](df, label, pred, group, tie)
    m = re.fullmatch(r"(ndcg|map)(?:@(\d+))?", name)
    if m:
        of = ndcg_by_group if m[1] == "ndcg" else map_by_group
        if group is None:
            return of_one_group(df, m[1], label, pred, tie or label, int(m[2]) if m[2] else None)
        return _one(of(df, label, pred, group, tie or label, int(m[2]) if m[2] else None), F.avg("value"))
    if name in ("auc", "aucpr"):
        return auc(df, label, pred)
    if name not in POINTWISE:
        raise ValueError(f"no such metric: {name}")
    return by_group(df, name, label, pred, group) if group else _one(df, POINTWISE[name](label, pred))

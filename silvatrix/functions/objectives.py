"""Training objectives: gradient and hessian of each row, and the starting score.

Pointwise ones are column expressions. Survival and ranking ones take a table:
risk sets and groups are windows, ranking pairs a self-join within the group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .transforms import sigmoid, softmax
from .windows import running_sum

MIN_HESS = 1e-16


def weight(w: str | None) -> Column:
    """Row weight; none, or one of zero or less, counts as one."""
    return F.lit(1.0) if w is None else F.when(F.col(w) > 0, F.col(w)).otherwise(1.0)


def _floor(x: Column) -> Column:
    return F.greatest(x, F.lit(MIN_HESS))


# --- pointwise: (y, p, w) -> (grad, hess) -----------------------------------------


def squared_error(y: Column, p: Column, w: Column):
    return (p - y) * w, w


def logistic(y: Column, p: Column, w: Column):
    s = sigmoid(p)
    return (s - y) * w, _floor(s * (1 - s) * w)


def gamma(y: Column, p: Column, w: Column):
    ratio = F.when(y > 0, y).otherwise(MIN_HESS) / F.exp(p)
    return (1 - ratio) * w, _floor(ratio * w)


def poisson(y: Column, p: Column, w: Column):
    mu = F.exp(p)
    return (mu - y) * w, _floor(mu) * w


def tweedie(y: Column, p: Column, w: Column, power: float = 1.5):
    power = min(max(power, 1 + 1e-6), 2 - 1e-6)
    y = F.greatest(y, F.lit(0.0))
    a, b = F.exp((1 - power) * p), F.exp((2 - power) * p)
    return (b - y * a) * w, _floor(((2 - power) * b - (1 - power) * y * a) * w)


def softprob(y: Column, margins: Column, w: Column, classes: int):
    """Arrays of gradients and hessians; a label out of range gives zeros."""
    p = softmax(margins)
    bad = (y < 0) | (y >= classes)
    ks = F.sequence(F.lit(0), F.lit(classes - 1))
    grad = F.transform(ks, lambda k: F.when(bad, 0.0).otherwise((F.get(p, k) - F.when(k == y.cast("int"), 1.0).otherwise(0.0)) * w))
    hess = F.transform(ks, lambda k: F.when(bad, 0.0).otherwise(_floor(2 * F.get(p, k) * (1 - F.get(p, k)) * w)))
    return grad, hess


def aft(lower: Column, upper: Column, p: Column, w: Column):
    """Exponential accelerated failure time over an interval (lower, upper).

    The scale is exp(p). Upper is infinite for a right-censored row, equal to
    lower for an event; a lower of zero is left-censoring. With S the chance of
    surviving, censored rows get minus the slope of log(S(lower) - S(upper)) in
    the scale, as ``-t S(t)`` terms; their hessian is the gradient's size.
    """
    low, high = lower / F.exp(p), upper / F.exp(p)
    s_low, s_high = F.exp(-low), F.exp(-high)
    mass = F.greatest(F.when(lower == 0, 1 - s_high).otherwise(s_low - s_high), F.lit(MIN_HESS))
    slope = F.when(lower == 0, high * s_high).otherwise(s_low * low - s_high * high) / mass
    is_right, is_event = upper == float("inf"), lower == upper
    grad = F.when(is_right, -low).when(is_event, 1 - low).otherwise(-slope)
    hess = F.when(is_right | is_event, low).otherwise(F.abs(slope))
    return grad * w, _floor(hess) * w


# --- starting scores ----------------------------------------------------------------


def weighted_mean(y: Column, w: Column) -> Column:
    return F.sum(w * y) / F.sum(w)


def log_odds(y: Column, w: Column) -> Column:
    """log(positives / negatives) by weight; 0 if one of them is missing."""
    pos, neg = F.sum(F.when(y > 0.5, w).otherwise(0.0)), F.sum(F.when(y > 0.5, 0.0).otherwise(w))
    return F.when((pos <= 0) | (neg <= 0), 0.0).otherwise(F.log(pos / F.greatest(neg, F.lit(MIN_HESS))))


def log_mean(y: Column, w: Column, positive_only: bool = False) -> Column:
    if positive_only:
        m = F.sum(F.when(y > 0, w * y)) / F.sum(F.when(y > 0, w))
        return F.coalesce(F.log(m), F.lit(0.0))
    m = weighted_mean(y, w)
    return F.when(m > 0, F.log(m)).otherwise(0.0)


# --- survival -------------------------------------------------------------------------


def cox(df: DataFrame, y: str = "label", p: str = "margin", key: str = "row_id", w: str | None = None) -> DataFrame:
    """``df`` with grad and hess of the Cox partial likelihood.

    A positive label is the time of an event, a negative one minus the time of
    censoring. Risk sets need only sums by distinct time. The running order of
    tied rows comes from a running count of events over (time, ``key``), in
    ranges of both, so a time with many rows is dealt out to many tasks; in the
    join with the table of times adaptive execution splits it.
    """
    rows = df.withColumns({"_t": F.abs(F.col(y)), "_e": F.exp(F.col(p)), "_ev": F.when(F.col(y) > 0, 1.0).otherwise(0.0)})
    times = rows.groupBy("_t").agg(F.sum("_e").alias("_sum"), F.sum("_ev").alias("_events"))
    risk = running_sum(times, "_t", "_sum", "_risk", ascending=False)
    risk = risk.withColumns({"_r1": F.col("_events") / F.col("_risk"), "_r2": F.col("_events") / (F.col("_risk") * F.col("_risk"))})
    upto = running_sum(risk, "_t", ["_r1", "_r2", "_events"], ["_s1", "_s2", "_se"])
    upto = upto.select("_t", "_risk", (F.col("_s1") - F.col("_r1")).alias("_b1"), (F.col("_s2") - F.col("_r2")).alias("_b2"), (F.col("_se") - F.col("_events")).alias("_be"))
    at = running_sum(rows, [F.col("_t").asc(), F.col(key).asc()], "_ev", "_upto").join(upto, "_t")
    events = F.col("_upto") - F.col("_be")  # of this time, up to and with this row
    r = F.col("_b1") + events / F.col("_risk")
    s = F.col("_b2") + events / (F.col("_risk") * F.col("_risk"))
    out = at.withColumns({"grad": (F.col("_e") * r - F.col("_ev")) * weight(w), "hess": _floor((F.col("_e") * r - F.col("_e") * F.col("_e") * s) * weight(w))})
    return out.drop("_t", "_e", "_ev", "_risk", "_b1", "_b2", "_be", "_upto")


# --- ranking -----------------------------------------------------------------------------


@dataclass(frozen=True)
class RankConfig:
    """How pairs of a group are made and weighed.

    Pairs: ``full``; ``topk``, one row of a pair among the k best; or ``mean``,
    k partners a row, drawn with replacement from the rows of other labels.
    ``ndcg_k`` cuts the ideal gain at so many rows; with ``max_position`` pairs
    whose rows both stand at or behind it have no weight (0: no such bound).
    """

    pairs: str = "topk"
    k: int = 32
    normalize: bool | None = None  # none: unless full
    score_difference: bool = False
    seed: int = 0
    ndcg_k: int = 0
    max_position: int = 0

    @property
    def normalized(self) -> bool:
        return self.pairs != "full" if self.normalize is None else self.normalize


def ranked(df: DataFrame, label: str, pred: str, group: str, tie: str) -> DataFrame:
    """With _rank by prediction and _ideal by label, both from 0."""
    return df.withColumns({
        "_rank": F.row_number().over(Window.partitionBy(group).orderBy(F.col(pred).desc(), tie)) - 1,
        "_ideal": F.row_number().over(Window.partitionBy(group).orderBy(F.col(label).desc(), tie)) - 1,
    })


def drawn_number(seed: int, *of: Column) -> Column:
    """A number of 32 bits from the MD5 of these, the same in any SQL engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in of])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _pairs(base: DataFrame, config: RankConfig) -> DataFrame:
    """(q, hi, lo): rows of a group of which the first has the larger label.

    Each kind is an equality join whose rows grow with the group's rows, but
    for ``full``, which is all pairs by its definition.
    """
    rest = [c for c in base.columns if c != "q"]
    one, two = base.select("q", F.struct(*rest).alias("x")), base.select("q", F.struct(*rest).alias("y"))
    if config.pairs == "full":
        return one.join(two, "q").where("x.y > y.y").select("q", F.col("x").alias("hi"), F.col("y").alias("lo"))
    if config.pairs == "topk":
        met = one.where(F.col("x._rank") < config.k).join(two, "q").where(F.expr(f"y._rank >= {config.k} OR x._rank < y._rank"))
    elif config.pairs == "mean":
        label, group = Window.partitionBy("q", "y"), Window.partitionBy("q")
        sized = base.withColumns({"_from": F.min("_ideal").over(label), "_to": F.max("_ideal").over(label) + 1, "_n": F.count(F.lit(1)).over(group)})
        others = F.col("_n") - F.col("_to") + F.col("_from")
        draw = drawn_number(config.seed, F.col("q"), F.col("i"), F.col("_draw")) % others
        draws = sized.where(others > 0).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(config.k - 1))))
        draws = draws.select("q", F.struct(*rest).alias("x"), F.when(draw < F.col("_from"), draw).otherwise(draw - F.col("_from") + F.col("_to")).alias("_at"))
        met = draws.join(two.withColumn("_at", F.col("y._ideal").cast("long")), ["q", "_at"])
    else:
        raise ValueError(f"no such pairs: {config.pairs}")
    higher = F.expr("x.y > y.y")
    return met.where("x.y <> y.y").select("q", F.when(higher, F.col("x")).otherwise(F.col("y")).alias("hi"), F.when(higher, F.col("y")).otherwise(F.col("x")).alias("lo"))


def pair_gradients(df: DataFrame, kind: str, config: RankConfig, label: str = "label", pred: str = "margin", group: str = "qid", tie: str = "row_id", w: str | None = None) -> DataFrame:
    """(group, tie, grad, hess): RankNet lambdas, times |delta NDCG| for kind ``ndcg``."""
    base = ranked(df, label, pred, group, tie).select(F.col(group).alias("q"), F.col(tie).alias("i"), F.col(label).cast("double").alias("y"), F.col(pred).cast("double").alias("s"), "_rank", weight(w).alias("w"), "_ideal")
    gain = lambda y: F.pow(F.lit(2.0), F.col(y)) - 1
    discount = lambda r: 1 / F.log2(F.col(r) + 2)
    ends = [F.lit(1.0).alias("best")]
    if kind == "ndcg":
        counts = F.lit(True) if not config.ndcg_k else F.col("_ideal") < config.ndcg_k
        ends = [F.sum(F.when(counts, gain("y") * discount("_ideal")).otherwise(0.0)).alias("best")]
    of_group = base.groupBy("q").agg(*ends, (F.max("s") != F.min("s")).alias("apart"))
    pairs = _pairs(base, config).join(of_group, "q")
    rho = 1 / (1 + F.exp(F.col("hi.s") - F.col("lo.s")))  # chance of the wrong order
    delta = F.lit(1.0)
    if kind == "ndcg":
        delta = F.when(F.col("best") > 0, F.abs((gain("hi.y") - gain("lo.y")) * (discount("hi._rank") - discount("lo._rank"))) / F.col("best")).otherwise(0.0)
        if config.max_position:
            delta = F.when(F.least("hi._rank", "lo._rank") < config.max_position, delta).otherwise(0.0)
    if config.score_difference:
        delta = F.when(F.col("apart"), delta / (F.abs(F.col("hi.s") - F.col("lo.s")) + 0.01)).otherwise(delta)
    delta = delta * F.col("hi.w") * F.col("lo.w")
    lam = rho * delta
    hess = rho * (1 - rho) * delta if config.pairs == "full" and not config.normalized else 2 * _floor(rho * (1 - rho)) * delta
    each = pairs.select("q", F.explode(F.array(F.struct(F.col("hi.i").alias("i"), (-lam).alias("g"), hess.alias("h")), F.struct(F.col("lo.i").alias("i"), lam.alias("g"), hess.alias("h")))).alias("x"), lam.alias("lam"))
    sums = each.groupBy("q", F.col("x.i").alias("i")).agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h"), F.sum("lam").alias("lam"))
    if config.normalized:
        total = sums.groupBy("q").agg(F.sum("lam").alias("total"))  # each pair counted at both rows: twice the sum of lambdas
        scale = F.when(F.col("total") > 0, F.log2(1 + F.col("total")) / F.col("total")).otherwise(1.0)
        sums = sums.join(total, "q").select("q", "i", (F.col("g") * scale).alias("g"), (F.col("h") * scale).alias("h"))
    out = base.select("q", "i").join(sums, ["q", "i"], "left")
    return out.select(F.col("q").alias(group), F.col("i").alias(tie), F.coalesce("g", F.lit(0.0)).alias("grad"), _floor(F.coalesce("h", F.lit(0.0))).alias("hess"))


def listwise_loss(df: DataFrame, label: str = "label", pred: str = "margin", group: str = "qid") -> DataFrame:
    """(group, loss): cross entropy of softmax(label) and softmax(prediction)."""
    win = Window.partitionBy(group)
    soft = {n: F.exp(F.col(c) - F.max(c).over(win)) for n, c in (("_t", label), ("_p", pred))}
    at = df.select(group, *[c.alias(n) for n, c in soft.items()])
    sums = at.select(group, *[(F.col(n) / F.sum(n).over(win)).alias(n) for n in soft])
    return sums.groupBy(group).agg((-F.sum(F.col("_t") * F.log(F.greatest("_p", F.lit(1e-15))))).alias("loss"))


def listwise(df: DataFrame, label: str = "label", pred: str = "margin", group: str = "qid", w: str | None = None) -> DataFrame:
    """``df`` with grad = softmax(prediction) - softmax(label) within the group; groups of one get zeros."""
    win = Window.partitionBy(group)

    def soft(c):
        e = F.exp(F.col(c) - F.max(c).over(win))
        return e

    at = df.withColumns({"_p": soft(pred), "_t": soft(label), "_n": F.count(F.lit(1)).over(win)})
    at = at.withColumns({"_p": F.col("_p") / F.sum("_p").over(win), "_t": F.col("_t") / F.sum("_t").over(win)})
    alone = F.col("_n") < 2
    return at.withColumns({"grad": F.when(alone, 0.0).otherwise((F.col("_p") - F.col("_t")) * weight(w)), "hess": F.when(alone, 0.0).otherwise(_floor(F.col("_p") * (1 - F.col("_p")) * weight(w)))}).drop("_p", "_t", "_n")


def pair_gradient(high: Column, low: Column, w: Column | None = None) -> tuple[Column, Column]:
    """(grad, hess) of the first of two rows, of which it has the larger label, from their predictions; the second has minus the gradient and the same hessian."""
    rho = 1 / (1 + F.exp(high - low))
    w = F.lit(1.0) if w is None else w
    return -rho * w, _floor(rho * (1 - rho)) * w


# --- registry ------------------------------------------------------------------------------

POINTWISE = {"reg:squarederror": squared_error, "binary:logistic": logistic, "reg:gamma": gamma, "count:poisson": poisson, "reg:tweedie": tweedie}
NAMES = (*POINTWISE, "multi:softmax", "multi:softprob", "survival:cox", "survival:aft", "rank:pairwise", "rank:ndcg", "rank:listwise")


def register(name: str, gradient) -> None:
    """Add a pointwise objective: ``gradient(y, p, w) -> (grad, hess)`` columns."""
    POINTWISE[name] = gradient


#: Objectives of whole groups: name to (function, rows of a group at most).
GROUPED: dict[str, tuple[Callable, int]] = {}


def register_grouped(name: str, gradient: Callable, max_rows: int = 100_000) -> None:
    """Add an objective of groups: ``gradient(y, p, w) -> (grad, hess)``, numpy arrays of a group's rows in order of their id.

    A group goes to one task, so a larger one than ``max_rows`` is an error.
    """
    GROUPED[name] = gradient, max_rows


def grouped(df: DataFrame, name: str, label: str, pred: str, group: str, tie: str, w: str | None = None) -> DataFrame:
    """``df`` with grad and hess by an objective of groups; a null group is one."""
    gradient, most = GROUPED[name]
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a group has {largest} rows, and {name} takes {most} at most")
    at = df.withColumns({"_gy": F.col(label).cast("double"), "_gp": F.col(pred).cast("double"), "_gw": weight(w).cast("double")})

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.column(tie)))
        g, h = gradient(*(t.column(c).to_numpy() for c in ("_gy", "_gp", "_gw")))
        return t.drop_columns(["_gy", "_gp", "_gw"]).append_column("grad", pa.array(np.asarray(g, float))).append_column("hess", pa.array(np.asarray(h, float)))

    schema = T.StructType([*df.schema.fields, T.StructField("grad", T.DoubleType()), T.StructField("hess", T.DoubleType())])
    return at.groupBy(group).applyInArrow(run, schema)


def start(objective: str, y: Column, w: Column) -> Column:
    """Aggregate that gives the starting margin."""
    if objective == "reg:squarederror":
        return weighted_mean(y, w)
    if objective == "binary:logistic":
        return log_odds(y, w)
    if objective in ("reg:gamma", "count:poisson", "reg:tweedie"):
        return log_mean(y, w)
    if objective == "survival:aft":
        return log_mean(y, w, positive_only=True)
    return F.lit(0.0)

"""Training of boosted trees and linear models over DataFrames.

The driver holds the model and the loop; the data stay where they are. A level
of all trees of a round, whatever the classes, is one job: gradients are summed
into histograms (:mod:`.dense`; for all midpoints, grouped by value) and the best
split of each open node comes back. Which node a row is in is a column that is
advanced by a lookup of the splits, so nothing is joined and plans don't grow
with the level. Trees of a few rounds are folded into the stored margin by a
checkpoint in the shared folder, so they don't grow with the rounds either.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, objectives, sampling, transforms
from ..functions.storage import stored
from ..operators import scoring
from . import dense, splits
from .model import Forest, Linear, Tree

#: Rows up to which "auto" searches all midpoints.
EXACT_ROWS = 30_000
#: Rounds between checkpoints of the margin.
FOLD_ROUNDS = 4


@dataclass
class Params:
    objective: str = "reg:squarederror"
    rounds: int = 10
    eta: float = 0.3
    booster: str = "gbtree"  # gbtree, dart or gblinear
    method: str = "auto"  # auto, exact or hist
    max_depth: int = 6
    max_tips: int = 0
    min_hess: float = 1e-3
    lam: float = 0.0
    gamma: float = 0.0
    max_bin: int = 256
    per_node_bins: bool = False
    subsample: float = 1.0
    colsample: float = 1.0
    parallel_trees: int = 1
    num_class: int = 1
    categorical: tuple[int, ...] = ()
    monotone: dict[int, int] = field(default_factory=dict)
    drop_rate: float = 0.1
    dart_normalize: str = "tree"
    metric: str = ""
    eval_every: int = 1  # rounds between evaluations; the last one is always evaluated
    early_stopping: int = 0
    eta_schedule: Callable[[int], float] | None = None
    power: float = 1.5
    rank: objectives.RankConfig = field(default_factory=objectives.RankConfig)
    seed: int = 0

    @property
    def outputs(self) -> int:
        return self.num_class if self.objective.startswith("multi:") else 1


def exponential_decay(eta: float, rate: float) -> Callable[[int], float]:
    return lambda r: eta * rate**r


def step_decay(eta: float, every: int, factor: float) -> Callable[[int], float]:
    return lambda r: eta * factor ** (r // every)


@dataclass
class Columns:
    """Which columns of the training table are what."""

    features: list[str]
    label: str = "label"
    row_id: str = "row_id"
    weight: str | None = None
    group: str | None = None
    lower: str | None = None
    upper: str | None = None


@dataclass
class History:
    metric: str = ""
    train: list[float] = field(default_factory=list)
    eval: list[float] = field(default_factory=list)
    rounds: list[int] = field(default_factory=list)  # those that were evaluated
    best_round: int = -1


def sample_columns(n: int, rate: float, seed: int) -> list[int]:
    """At least one column, ascending."""
    take = max(1, int(n * rate)) if rate < 1 else n
    return sorted(np.random.default_rng(seed).permutation(n)[:take].tolist())


def draws(df: DataFrame, p: Params, c: Columns, seeds: list[int]) -> list[Column] | None:
    """For each tree whether it gets a row: floor(rows * rate) of them, by the rank of a hash."""
    if p.subsample >= 1:
        return None
    key = [F.col(x) for x in (c.group, c.row_id) if x]
    count = max(1, math.floor(df.count() * p.subsample))
    hashes = [sampling.hash_of(seed, *key) for seed in seeds]
    return [h <= bound for h, bound in zip(hashes, sampling.kth_least(df, [(h, count) for h in hashes]))]


def gradients(df: DataFrame, p: Params, c: Columns, output: int = 0) -> DataFrame:
    """``df`` with grad and hess for one output, from its array ``margin``."""
    y, m, w = F.col(c.label).cast("double") if c.label in df.columns else F.lit(None), F.get("margin", F.lit(output)), objectives.weight(c.weight)
    if p.objective.startswith("multi:"):
        g, h = objectives.softprob(y, F.col("margin"), w, p.num_class)
        return df.withColumns({"grad": F.get(g, F.lit(output)), "hess": F.get(h, F.lit(output))})
    if p.objective == "survival:aft":
        g, h = objectives.aft(F.col(c.lower or c.label).cast("double"), F.col(c.upper or c.label).cast("double"), m, w)
    elif p.objective == "survival:cox":
        return objectives.cox(df.withColumn("_m", m), c.label, "_m", c.row_id, c.weight).drop("_m")
    elif p.objective == "rank:listwise":
        return objectives.listwise(df.withColumn("_m", m), c.label, "_m", c.group, c.weight).drop("_m")
    elif p.objective in objectives.GROUPED:
        return objectives.grouped(df.withColumn("_m", m), p.objective, c.label, "_m", c.group, c.row_id, c.weight).drop("_m")
    elif p.objective.startswith("rank:"):
        found = objectives.pair_gradients(df.withColumn("_m", m), p.objective[5:], p.rank, c.label, "_m", c.group, c.row_id, c.weight)
        return df.join(found, [c.group, c.row_id])
    elif p.objective == "reg:tweedie":
        g, h = objectives.tweedie(y, m, w, p.power)
    elif p.objective in objectives.POINTWISE:
        g, h = objectives.POINTWISE[p.objective](y, m, w)
    else:
        raise ValueError(f"no such objective: {p.objective}")
    return df.withColumns({"grad": g, "hess": h})


class _Grown:
    """A tree while it grows: nodes by number, children 2i+1 and 2i+2."""

    def __init__(self):
        self.split: dict[int, dict] = {}
        self.sums: dict[int, tuple[float, float, int]] = {0: (0.0, 0.0, 0)}

    def add(self, n: int, feature: int, threshold: float, gain: float, categorical: bool, gl: float, hl: float, nl: int) -> None:
        g, h, count = self.sums[n]
        self.split[n] = {"feature": feature, "threshold": threshold, "gain": gain, "categorical": categorical}
        self.sums[2 * n + 1], self.sums[2 * n + 2] = (gl, hl, nl), (g - gl, h - hl, count - nl)

    def limit_tips(self, most: int) -> None:
        """Keep splits in pre-order as long as the tips stay within ``most``."""
        tips, keep, todo = 1, set(), [0]
        while todo:
            at = todo.pop()
            if at in self.split and tips < most:
                tips += 1
                keep.add(at)
                todo += [2 * at + 2, 2 * at + 1]
        self.split = {k: v for k, v in self.split.items() if k in keep}

    def tree(self, lam: float, eta: float) -> Tree:
        t = Tree()

        def leaf(at: int) -> int:
            g, h, _ = self.sums[at]
            t.leaf_value.append([-g / (h + lam) * eta if h + lam else 0.0])
            t.leaf_cover.append(h)
            return ~(t.tips - 1)

        def build(at: int) -> int:
            s = self.split.get(at)
            if s is None:
                return leaf(at)
            n = t.add(s["feature"], s["threshold"], 0, 0, missing_nan=True, categories=[int(s["threshold"])] if s["categorical"] else None, gain=s["gain"], cover=self.sums[at][1])
            t.left[n] = build(2 * at + 1)
            t.right[n] = build(2 * at + 2)
            return n

        build(0)
        return t


@dataclass
class Round:
    """The trees of a round: for each its output, the features it may use, and the threshold values of bins."""

    method: str  # exact, hist or per-node
    outputs: int
    tree_output: list[int]
    allowed: list[list[int]]
    cuts: list[list[float]] = field(default_factory=list)

    def search(self, p: Params, ends: list[int]) -> dense.Search:
        coded = frozenset(p.categorical)
        return dense.Search(tuple(dense.CODES if i in coded else n for i, n in enumerate(ends)), tuple(map(frozenset, self.allowed)), p.lam, p.gamma, coded, tuple(sorted(p.monotone.items())))


def values_array(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])


def round_table(current: DataFrame, p: Params, c: Columns, draws: list[Column] | None = None, trees: int = 1) -> DataFrame:
    """What growth works on, from rows with ``_x`` and ``margin``: gradients of all outputs, and the root as node of each tree."""
    if p.objective.startswith("multi:"):
        g, h = objectives.softprob(F.col(c.label).cast("double"), F.col("margin"), objectives.weight(c.weight), p.num_class)
    else:
        current, g, h = gradients(current, p, c), F.array("grad"), F.array("hess")
    at = F.array(*[F.when(d, F.lit(0)).otherwise(-1).cast("long") for d in draws or [F.lit(True)] * trees])
    return current.select("_x", g.alias("_g"), h.alias("_h"), at.alias("_at"))


def grow_round(work: DataFrame, p: Params, r: Round, width: int, eta: float) -> list[Tree]:
    """All trees of a round on ``work``, a job a level for all of them."""
    trees = [_Grown() for _ in r.tree_output]
    # ``at`` has the nodes as last stored, ``levels`` the splits since; ``stale``: what ``at`` was made from.
    parts, at, stale, levels, before = dense.tasks(work), work, [], [], None
    is_open = lambda t, n: trees[t].sums[n][1] >= p.min_hess and trees[t].sums[n][2] > 1
    open_ = [(t, 0) for t in range(len(trees))]
    if r.method != "hist":
        _add_totals(work, r, trees)
        open_ = [x for x in open_ if is_open(*x)]
    for depth in range(p.max_depth):
        if not open_:
            break
        if r.method == "exact":
            found = _exact_level(dense.keep_nodes(at, levels, width, len(trees)), p, r, width)
        elif r.method == "per-node":
            found = _per_node_level(at, parts, open_, levels, p, r, width)
        else:
            fill = open_ if before is None else sorted({(t, min((2 * ((n - 1) // 2) + k for k in (1, 2)), key=lambda x: (trees[t].sums[x][2], x))) for t, n in open_})  # noqa: B023
            search = r.search(p, [len(x) for x in r.cuts])
            hist = dense.level_histograms(at, parts, fill, levels, search, r.outputs, r.tree_output, before).persist()
            rows = hist.drop("g", "h", "n").collect()  # a row a node and block of features
            if before is not None:
                before.unpersist()
            before = hist
            if depth == 0:
                for row in rows:
                    trees[row["tree"]].sums[0] = (row["gt"], row["ht"], row["nt"])
            found = {}
            for row in sorted((x for x in rows if x["feature"] is not None), key=lambda x: (-x["gain"], x["feature"])):
                f, coded = row["feature"], row["feature"] in p.categorical
                found.setdefault((row["tree"], row["node"]), (f, float(row["pos"]) if coded else r.cuts[f][row["pos"]], float(row["pos"]), row["gain"], coded, row["gl"], row["hl"], row["nl"]))
        for x in stale:
            x.unpersist()
        stale = []
        children, bounds = [], [{} for _ in trees]
        for t, n in sorted(open_):
            if (t, n) in found and is_open(t, n):
                f, threshold, bound, gain, coded, *left = found[t, n]
                trees[t].add(n, f, threshold, gain, coded, *left)
                bounds[t][n] = (f, bound, coded)
                children += [(t, 2 * n + 1), (t, 2 * n + 2)]
        levels = [*levels, dense.Level.of(bounds)]
        open_ = [x for x in children if is_open(*x)]
        if len(levels) >= dense.KEEP_LEVELS and open_ and depth + 1 < p.max_depth:
            stale = [] if at is work else [at]
            at, levels = dense.keep_nodes(at, levels, width, len(trees)).persist(), []
    for x in [*stale, *([] if at is work else [at]), *([] if before is None else [before])]:
        x.unpersist()
    for t in trees:
        if p.max_tips > 0:
            t.limit_tips(p.max_tips)
    return [t.tree(p.lam, eta) for t in trees]


def _add_totals(work: DataFrame, r: Round, trees: list[_Grown]) -> None:
    inside = [F.get("_at", F.lit(t)) >= 0 for t in range(len(trees))]
    of = lambda name, t: F.sum(F.when(inside[t], F.get(name, F.lit(r.tree_output[t]))))
    row = work.agg(*[x.alias(f"{k}{t}") for t in range(len(trees)) for k, x in (("g", of("_g", t)), ("h", of("_h", t)), ("n", F.count_if(inside[t])))]).first()
    for t, tree in enumerate(trees):
        tree.sums[0] = (row[f"g{t}"] or 0.0, row[f"h{t}"] or 0.0, row[f"n{t}"])


def _per_node_level(at: DataFrame, parts: int, open_: list[tuple[int, int]], levels: list[dense.Level], p: Params, r: Round, width: int) -> dict:
    """Best splits with bins of each node's own."""
    if p.categorical:
        raise ValueError("bins of each node's own are for numeric features")
    out = {}
    for chunk in dense.in_chunks(open_, r.search(p, [p.max_bin] * width)):
        cuts = dense.node_cuts(at, parts, chunk, levels, width, len(r.tree_output), p.max_bin)
        search = r.search(p, [max(len(c[f]) for c in cuts.values()) for f in range(width)])
        bins = dense.binned_by_node(at, cuts, levels, width, len(r.tree_output))
        rows = dense.level_histograms(bins, parts, chunk, [], search, r.outputs, r.tree_output, None).drop("g", "h", "n").where("feature IS NOT NULL").collect()
        for x in sorted(rows, key=lambda x: (-x["gain"], x["feature"])):
            threshold = float(cuts[x["tree"], x["node"]][x["feature"]][x["pos"]])
            out.setdefault((x["tree"], x["node"]), (x["feature"], threshold, threshold, x["gain"], False, x["gl"], x["hl"], x["nl"]))
    return out


#: A node's number and its tree in one.
_TREE = 1 << 40


def _exact_level(at: DataFrame, p: Params, r: Round, width: int) -> dict:
    """Best splits among all midpoints, grouped by value."""
    used = sorted({f for a in r.allowed for f in a})
    rows = at.select("_x", "_g", "_h", F.posexplode("_at").alias("t", "n")).where("n >= 0")
    output = F.get(F.array(*[F.lit(k) for k in r.tree_output]), F.col("t"))
    rows = rows.select("_x", F.get("_g", output).alias("grad"), F.get("_h", output).alias("hess"), (F.col("t") * F.lit(_TREE) + F.col("n")).alias("_node"))
    out = None
    upto = Window.partitionBy("node", "feature").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for coded in (False, True):
        mine = [f for f in used if (f in p.categorical) == coded]
        if not mine:
            continue
        hist = splits.histogram(rows, "_node", {str(f): F.get("_x", F.lit(f)) for f in mine})
        hist = hist.withColumn("feature", F.get(F.array(*[F.lit(f) for f in mine]), F.col("feature")))
        found = splits.one_against_rest(hist, p.lam) if coded else splits.candidates(hist, splits.next_midpoint(), p.lam, F.isnan("pos"))
        one = found.select("node", "feature", "threshold", "gain", F.lit(coded).alias("categorical"), "gl", "hl", (F.col("n") if coded else F.sum("n").over(upto)).alias("nl"), "G", "H")
        out = one if out is None else out.unionByName(one)
    if any(a != used for a in r.allowed):
        allowed = F.array(*[F.array(*[F.lit(f) for f in a]) for a in r.allowed])
        out = out.where(F.array_contains(F.get(allowed, F.expr(f"int(node div {_TREE})")), F.col("feature")))
    best = splits.best_splits(out, p.gamma, p.monotone, p.lam).collect()  # a row an open node at most
    return {(x["node"] // _TREE, x["node"] % _TREE): (x["feature"], float(x["threshold"]), float(x["threshold"]), x["gain"], x["categorical"], x["gl"], x["hl"], x["nl"]) for x in best}


def link(p: Params, margins: Column) -> Column:
    """From margins to what the objective's metric takes."""
    if p.objective.startswith("multi:"):
        return transforms.softmax(margins)
    first = F.get(margins, F.lit(0))
    if p.objective == "binary:logistic":
        return transforms.sigmoid(first)
    if p.objective in ("reg:gamma", "count:poisson", "reg:tweedie", "survival:aft"):
        return F.exp(first)
    return first


def evaluate(df: DataFrame, model, p: Params, c: Columns, metric: str = "") -> float:
    return evaluate_margin(df.withColumn("margin", scoring.margins(model, c.features)), p, c, metric)


def evaluate_margin(df: DataFrame, p: Params, c: Columns, metric: str = "") -> float:
    """The metric of a table that has its margins already."""
    name = metric or p.metric or metrics.default_for(p.objective)
    at = df.withColumn("_p", link(p, F.col("margin")))
    if name in ("auc", "aucpr") and (found := metrics.auc_of_few(at, c.label, "_p")) is not None:
        return found
    return float(metrics.evaluate(at, name, c.label, "_p", c.group, c.row_id).first()["value"])


def resolve_method(df: DataFrame, p: Params) -> str:
    if p.method != "auto":
        return p.method
    return "exact" if df.limit(EXACT_ROWS).count() < EXACT_ROWS else "hist"


def train(df: DataFrame, p: Params, c: Columns, eval_df: DataFrame | None = None, callbacks=(), resume: Forest | None = None, checkpoint_path: str | None = None) -> tuple[Forest | Linear, History]:
    """Fit a model. ``callbacks`` are called with (round, model, history); a true result stops."""
    if (p.objective.startswith("rank:") or p.objective in objectives.GROUPED) and c.group is None:
        raise ValueError("an objective of groups needs a group column")
    from .state import fold_margin, save_checkpoint

    keep = [x for x in dict.fromkeys([*c.features, c.label, c.row_id, c.weight, c.group, c.lower, c.upper]) if x and x in df.columns]
    data = df.select(*keep).persist()  # until the state with margins is there
    history = History(p.metric or metrics.default_for(p.objective))
    if p.booster == "gblinear":
        return _train_linear(data, p, c, eval_df, history, callbacks)
    y, w = F.col(c.lower or c.label).cast("double"), objectives.weight(c.weight)
    if resume is not None:
        model = resume
    else:
        base = float(data.agg(objectives.start(p.objective, y, w)).first()[0] or 0.0)
        bases = [-math.log(p.num_class)] * p.num_class if p.objective.startswith("multi:") else [base]
        model = Forest([], len(c.features), p.outputs, tree_class=[], tree_weight=[], iteration_begin=[], base=bases, transform=transforms.OF_OBJECTIVE.get(p.objective, "raw"), objective=p.objective, feature_names=list(c.features), average=p.parallel_trees > 1)
    first = model.n_iterations
    method = resolve_method(data, p)
    if method == "hist" and p.per_node_bins:
        method = "per-node"
    cuts = splits.cut_points(data, c.features, p.max_bin) if method == "hist" else {}
    # Bins once for all rounds.
    data = data.withColumn("_x", splits.bin_array(c.features, cuts, p.categorical) if method == "hist" else values_array(c.features))
    start = lambda: scoring.margins(model, c.features) if model.trees else F.array(*[F.lit(model.base_of(k)) for k in range(p.outputs)])
    source, state = data, data.withColumn("margin", start()).persist()
    watch = None if eval_df is None else eval_df.withColumn("margin", start()).persist()
    pending: list[int] = []
    rng = np.random.default_rng(p.seed)
    better = (lambda a, b: a > b) if metrics.larger_is_better(history.metric) else (lambda a, b: a < b)
    for r in range(first, first + p.rounds):
        eta = p.eta_schedule(r) if p.eta_schedule else p.eta
        whole = p.booster == "dart" or model.average
        current = state.withColumn("margin", scoring.margins(model, c.features)) if whole and model.trees else with_trees(state, model, pending, c)
        model.iteration_begin.append(len(model.trees))
        slots = [(k, slot, p.seed + 1000003 * r + 101 * k + slot) for k in range(p.outputs) for slot in range(p.parallel_trees)]
        plan = Round(method, p.outputs, [k for k, _, _ in slots], [sample_columns(len(c.features), p.colsample, seed) for _, _, seed in slots], [cuts[f] for f in c.features] if cuts else [])
        work = round_table(current, p, c, draws(state, p, c, [seed for _, _, seed in slots]), len(slots)).persist()
        new = [(k, t) for (k, _, _), t in zip(slots, grow_round(work, p, plan, len(c.features), eta))]
        work.unpersist()
        if r == first:
            source.unpersist()
        for k, t in new:
            pending.append(len(model.trees))
            model.trees.append(t)
            model.tree_class.append(k)
            model.tree_weight.append(1.0)
        if p.booster == "dart":
            _drop_trees(model, p, rng, len(new))
        # Where old trees keep their weight only the new ones are scored.
        scored = lambda at: at.withColumn("margin", scoring.margins(model, c.features)) if whole else with_trees(at, model, pending, c)
        if (r + 1 - first) % p.eval_every == 0 or r + 1 == first + p.rounds:
            history.rounds.append(r)
            history.train.append(evaluate_margin(scored(state), p, c, history.metric))
            if watch is not None:
                history.eval.append(evaluate_margin(scored(watch), p, c, history.metric))
            watched = history.eval or history.train
            if history.best_round < 0 or better(watched[-1], watched[history.rounds.index(history.best_round)]):
                history.best_round = r
        if not whole and len(pending) >= FOLD_ROUNDS * p.outputs * p.parallel_trees:
            old, state = state, fold_margin(with_trees(state, model, pending, c))
            old.unpersist()
            if watch is not None:
                old, watch = watch, fold_margin(with_trees(watch, model, pending, c))
                old.unpersist()
            pending = []
        if checkpoint_path:
            save_checkpoint(model, r, p.objective, checkpoint_path)
        if any([cb(r, model, history) for cb in callbacks]) or p.early_stopping and r - history.best_round >= p.early_stopping:
            break
    state.unpersist()
    if watch is not None:
        watch.unpersist()
    return model, history


def with_trees(state: DataFrame, model: Forest, trees: list[int], c: Columns) -> DataFrame:
    """The stored margin plus what ``trees`` add."""
    if not trees:
        return state
    add = Forest([model.trees[i] for i in trees], model.n_features, model.n_outputs, tree_class=[model.class_of(i) for i in trees])
    more = scoring.margins(add, c.features)
    return state.withColumn("margin", F.zip_with("margin", more, lambda a, b: a + b))


def _drop_trees(model: Forest, p: Params, rng, new: int) -> None:
    """Dropout after boosting: a dropped tree's weight becomes 0; ``forest`` shares it among the rest."""
    old = len(model.trees) - new
    dropped = [i for i in range(old) if rng.random() < p.drop_rate and model.tree_weight[i]]
    for i in dropped:
        model.tree_weight[i] = 0.0
    if dropped and p.dart_normalize == "forest":
        scale = len(model.trees) / (len(model.trees) - len(dropped))
        model.tree_weight = [w * scale for w in model.tree_weight]


def linear_sums(df: DataFrame, p: Params, c: Columns, output: int) -> DataFrame:
    """One pass: for each feature sum(g x) and sum(h x^2), and sum(g), sum(h) for the bias."""
    x = lambda f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0))
    at = gradients(df, p, c, output)
    sums = [F.sum("grad").alias("g"), F.sum("hess").alias("h")]
    for i, f in enumerate(c.features):
        sums += [F.sum(F.col("grad") * x(f)).alias(f"g{i}"), F.sum(F.col("hess") * x(f) * x(f)).alias(f"h{i}")]
    return at.agg(*sums)


def _train_linear(data: DataFrame, p: Params, c: Columns, eval_df, history: History, callbacks) -> tuple[Linear, History]:
    y, w = F.col(c.label).cast("double"), objectives.weight(c.weight)
    base = float(data.agg(objectives.start(p.objective, y, w)).first()[0] or 0.0)
    k = p.outputs
    bases = [-math.log(p.num_class)] * k if k > 1 else [base]
    model = Linear([[0.0] * k for _ in c.features], [0.0] * k, bases, transforms.OF_OBJECTIVE.get(p.objective, "raw"), p.objective, list(c.features))
    data = data.persist()
    for r in range(p.rounds):
        eta = p.eta_schedule(r) if p.eta_schedule else p.eta
        scored = data.withColumn("margin", scoring.margins(model, c.features))
        steps = [linear_sums(scored, p, c, o).first() for o in range(k)]
        for o, s in enumerate(steps):
            for i in range(len(c.features)):
                h = s[f"h{i}"] + p.lam
                if h > 0:
                    model.weights[i][o] -= eta * (s[f"g{i}"] + p.lam * model.weights[i][o]) / h
            if s["h"] > 0:
                model.bias[o] -= eta * s["g"] / s["h"]
        history.train.append(evaluate(data, model, p, c, history.metric))
        if eval_df is not None:
            history.eval.append(evaluate(eval_df, model, p, c, history.metric))
        if any([cb(r, model, history) for cb in callbacks]):
            break
    data.unpersist()
    return model, history


def cross_validate(df: DataFrame, p: Params, c: Columns, folds: int = 5, metric: str = "") -> dict:
    """Mean and population deviation of a metric over folds of as many groups (or rows) each; the last takes the rest."""
    key = c.group or c.row_id
    keys = df.select(key).distinct()
    at = df.withColumn("_fold", sampling.fold_of(keys, key, folds, p.seed, keys.count())).persist()
    values = []
    for k in range(folds):
        model, _ = train(at.where(F.col("_fold") != k), p, c)
        values.append(evaluate(at.where(F.col("_fold") == k), model, p, c, metric))
    at.unpersist()
    return {"values": values, "mean": float(np.mean(values)), "std": float(np.std(values))}


def describe(p: Params) -> str:
    return json.dumps({k: v for k, v in asdict(p).items() if k != "eta_schedule"}, default=str)


def train_file(spark, path: str, p: Params, format: str | None = None, resume: Forest | None = None, like: Forest | Linear | None = None, **options) -> tuple[Forest | Linear, History]:
    """Train on a table file of any format that the sources read.

    Without an objective in ``p`` it is that of the model to go on with, or of
    one ``like`` which a new model shall be.
    """
    from ..sources.models import objective_of
    from ..sources.tables import read_table

    df = read_table(spark, path, format, **options)
    group = "qid" if "qid" in df.columns else None
    features = [c for c in df.columns if c not in ("label", "qid", "weight")]
    if not p.objective:
        of = resume or like
        if of is None:
            raise ValueError("name an objective, or a model to take it from")
        p = replace(p, objective=objective_of(of), num_class=of.n_outputs)
    rows = stored(df.withColumn("row_id", F.monotonically_increasing_id()))  # numbers that stay
    return train(rows, p, Columns(features, group=group, weight="weight" if "weight" in df.columns else None), resume=resume)

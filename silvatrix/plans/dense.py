"""Dense histograms of all trees of a round, merged in a tree of partial sums.

What a level of growth works on is one table: ``_x``, a row's features as
numbers of bins (or as values), ``_g`` and ``_h``, its gradient and hessian for
each output, and ``_at``, its node in each tree of the round (-1: in none that
is open). A level is one job, whatever the number of classes and trees:

* a task fills one array (node, feature, bin) of sums from its Arrow batches and
  sends a row a node and block of features. What shuffles is nodes x features
  x bins a task, and not the data;
* partial sums are added in a tree, ``FAN`` of them at a time, so no task gets
  one from every other task;
* only the smaller child of a split is filled. The larger one is its parent's
  histogram, kept from the level before, less the smaller one's;
* the task that ends a node's sum also searches its best split, so one row a
  node and block comes back to the driver.

Nodes are found by looking up the splits of the levels since ``_at`` was stored,
by node number in sorted arrays: a plan does not grow with the tree. The column
is stored anew every ``KEEP_LEVELS`` levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (node, feature, bin) that a task fills at a time; a level with more takes several jobs.
CELLS = 2_000_000
#: Features of a block.
BLOCK = 16
#: Partial sums that are added at a time.
FAN = 64
KEEP_LEVELS = 4
#: Categorical codes from 0 that can be split off.
CODES = 32

_PARTIAL = "tree int, node long, block int, part int, g binary, h binary, n binary"
_FOUND = "tree int, node long, block int, g binary, h binary, n binary, feature int, pos int, gain double, gl double, hl double, nl long, gt double, ht double, nt long"


@dataclass(frozen=True)
class Search:
    """How splits are searched. ``ends``: for each feature its number of thresholds; ``allowed``: the features of each tree."""

    ends: tuple[int, ...]
    allowed: tuple[frozenset[int], ...]
    lam: float = 0.0
    gamma: float = 0.0
    categorical: frozenset[int] = frozenset()
    monotone: tuple[tuple[int, int], ...] = ()

    @property
    def bins(self) -> int:
        return max(self.ends, default=0) + 1


@dataclass(frozen=True)
class Level:
    """The splits of a level, for each tree: node numbers in order, feature, and a bound that goes left with all below it (or, for a categorical one, alone)."""

    nodes: tuple[np.ndarray, ...]
    feature: tuple[np.ndarray, ...]
    bound: tuple[np.ndarray, ...]
    equal: tuple[np.ndarray, ...]

    @staticmethod
    def of(splits: list[dict[int, tuple[int, float, bool]]]) -> Level:
        order = [sorted(s) for s in splits]
        col = lambda k, kind: tuple(np.array([s[n][k] for n in o], kind) for s, o in zip(splits, order))
        return Level(tuple(np.array(o, np.int64) for o in order), col(0, np.int64), col(1, float), col(2, bool))


def flat(column: pa.Array, width: int) -> np.ndarray:
    """A column of arrays of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def advance(x: np.ndarray, at: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Node numbers after the splits of ``levels``; -1 where a node was not split. Missing values go right."""
    at = at.copy()
    for level in levels:
        for t, nodes in enumerate(level.nodes):
            n = at[:, t]
            if not len(nodes):
                n[:] = -1
                continue
            k = np.minimum(np.searchsorted(nodes, n), len(nodes) - 1)
            value = x[np.arange(len(x)), level.feature[t][k]]
            left = np.where(level.equal[t][k], value == level.bound[t][k], value <= level.bound[t][k])
            n[:] = np.where(nodes[k] == n, 2 * n + np.where(left, 1, 2), -1)
    return at


def keep_nodes(work: DataFrame, levels: list[Level], features: int, trees: int) -> DataFrame:
    """``work`` with ``_at`` advanced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = advance(flat(b.column("_x"), features), flat(b.column("_at"), trees), levels)
            offsets = pa.array(np.arange(0, at.size + 1, trees, dtype=np.int32))
            yield b.set_column(b.schema.get_field_index("_at"), "_at", pa.ListArray.from_arrays(offsets, pa.array(at.ravel())))

    return work.mapInArrow(run, work.schema)


def _sums(g: np.ndarray, h: np.ndarray, n: np.ndarray, **ids) -> pa.RecordBatch:
    kinds = {"tree": pa.int32(), "node": pa.int64(), "block": pa.int32(), "part": pa.int32()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kinds[k]) for k, v in ids.items()} | {"g": [g.tobytes()], "h": [h.tobytes()], "n": [n.tobytes()]})


def partial_sums(work: DataFrame, nodes: list[tuple[int, int]], levels: list[Level], search: Search, outputs: int, tree_output: list[int]) -> DataFrame:
    """A row a task, node and block of features: the sums of ``nodes``, which are (tree, number)."""
    width, bins, trees = len(search.ends), search.bins, len(tree_output)
    mine = [np.array(sorted(n for t, n in nodes if t == k), np.int64) for k in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [len(m) * width * bins for m in mine]
        g, h, n = ([np.zeros(c, kind) for c in cells] for kind in (float, float, np.int64))
        for b in batches:
            x, grad, hess = flat(b.column("_x"), width), flat(b.column("_g"), outputs), flat(b.column("_h"), outputs)
            at = advance(x, flat(b.column("_at"), trees), levels)
            place = x.astype(np.int64) + np.arange(width) * bins
            for t, wanted in enumerate(mine):
                if not len(wanted):
                    continue
                slot = np.minimum(np.searchsorted(wanted, at[:, t]), len(wanted) - 1)
                rows = np.flatnonzero(wanted[slot] == at[:, t])
                if len(rows):
                    key = (place[rows] + (slot[rows] * width * bins)[:, None]).ravel()
                    of = lambda w: np.bincount(key, np.repeat(w[rows, tree_output[t]], width), cells[t])  # noqa: B023, E731
                    g[t] += of(grad)
                    h[t] += of(hess)
                    n[t] += np.bincount(key, minlength=cells[t])
        part = TaskContext.get().partitionId()
        for t, wanted in enumerate(mine):
            for k, node in enumerate(wanted.tolist()):
                one = [a[t].reshape(len(wanted), width, bins)[k] for a in (g, h, n)]
                if one[2][0].any():
                    for block in range(0, width, BLOCK):
                        yield _sums(*(a[block : block + BLOCK] for a in one), tree=t, node=node, block=block // BLOCK, part=part)

    return work.select("_x", "_g", "_h", "_at").mapInArrow(run, _PARTIAL)


def _added(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for name, kind in (("g", float), ("h", float), ("n", np.int64)):
        total = None
        for v in t.column(name):
            one = np.frombuffer(v.as_buffer(), kind)
            total = one.copy() if total is None else np.add(total, one, out=total)
        out.append(total)
    return tuple(out)


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """Partial sums of ``parts`` tasks, added until each key has ``FAN`` at most."""

    def add(t: pa.Table) -> pa.Table:
        ids = {k: t.column(k)[0].as_py() for k in ("tree", "node", "block", "part")}
        return pa.Table.from_batches([_sums(*_added(t), **ids)])

    while parts > FAN:
        partial = partial.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("tree", "node", "block", "part").applyInArrow(add, _PARTIAL)
        parts = -(-parts // FAN)
    return partial


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, first: int, tree: int, s: Search) -> tuple | None:
    """(feature, pos, gain, gl, hl, nl) of the best split of a node among the features from ``first``: gain, then feature, then position."""
    gt, ht, nt = g.sum(1), h.sum(1), n.sum(1)
    coded = np.array([first + i in s.categorical for i in range(len(g))])[:, None]
    gl, hl, nl = (np.where(coded, a, np.cumsum(a, axis=1)) for a in (g, h, n))
    ends = np.array([CODES if first + i in s.categorical else s.ends[first + i] for i in range(len(g))])
    allowed = np.array([first + i in s.allowed[tree] for i in range(len(g))])
    gr, hr = gt[:, None] - gl, ht[:, None] - hl
    ok = (np.arange(g.shape[1]) < ends[:, None]) & allowed[:, None] & (nl > 0) & (nl < nt[:, None]) & (hl > 0) & (hr > 0)
    with np.errstate(all="ignore"):
        gain = np.where(ok, 0.5 * (gl * gl / (hl + s.lam) + gr * gr / (hr + s.lam) - (gt * gt / (ht + s.lam))[:, None]), 0.0)
    pos = np.argmax(gain, axis=1)
    best, of_best = gain.max(axis=1), None
    for i in np.argsort(-best, kind="stable").tolist():
        if not best[i] > s.gamma:
            break
        p = pos[i]
        sign = dict(s.monotone).get(first + i, 0)
        left, right = -gl[i, p] / (hl[i, p] + s.lam), -gr[i, p] / (hr[i, p] + s.lam)
        if sign and (left > right if sign > 0 else left < right):
            continue  # a monotone direction rejects a feature by its best position
        of_best = (first + i, int(p), float(best[i]), float(gl[i, p]), float(hl[i, p]), int(nl[i, p]))
        break
    return of_best


def finished(sums: DataFrame, search: Search, before: DataFrame | None = None) -> DataFrame:
    """Histograms of whole nodes and their best splits, from merged sums.

    ``before`` holds the histograms of the level before: a node of ``sums`` is
    then one of two children, and the other one is found by subtraction.
    """
    width, bins = len(search.ends), search.bins

    def end(t: pa.Table) -> pa.Table:
        tree, block = t.column("tree")[0].as_py(), t.column("block")[0].as_py()
        own = t.column("node").to_numpy()
        is_parent = t.column("part").is_null().to_numpy(zero_copy_only=False)
        fresh = t.filter(pa.array(~is_parent))
        nodes = {}
        if fresh.num_rows:
            nodes[int(own[~is_parent][0])] = _added(fresh)
            if is_parent.any():
                number, part = next(iter(nodes.items()))
                rest = [a - b for a, b in zip(_added(t.filter(pa.array(is_parent))), part)]
                for a in rest[:2]:
                    a[rest[2] == 0] = 0.0
                nodes[4 * ((number - 1) // 2) + 3 - number] = tuple(rest)  # the sibling
        first = block * BLOCK
        rows = []
        for number, sums_ in nodes.items():
            shaped = [a.reshape(min(BLOCK, width - first), bins) for a in sums_]
            rows.append((tree, number, block, *(a.tobytes() for a in shaped), *(best_split(*shaped, first, tree, search) or (None,) * 6), *(a[0].sum().item() for a in shaped)))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    keyed = sums.withColumn("parent", F.col("node") if before is None else F.expr("(node - 1) div 2"))
    if before is not None:
        keyed = keyed.unionByName(before.select("tree", "node", "block", F.lit(None).cast("int").alias("part"), "g", "h", "n", F.col("node").alias("parent")))
    return keyed.groupBy("tree", "parent", "block").applyInArrow(end, _FOUND)


def tasks(df: DataFrame) -> int:
    """How many tasks will read ``df``."""
    return df.rdd.getNumPartitions()


def in_chunks(nodes: list[tuple[int, int]], search: Search) -> list[list[tuple[int, int]]]:
    """Nodes that are filled in one job each: by default all of a level."""
    at_once = max(1, CELLS // (len(search.ends) * search.bins))
    return [nodes[i : i + at_once] for i in range(0, len(nodes), at_once)]


def level_histograms(work: DataFrame, parts: int, nodes: list[tuple[int, int]], levels: list[Level], search: Search, outputs: int, tree_output: list[int], before: DataFrame | None) -> DataFrame:
    """The histograms and best splits of ``nodes`` and, with those of the level ``before``, of their siblings."""
    out = None
    for chunk in in_chunks(nodes, search):
        sums = merged(partial_sums(work, chunk, levels, search, outputs, tree_output), parts)
        mine = before
        if before is not None:
            keys = work.sparkSession.createDataFrame([(t, (n - 1) // 2) for t, n in chunk], "tree int, node long")
            mine = before.join(F.broadcast(keys), ["tree", "node"], "left_semi")  # a row a node of the chunk
        one = finished(sums, search, mine)
        out = one if out is None else out.unionByName(one)
    return out


# --- histograms as rows ------------------------------------------------------------------


def as_rows(found: DataFrame, search: Search) -> DataFrame:
    """(tree, node, feature, pos, g, h, n): the filled cells of histograms."""
    width, bins = len(search.ends), search.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first = r["block"] * BLOCK
                g, h, n = (np.frombuffer(r[k], kind).reshape(min(BLOCK, width - first), bins) for k, kind in (("g", float), ("h", float), ("n", np.int64)))
                f, p = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), r["tree"], np.int32)), pa.array(np.full(len(f), r["node"])), pa.array((f + first).astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(g[f, p]), pa.array(h[f, p]), pa.array(n[f, p])], ["tree", "node", "feature", "pos", "g", "h", "n"])

    return found.select("tree", "node", "block", "g", "h", "n").mapInArrow(run, "tree int, node long, feature int, pos int, g double, h double, n long")


# --- bins of each node's own ----------------------------------------------------------------


def node_cuts(work: DataFrame, parts: int, nodes: list[tuple[int, int]], levels: list[Level], width: int, trees: int, max_bin: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """For each node the thresholds of every feature, from the rows it has.

    Midpoints of distinct values if they are ``max_bin`` at most, else equal
    widths. A task sends up to ``max_bin`` values of a node and feature, or only
    the bounds where it has more.
    """
    mine = [np.array(sorted(n for t, n in nodes if t == k), np.int64) for k in range(trees)]

    def known(v: np.ndarray, crowded: bool) -> tuple[np.ndarray, bool]:
        v = np.unique(v)
        crowded = crowded or len(v) > max_bin
        return (v[[0, -1]] if crowded and len(v) else v), crowded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for b in batches:
            x = flat(b.column("_x"), width)
            at = advance(x, flat(b.column("_at"), trees), levels)
            for t, wanted in enumerate(mine):
                for node in np.intersect1d(at[:, t], wanted).tolist():
                    rows = x[at[:, t] == node]
                    for f in range(width):
                        v, crowded = held.get((t, node, f), (rows[:0, f], False))
                        held[t, node, f] = known(np.r_[v, rows[~np.isnan(rows[:, f]), f]], crowded)
        part = TaskContext.get().partitionId()
        for (t, node, f), (v, crowded) in held.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": [node], "feature": pa.array([f], pa.int32()), "part": pa.array([part], pa.int32()), "v": [v.tobytes()], "crowded": [crowded]})

    def join(t: pa.Table) -> pa.Table:
        v, crowded = known(np.concatenate([np.frombuffer(x.as_buffer(), float) for x in t.column("v")]), any(t.column("crowded").to_pylist()))
        return t.slice(0, 1).select(["tree", "node", "feature", "part"]).append_column("v", pa.array([v.tobytes()])).append_column("crowded", pa.array([crowded]))

    schema = "tree int, node long, feature int, part int, v binary, crowded boolean"
    found = work.select("_x", "_at").mapInArrow(run, schema)
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("tree", "node", "feature", "part").applyInArrow(join, schema)
        if parts <= FAN:
            break
        parts = -(-parts // FAN)
    out = {n: [np.zeros(0)] * width for n in nodes}
    for r in found.collect():  # max_bin values a node and feature; the nodes of a chunk
        v = np.frombuffer(r["v"], float)
        if len(v) < 2 or v[0] == v[-1]:
            continue
        cuts = v[0] + (v[-1] - v[0]) * np.arange(1, max_bin) / max_bin if r["crowded"] else (v[1:] + v[:-1]) / 2
        out[r["tree"], r["node"]][r["feature"]] = cuts
    return out


def binned_by_node(work: DataFrame, cuts: dict[tuple[int, int], list[np.ndarray]], levels: list[Level], width: int, trees: int) -> DataFrame:
    """``work`` with ``_x`` as bins of the row's node, one tree a row, and ``_at`` advanced."""
    sent = work.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = flat(b.column("_x"), width)
            at = advance(x, flat(b.column("_at"), trees), levels)
            for t in range(trees):
                bins = np.zeros(x.shape)
                for node in np.unique(at[:, t]).tolist():
                    if (t, node) in sent.value:
                        rows = np.flatnonzero(at[:, t] == node)
                        for f, ends in enumerate(sent.value[t, node]):
                            bins[rows, f] = np.searchsorted(ends, x[rows, f])
                rows = pa.array(np.flatnonzero(np.isin(at[:, t], [n for k, n in sent.value if k == t])))
                only = np.full(at.shape, -1)
                only[:, t] = at[:, t]
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([lists(bins), b.column("_g"), b.column("_h"), lists(only)], ["_x", "_g", "_h", "_at"]).take(rows)

    return work.select("_x", "_g", "_h", "_at").mapInArrow(run, "_x array<double>, _g array<double>, _h array<double>, _at array<long>")

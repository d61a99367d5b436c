"""Model files to models: LightGBM text and JSON, XGBoost JSON, UBJSON and legacy binary, scikit-learn pickles, our own JSON.

Models are small and parsed on the driver. XGBoost thresholds and tips are
32-bit floats and are widened as such. Pickles are read by an unpickler that
knows a short list of classes and runs nothing else.
"""

from __future__ import annotations

import io
import json
import math
import pickle
import struct

import numpy as np

from ..functions import objectives
from ..functions.storage import read_file, write_file
from ..functions.transforms import OF_OBJECTIVE
from ..plans.model import Forest, Linear, Tree


class FormatError(ValueError):
    """The file is no model, or one that can't be read."""


def _f32(x) -> float:
    return float(np.float32(x))


# --- LightGBM ----------------------------------------------------------------------


def _lgb_missing(kind: int) -> tuple[bool, bool]:
    """(zero is missing, NaN is missing) of the decision type's missing bits."""
    if kind not in (0, 1, 2):
        raise FormatError(f"unknown missing type {kind}")
    return kind == 1, kind == 2


def _bits(words: list[int]) -> frozenset[int]:
    return frozenset(32 * i + b for i, w in enumerate(words) for b in range(32) if w >> b & 1)


def _lgb_tree(block: dict[str, str]) -> Tree:
    ints = lambda k: [int(x) for x in block.get(k, "").split()]
    floats = lambda k: [float(x) for x in block.get(k, "").split()]
    t = Tree()
    t.leaf_value = [[v] for v in floats("leaf_value")]
    t.leaf_cover = floats("leaf_count") or [0.0] * t.tips
    if len(t.leaf_cover) != t.tips:
        raise FormatError("leaf_value and leaf_count differ")
    if t.tips == 1:
        return t
    feature, threshold, kinds = ints("split_feature"), floats("threshold"), ints("decision_type")
    if len(feature) != t.tips - 1:
        raise FormatError("as many leaf values as splits and one are needed")
    left, right, gain, cover = ints("left_child"), ints("right_child"), floats("split_gain"), floats("internal_count")
    bounds, words = ints("cat_boundaries"), ints("cat_threshold")
    for i, kind in enumerate(kinds):
        zero, nan = _lgb_missing(kind >> 2 & 3)
        cats = None
        if kind & 1:
            k = int(threshold[i])
            cats = _bits(words[bounds[k] : bounds[k + 1]])
        t.add(feature[i], threshold[i], left[i], right[i], bool(kind & 2), zero, nan, cats, gain[i] if gain else 0.0, cover[i] if cover else 0.0)
    return t


def lightgbm_text(text: str) -> Forest:
    blocks, now = [], {}
    flags = set()
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("Tree=") or line in ("end of trees", "parameters:") or line.startswith("feature importances") or line.startswith("feature_importances"):
            blocks.append(now)
            now = {}
            if not line.startswith("Tree="):
                break
        elif "=" in line:
            k, _, v = line.partition("=")
            now[k] = v
        elif line:
            flags.add(line)
    if now:
        blocks.append(now)
    head, trees = blocks[0], [b for b in blocks[1:] if "leaf_value" in b]
    if "tree" not in flags:
        raise FormatError("no LightGBM text model")
    if head.get("version") not in ("v2", "v3", "v4"):
        raise FormatError(f"unknown version {head.get('version')}")
    per = int(head.get("num_tree_per_iteration", 1))
    return _lgb_forest([_lgb_tree(b) for b in trees], per, int(head["max_feature_idx"]) + 1, head.get("objective", ""), head.get("feature_names", "").split(), "average_output" in flags)


def _lgb_forest(trees, per, n_features, objective, names, average) -> Forest:
    kind = objective.split(" ")[0]
    return Forest(trees, n_features, per, transform=OF_OBJECTIVE.get(kind, "raw"), objective=objective, feature_names=names, average=average, name="lightgbm")


def lightgbm_json(d: dict) -> Forest:
    if d.get("name") != "tree" or str(d.get("version")) not in ("v2", "v3", "v4"):
        raise FormatError("no LightGBM JSON model")
    missing = {"None": (False, False), "Zero": (True, False), "NaN": (False, True)}
    trees = []
    for info in d["tree_info"]:
        t = Tree()

        def build(node) -> int:
            if "split_feature" not in node:
                t.leaf_value.append([float(node["leaf_value"])])
                t.leaf_cover.append(float(node.get("leaf_count", 0)))
                return ~(t.tips - 1)
            if node["missing_type"] not in missing:
                raise FormatError(f"unknown missing type {node['missing_type']}")
            zero, nan = missing[node["missing_type"]]
            if node["decision_type"] == "==":
                cats, at = frozenset(int(x) for x in str(node["threshold"]).split("||")), 0.0
            elif node["decision_type"] == "<=":
                cats, at = None, float(node["threshold"])
            else:
                raise FormatError(f"unknown decision type {node['decision_type']}")
            n = t.add(int(node["split_feature"]), at, 0, 0, bool(node["default_left"]), zero, nan, cats, float(node.get("split_gain", 0)), float(node.get("internal_count", 0)))
            t.left[n] = build(node["left_child"])
            t.right[n] = build(node["right_child"])
            return n

        build(info["tree_structure"])
        trees.append(t)
    return _lgb_forest(trees, int(d.get("num_tree_per_iteration", 1)), int(d["max_feature_idx"]) + 1, d.get("objective", ""), list(d.get("feature_names", [])), bool(d.get("average_output", False)))


# --- XGBoost --------------------------------------------------------------------------


def _numbers(text) -> list[float]:
    if isinstance(text, (int, float)):
        return [float(text)]
    if isinstance(text, list):
        return [float(x) for x in text]
    return [float(x) for x in str(text).strip().strip("[]").split(",") if x.strip()]


def _to_margin(objective: str, base: float) -> float:
    if objective in ("binary:logistic", "reg:logistic"):
        return math.log(base / (1 - base)) if 0 < base < 1 else base
    if objective in ("reg:gamma", "count:poisson", "reg:tweedie"):
        return math.log(base) if base > 0 else base
    return base


def _from_margin(objective: str, margin: float) -> float:
    if objective in ("binary:logistic", "reg:logistic"):
        return 1 / (1 + math.exp(-margin))
    if objective in ("reg:gamma", "count:poisson", "reg:tweedie"):
        return math.exp(margin)
    return margin


def _xgb_tree(d: dict, strict: bool, match_goes_left: bool) -> Tree:
    left, right, feature = d["left_children"], d["right_children"], d["split_indices"]
    value, default = d["split_conditions"], d["default_left"]
    gain, hess = d.get("loss_changes") or [0.0] * len(left), d.get("sum_hessian") or [0.0] * len(left)
    kinds = d.get("split_type") or [0] * len(left)
    dim = int(d.get("tree_param", {}).get("size_leaf_vector", 1) or 1)
    vectors = d.get("leaf_weights") or []
    cats = {}
    for node, begin, size in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", [])):
        cats[node] = frozenset(d["categories"][begin : begin + size])
    t = Tree(strict=strict)
    inner = [i for i in range(len(left)) if left[i] != -1 and d.get("parents", [0] * len(left))[i] != -2]
    number = {i: k for k, i in enumerate(inner)}
    tips: dict[int, int] = {}

    def leaf(i: int) -> int:
        if i not in tips:
            if dim > 1:
                k = right[i]  # which vector is its own
                t.leaf_value.append([_f32(x) for x in vectors[k * dim : (k + 1) * dim]])
            else:
                t.leaf_value.append([_f32(value[i])])
            t.leaf_cover.append(float(hess[i]))
            tips[i] = t.tips - 1
        return ~tips[i]

    reach, todo = [], [0]
    while todo:
        i = todo.pop()
        reach.append(i)
        if left[i] != -1:
            todo += [right[i], left[i]]
    for i in reach:
        if left[i] == -1:
            leaf(i)
    for i in inner:
        child = lambda c: number[c] if left[c] != -1 else leaf(c)
        a, b, go = child(left[i]), child(right[i]), bool(default[i])
        if kinds[i] and not match_goes_left:  # a category of the set goes right
            a, b, go = b, a, not go
        t.add(int(feature[i]), 0.0 if kinds[i] else _f32(value[i]), a, b, go, False, True, cats.get(i, frozenset()) if kinds[i] else None, float(gain[i]), float(hess[i]))
    return t


def xgboost_dict(d: dict, strict: bool = False, match_goes_left: bool = False) -> Forest | Linear:
    """A model from XGBoost's JSON or UBJSON document.

    ``strict`` splits by <, as XGBoost itself does, instead of <=. By XGBoost's
    convention the categories listed for a split go right.
    """
    learner = d["learner"]
    param, objective = learner["learner_model_param"], learner["objective"]["name"]
    names = list(learner.get("feature_names") or [])
    classes, targets = int(param.get("num_class", 0) or 0), int(param.get("num_target", 1) or 1)
    outputs = max(classes, targets, 1)
    base = [_to_margin(objective, _f32(x)) for x in _numbers(param.get("base_score", 0.5))]
    booster = learner["gradient_booster"]
    transform = OF_OBJECTIVE.get(objective, "raw")
    if booster["name"] == "gblinear":
        n = int(param["num_feature"])
        w = [_f32(x) for x in booster["model"]["weights"]]
        return Linear([w[i * outputs : (i + 1) * outputs] for i in range(n)], w[n * outputs : (n + 1) * outputs], base, transform, objective, names, "xgboost linear")
    drops = booster.get("weight_drop")
    model = booster["gbtree"]["model"] if "gbtree" in booster else booster["model"]
    trees = [_xgb_tree(t, strict, match_goes_left) for t in model["trees"]]
    return Forest(
        trees, int(param["num_feature"]), outputs, tree_class=[int(x) for x in model.get("tree_info") or [i % outputs for i in range(len(trees))]], tree_weight=[_f32(x) for x in drops] if drops else None,
        iteration_begin=[int(x) for x in model["iteration_indptr"][:-1]] if model.get("iteration_indptr") else None, base=base, transform=transform, objective=objective, feature_names=names, name="xgboost",
    )


def decode_ubjson(data: bytes):
    """The value of a UBJSON document."""
    at = 0
    fixed = {b"i": ">b", b"U": ">B", b"I": ">h", b"u": ">H", b"l": ">i", b"m": ">I", b"L": ">q", b"M": ">Q", b"d": ">f", b"D": ">d"}

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise FormatError("the document ends early")
        at += n
        return data[at - n : at]

    def integer() -> int:
        return value(take(1))

    def value(mark: bytes):
        nonlocal at
        if mark in fixed:
            return struct.unpack(fixed[mark], take(struct.calcsize(fixed[mark])))[0]
        if mark in (b"S", b"H"):
            return take(integer()).decode()
        if mark == b"C":
            return take(1).decode()
        if mark in (b"T", b"F", b"Z", b"N"):
            return {b"T": True, b"F": False}.get(mark)
        if mark not in (b"[", b"{"):
            raise FormatError(f"unknown mark {mark!r}")
        kind = count = None
        if data[at : at + 1] == b"$":
            take(1)
            kind = take(1)
        if data[at : at + 1] == b"#":
            take(1)
            count = integer()
        close = b"]" if mark == b"[" else b"}"
        if mark == b"[" and kind in fixed and count is not None:
            f = fixed[kind]
            return np.frombuffer(take(struct.calcsize(f) * count), np.dtype(f)).tolist()
        out = [] if mark == b"[" else {}
        k = 0
        while count is None or k < count:
            if count is None and data[at : at + 1] == close:
                take(1)
                break
            if mark == b"[":
                out.append(value(kind or take(1)))
            else:
                key = take(integer()).decode()
                out[key] = value(kind or take(1))
            k += 1
        return out

    return value(take(1))


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def unpack(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise FormatError("the file ends early")
        self.at += size
        return struct.unpack_from("<" + form, self.data, self.at - size)

    def string(self) -> str:
        (n,) = self.unpack("Q")
        if n > 1 << 16:
            raise FormatError("no legacy binary model")
        return self.unpack(f"{n}s")[0].decode()


def xgboost_binary(data: bytes, strict: bool = False) -> Forest | Linear:
    """The legacy binary form: parameter structs, then trees as node and statistics tables."""
    r = _Reader(data[4:] if data[:4] == b"binf" else data)
    base, n_features, classes, extra, _ = r.unpack("fIiii")
    r.unpack("29i")
    objective, booster = r.string(), r.string()
    outputs = max(1, classes)
    transform = OF_OBJECTIVE.get(objective, "raw")
    if booster == "gblinear":
        n, k = r.unpack("Ii")
        r.unpack("32i")
        (size,) = r.unpack("Q")
        w = [float(x) for x in r.unpack(f"{size}f")]
        return Linear([w[i * k : (i + 1) * k] for i in range(n)], w[n * k : (n + 1) * k], [_to_margin(objective, base)], transform, objective, name="xgboost linear")
    if booster not in ("gbtree", "dart"):
        raise FormatError(f"unknown booster {booster}")
    n_trees, _, _, _, _, k, _ = r.unpack("iiiiqii")
    r.unpack("32i")
    trees = []
    for _ in range(n_trees):
        _, n_nodes, *_ = r.unpack("6i")
        r.unpack("31i")
        nodes = [r.unpack("iiiIf") for _ in range(n_nodes)]
        stats = [r.unpack("fffi") for _ in range(n_nodes)]
        doc = {
            "left_children": [x[1] for x in nodes], "right_children": [x[2] for x in nodes], "split_indices": [x[3] & 0x7FFFFFFF for x in nodes], "default_left": [x[3] >> 31 for x in nodes],
            "split_conditions": [x[4] for x in nodes], "loss_changes": [s[0] for s in stats], "sum_hessian": [s[1] for s in stats],
        }
        trees.append(_xgb_tree(doc, strict, False))
    info = list(r.unpack(f"{n_trees}i"))
    drops = None
    if booster == "dart":
        (size,) = r.unpack("Q")
        drops = [float(x) for x in r.unpack(f"{size}f")]
    return Forest(trees, n_features, max(outputs, k), tree_class=info, tree_weight=drops, base=[float(base)], transform=transform, objective=objective, name="xgboost")


def to_xgboost(m: Forest) -> dict:
    """A document in XGBoost's JSON form; the base score goes back through the link."""
    trees = []
    dim = max((len(v) for t in m.trees for v in t.leaf_value), default=1)
    for k, t in enumerate(m.trees):
        n = t.nodes + t.tips
        doc: dict = {"id": k, "categories": [], "categories_nodes": [], "categories_segments": [], "categories_sizes": []}
        cols = {c: [0] * n for c in ("left_children", "right_children", "split_indices", "default_left", "split_type")} | {"split_conditions": [0.0] * n, "loss_changes": [0.0] * n, "sum_hessian": [0.0] * n, "base_weights": [0.0] * n, "parents": [2147483647] * n}
        ident = lambda c, t=t: c if c >= 0 else t.nodes + ~c
        vectors: list[float] = []
        for j in range(t.nodes):
            a, b, go = ident(t.left[j]), ident(t.right[j]), t.default_left[j]
            if t.categories[j] is not None:
                a, b, go = b, a, not go
                doc["categories_nodes"].append(j)
                doc["categories_segments"].append(len(doc["categories"]))
                doc["categories_sizes"].append(len(t.categories[j]))
                doc["categories"] += sorted(t.categories[j])
                cols["split_type"][j] = 1
            for c, v in (("left_children", a), ("right_children", b), ("split_indices", t.feature[j]), ("default_left", int(go)), ("split_conditions", t.threshold[j]), ("loss_changes", t.gain[j]), ("sum_hessian", t.cover[j])):
                cols[c][j] = v
            cols["parents"][a] = cols["parents"][b] = j
        for j, v in enumerate(t.leaf_value):
            i = t.nodes + j
            cols["left_children"][i] = cols["right_children"][i] = -1
            cols["sum_hessian"][i] = t.leaf_cover[j] if t.leaf_cover else 0.0
            if dim > 1:
                cols["right_children"][i] = j
                vectors += v
            else:
                cols["split_conditions"][i] = v[0]
        doc |= cols | {"tree_param": {"num_deleted": "0", "num_feature": str(m.n_features), "num_nodes": str(n), "size_leaf_vector": str(dim)}}
        if dim > 1:
            doc["leaf_weights"] = vectors
        trees.append(doc)
    starts = m.iteration_begin or [i for i, (a, b) in enumerate(zip([-1, *m.iteration_of()], m.iteration_of())) if a != b]
    model = {"gbtree_model_param": {"num_trees": str(len(trees)), "num_parallel_tree": "1"}, "trees": trees, "tree_info": [m.class_of(i) for i in range(len(trees))], "iteration_indptr": [*starts, len(trees)]}
    booster = {"name": "dart", "gbtree": {"name": "gbtree", "model": model}, "weight_drop": m.tree_weight} if m.tree_weight and any(w != 1 for w in m.tree_weight) else {"name": "gbtree", "model": model}
    objective = m.objective or "reg:squarederror"
    base = [_from_margin(objective, m.base_of(k)) for k in range(m.n_outputs if len(m.base) > 1 else 1)]
    param = {"base_score": "[" + ",".join(repr(b) for b in base) + "]", "num_class": str(m.n_outputs if m.n_outputs > 1 and dim == 1 else 0), "num_feature": str(m.n_features), "num_target": str(m.n_outputs if dim > 1 else 1)}
    return {"version": [3, 0, 0], "learner": {"attributes": {}, "feature_names": m.feature_names, "feature_types": [], "gradient_booster": booster, "learner_model_param": param, "objective": {"name": objective}}}


# --- our own and its kin -----------------------------------------------------------------


def to_native(m: Forest | Linear) -> dict:
    if isinstance(m, Linear):
        return {"format": "silvatrix", "version": 1, "linear": m.__dict__}
    trees = [t.__dict__ | {"categories": [None if c is None else sorted(c) for c in t.categories]} for t in m.trees]
    return {"format": "silvatrix", "version": 1, "forest": m.__dict__ | {"trees": trees}}


def from_native(d: dict) -> Forest | Linear:
    if "linear" in d:
        return Linear(**d["linear"])
    f = dict(d["forest"])
    f["trees"] = [Tree(**(t | {"categories": [None if c is None else frozenset(c) for c in t["categories"]]})) for t in f["trees"]]
    return Forest(**f)


def from_versioned(d: dict) -> Forest | Linear:
    """The versioned JSON of other tools: {"<name>_version": 1, objective, model: {forest | linear}}."""
    objective, m = d.get("objective", ""), d["model"]
    transform = OF_OBJECTIVE.get(objective, "raw")
    if m.get("linear"):
        x = m["linear"]
        n, k, w = x["num_features"], x["num_output_groups"], x["weights"]
        return Linear([w[i * k : (i + 1) * k] for i in range(n)], w[n * k : (n + 1) * k], [x["base_score"]], transform, objective)
    x = m["forest"]
    trees = []
    for s in x["trees"]:
        t = Tree()
        dim = s.get("output_dim") or 1
        t.leaf_value = [s["leaf_value"][i : i + dim] for i in range(0, len(s["leaf_value"]), dim)]
        gain, hess = s.get("split_gain") or [0.0] * s["num_nodes"], s.get("sum_hess") or [0.0] * s["num_nodes"]
        for j in range(s["num_nodes"]):
            t.add(s["split_feature"][j], s["split_threshold"][j], s["left_child"][j], s["right_child"][j], s["default_left"][j], s["missing_zero"][j], s["missing_nan"][j], None, gain[j], hess[j])
        trees.append(t)
    begin = x.get("iteration_indptr")
    return Forest(trees, x["num_features"], x["num_output_groups"] or 1, x.get("tree_info"), x.get("weight_drop"), begin[:-1] if begin else None, x.get("base_scores") or [x["base_score"]], x.get("average_output", False), transform, objective)


# --- scikit-learn ---------------------------------------------------------------------------


class _Stub:
    """Stands in for a class of scikit-learn: keeps constructor arguments and state."""

    def __init__(self, *args):
        self.args = args

    def __setstate__(self, state):
        self.state = state


class _Unpickler(pickle.Unpickler):
    """Only array and tree classes; anything else is an error."""

    def find_class(self, module: str, name: str):
        if module in ("numpy", "numpy.core.multiarray", "numpy._core.multiarray") and name in ("ndarray", "dtype", "_reconstruct", "scalar"):
            return {"ndarray": np.ndarray, "dtype": np.dtype}.get(name) or getattr(np._core.multiarray, name)
        if (module, name) == ("_codecs", "encode"):  # how protocol 2 spells bytes
            return lambda text, _="latin1": text.encode("latin1")
        if (module, name) in (("copy_reg", "_reconstructor"), ("copyreg", "_reconstructor")):
            return lambda cls, *_: cls()
        if (module, name) in (("__builtin__", "object"), ("builtins", "object")):
            return object
        if module.split(".")[0] in ("sklearn", "numpy") and (module.startswith("sklearn.") or module.startswith("numpy.random")):
            return type(name, (_Stub,), {})
        raise FormatError(f"{module}.{name} is not read from pickles")


def sklearn_pickle(data: bytes) -> Forest:
    """A gradient boosting classifier; its prior goes into the trees' sum as a base."""
    s = _Unpickler(io.BytesIO(data), encoding="latin1").load().state
    estimators, rate = s["estimators_"], float(s["learning_rate"])
    outputs = estimators.shape[1]
    prior = s["init_"].state
    if "priors" in prior:
        base = [math.log(p) for p in np.ravel(prior["priors"])]
    elif "prior" in prior:
        base = [float(x) for x in np.ravel(prior["prior"])]
    else:
        p = np.ravel(prior["class_prior_"])
        base = [math.log(p[1] / p[0])] if outputs == 1 else [math.log(x) for x in p]
    trees, n_features = [], 0
    for stage in estimators:
        for e in stage:
            t0 = e.state["tree_"]
            n_features = int(t0.args[0]) if t0.args else int(s["n_features_"])
            nodes, values = t0.state["nodes"], t0.state["values"]
            t = Tree()
            inner = [i for i in range(len(nodes)) if nodes["left_child"][i] != -1]
            number = {i: k for k, i in enumerate(inner)}
            leaf = {}
            for i in range(len(nodes)):
                if i not in number:
                    leaf[i] = t.tips
                    t.leaf_value.append([float(np.ravel(values[i])[0]) * rate])
                    t.leaf_cover.append(float(nodes["n_node_samples"][i]))
            at = lambda c: number[c] if c in number else ~leaf[c]
            for i in inner:
                t.add(int(nodes["feature"][i]), float(nodes["threshold"][i]), at(nodes["left_child"][i]), at(nodes["right_child"][i]), False, False, False, None, 0.0, float(nodes["n_node_samples"][i]))
            trees.append(t)
    return Forest(trees, n_features, outputs, base=base, transform="logistic" if outputs == 1 else "softmax", objective="sklearn", name="sklearn")


# --- façade ------------------------------------------------------------------------------------

#: Format to reader of bytes. Add to it to read more.
LOADERS = {
    "lightgbm_text": lambda b: lightgbm_text(b.decode()),
    "lightgbm_json": lambda b: lightgbm_json(json.loads(b)),
    "xgboost_json": lambda b: xgboost_dict(json.loads(b)),
    "xgboost_ubjson": lambda b: xgboost_dict(decode_ubjson(b)),
    "xgboost_binary": xgboost_binary,
    "sklearn_pickle": sklearn_pickle,
    "native": lambda b: from_native(json.loads(b)),
    "versioned_json": lambda b: from_versioned(json.loads(b)),
}


def detect(path: str, data: bytes) -> str:
    """Format of a model file, by extension and then by content."""
    if path.endswith(".onnx"):
        raise FormatError("ONNX models are not read")
    head = data[:1]
    if path.endswith(".ubj"):
        return "xgboost_ubjson"
    if head == b"{" and data[1:2] in (b"\n", b" ", b'"', b"\r", b"\t", b"}"):
        try:
            d = json.loads(data)
        except ValueError as e:
            raise FormatError(f"no JSON: {e}") from None
        if d.get("format") == "silvatrix":
            return "native"
        if "learner" in d:
            return "xgboost_json"
        if "tree_info" in d:
            return "lightgbm_json"
        if "model" in d and any(k.endswith("_version") for k in d):
            return "versioned_json"
        raise FormatError("no model that is known")
    if head == b"{":
        return "xgboost_ubjson"
    if data[:4] == b"binf":
        return "xgboost_binary"
    if data.lstrip()[:4] == b"tree":
        return "lightgbm_text"
    if head == b"\x80" or data[:20].startswith((b"ccopy_reg", b"ccopyreg", b"csklearn")):
        return "sklearn_pickle"
    first = data.split(b"\n", 1)[0].replace(b",", b" ").split()
    try:
        [float(x) for x in first]
        if first:
            raise FormatError("a table of numbers, no model")
    except ValueError as e:
        if isinstance(e, FormatError):
            raise
    return "xgboost_binary"


def load(path: str, format: str | None = None, transform: str | None = None, auto: bool = True, spark=None) -> Forest | Linear:
    """A model file of any store that Spark reads.

    ``transform`` sets what its values are; without one ``auto`` takes that of
    the objective, and margins stay raw otherwise.
    """
    data = read_file(path, spark)
    m = LOADERS[format or detect(path, data)](data)
    if transform or not auto:
        m.transform = transform or "raw"
    return m


def save(m: Forest | Linear, path: str, format: str = "native", spark=None) -> None:
    write_file(path, json.dumps(to_native(m) if format == "native" else to_xgboost(m)).encode(), spark)


def objective_of(m: Forest | Linear) -> str:
    """The training objective that continues a model, from what its file says or from its transform."""
    kind = m.objective.split(" ")[0]
    if kind in OBJECTIVE_NAMES:
        return OBJECTIVE_NAMES[kind]
    if kind in objectives.NAMES or kind in objectives.POINTWISE:
        return kind
    return {"logistic": "binary:logistic", "softmax": "multi:softprob", "exponential": "count:poisson"}.get(m.transform, "reg:squarederror")


#: Objectives of other tools, by the names that their files give them.
OBJECTIVE_NAMES = {
    "regression": "reg:squarederror", "binary": "binary:logistic", "multiclass": "multi:softprob", "poisson": "count:poisson", "gamma": "reg:gamma",
    "tweedie": "reg:tweedie", "lambdarank": "rank:ndcg", "sklearn": "binary:logistic", "reg:linear": "reg:squarederror", "reg:logistic": "binary:logistic",
}

"""The registered queries of the engine and the SQL that they are held against.

Inputs are built from the star-schema tables: features of an order from its
line items (sums of whole numbers, so no result hangs on the order of
additions), ranking groups and survival times from events, interactions from
customers and parts. Doubles that add up in any order are rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, objectives, transforms
from .functions.storage import stored
from .operators import explain, quantize, recsys, scoring
from .plans import boosting, dense, splits
from .plans.model import Forest, Linear, three_class_forest, tiny_forest, wide_forest

FEATURES = ["lines", "quantity", "discount", "tax"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# --- inputs --------------------------------------------------------------------


def order_features(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    per = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum(F.round("l_quantity").cast("long")).cast("double").alias("quantity"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("discount"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double").alias("tax"),
    )
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    at = o.join(per, o.o_orderkey == per.l_orderkey)
    return at.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("qid"),
        F.when(F.col("o_orderkey") % 11 == 0, float("nan")).otherwise(F.col("lines")).alias("lines"),
        F.when(F.col("o_orderkey") % 13 == 0, None).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("discount")).alias("discount"),
        "tax",
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"),
        F.round(F.col("o_totalprice") / 1000).cast("double").alias("price"),
    )


OF = """of_ AS (
  SELECT o_orderkey AS row_id, o_custkey AS qid,
         CASE WHEN o_orderkey % 11 = 0 THEN 'NaN'::DOUBLE ELSE lines END AS lines,
         CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE quantity END AS quantity,
         CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE discount END AS discount, tax,
         CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE AS label, round(o_totalprice / 1000)::DOUBLE AS price
  FROM orders JOIN (
    SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(round(l_quantity)::BIGINT)::DOUBLE AS quantity,
           sum(round(l_discount * 100)::BIGINT)::DOUBLE AS discount, sum(round(l_tax * 100)::BIGINT)::DOUBLE AS tax
    FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    """Labels with a prediction that depends on the key alone; ties are common."""
    at = order_features(spark, d)
    return at.withColumns({"p": (F.col("row_id") % 97) / 100.0 + 0.01, "score": (F.col("row_id") % 41).cast("double")})


SO = OF + ",\nso AS (SELECT *, (row_id % 97) / 100.0::DOUBLE + 0.01 AS p, (row_id % 41)::DOUBLE AS score FROM of_)"


def event_groups(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("qid"),
        F.least(F.floor(F.col("value") / 60), F.lit(4)).cast("double").alias("label"),
        (F.col("event_id") * 7919 % 211 / 100.0).cast("double").alias("margin"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 500 + 1).otherwise(-(F.col("event_id") % 500 + 1)).cast("double").alias("time"),
        (F.col("event_id") * 31 % 200 / 100.0 - 1).cast("double").alias("risk"),
    )


EG = """eg AS (
  SELECT event_id AS row_id, user_id AS qid, least(floor(value / 60), 4)::DOUBLE AS label,
         (event_id * 7919 % 211) / 100.0::DOUBLE AS margin,
         (CASE WHEN event_type = 'purchase' THEN event_id % 500 + 1 ELSE -(event_id % 500 + 1) END)::DOUBLE AS time,
         (event_id * 31 % 200) / 100.0::DOUBLE - 1 AS risk
  FROM events)"""


def class_margins(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("label"), F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x.cast("double") * 10, 3)).alias("margin"))


CM = """cm AS (SELECT vec_id AS row_id, label::DOUBLE AS label, [round(x::DOUBLE * 10, 3) for x in embedding[1:10]] AS margin FROM embeddings),
e_ AS (SELECT *, [exp(x - list_max(margin)) for x in margin] AS ex FROM cm),
sm AS (SELECT row_id, label, margin, [x / list_sum(ex) for x in ex] AS probs FROM e_)"""


def interactions(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    p = _t(spark, d, "part").select("p_partkey", "p_brand")
    return li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select(F.col("o_custkey").alias("User"), F.col("l_partkey").alias("Item"), F.col("l_quantity").alias("Score"), F.col("p_brand").alias("Tag"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    items = _t(spark, d, "part").select(F.col("p_partkey").alias("Item"), F.col("p_brand").alias("Tag"))
    return recsys.catalog_features(interactions(spark, d), items).withColumns({"feat_pop": _r("feat_pop", 9), "feat_quality": _r("feat_quality", 9)})


IN = """ia AS (
  SELECT o_custkey AS "User", l_partkey AS "Item", l_quantity AS "Score", p_brand AS "Tag"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
dd AS (SELECT "User", "Item", max("Score") AS "Score", min("Tag") AS "Tag" FROM ia GROUP BY "User", "Item"),
ca AS (
  SELECT p_partkey AS "Item", p_brand AS "Tag", round(ln(1 + coalesce(n, 0)), 9) AS feat_pop, round(coalesce(m, 0), 9) AS feat_quality
  FROM part LEFT JOIN (SELECT "Item", count(*) AS n, avg("Score") AS m FROM ia GROUP BY 1) ON p_partkey = "Item")"""

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            S[f.__name__] = sql
        return f

    return add


# --- scoring ---------------------------------------------------------------------

_cols = FEATURES
_tiny = tiny_forest()
_duck = lambda m, k=0, **kw: scoring.for_duckdb(scoring.margin_sql(m, _cols, k, **kw))


@query(f"WITH {OF} SELECT row_id, round({_duck(_tiny)}, 6) AS margin FROM of_")
def score_margin(spark, d):
    return scoring.predict(order_features(spark, d), _tiny, FEATURES, "margin", "m").select("row_id", _r("m").alias("margin"))


@query(f"WITH {OF} SELECT row_id, round({_duck(_tiny)}, 6) AS margin FROM of_")
def score_margin_walk(spark, d):
    return scoring.predict(order_features(spark, d), _tiny, FEATURES, "margin", "m", strategy="walk").select("row_id", _r("m").alias("margin"))


@query(f"WITH {OF} SELECT row_id, round(1 / (1 + exp(-({_duck(_tiny)}))), 6) AS value FROM of_")
def score_value(spark, d):
    return scoring.predict(order_features(spark, d), _tiny, FEATURES, to="v").select("row_id", _r("v").alias("value"))


@query(f"WITH {OF} SELECT row_id, round({_duck(_tiny, begin=1, end=3)}, 6) AS margin FROM of_")
def score_iterations(spark, d):
    return scoring.predict(order_features(spark, d), _tiny, FEATURES, "margin", "m", begin=1, end=3).select("row_id", _r("m").alias("margin"))


@query("WITH " + OF + " SELECT row_id, " + ", ".join(f"{scoring.for_duckdb(scoring.tree_sql(t, _cols, str))} AS leaf{i}" for i, t in enumerate(_tiny.trees)) + " FROM of_")
def score_leaf_index(spark, d):
    at = scoring.predict(order_features(spark, d), _tiny, FEATURES, "leaf", "l", strategy="walk")
    return at.select("row_id", *[F.get("l", F.lit(i)).alias(f"leaf{i}") for i in range(3)])


_three = three_class_forest()
_m3 = [_duck(_three, k) for k in range(3)]


@query(f"WITH {OF}, m AS (SELECT row_id, {_m3[0]} AS a, {_m3[1]} AS b, {_m3[2]} AS c FROM of_) SELECT row_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS p1, round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS p2 FROM m")
def score_multiclass(spark, d):
    at = scoring.predict(order_features(spark, d), _three, FEATURES, to="p")
    return at.select("row_id", *[_r(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)])


@query(f"WITH {OF}, m AS (SELECT row_id, {_m3[0]} AS a, {_m3[1]} AS b, {_m3[2]} AS c FROM of_) SELECT row_id, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS class FROM m")
def score_argmax(spark, d):
    return scoring.predict(order_features(spark, d), _three, FEATURES, to="class", transform="argmax").select("row_id", "class")


_linear = Linear([[0.03], [-0.002], [0.01], [0.005]], [0.2], [0.1])
_x = lambda c: f"(CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END)"


@query(f"WITH {OF} SELECT row_id, round(0.3 + {' + '.join(f'{w[0]} * {_x(c)}' for c, w in zip(_cols, _linear.weights))}, 6) AS margin FROM of_")
def score_linear(spark, d):
    return scoring.predict(order_features(spark, d), _linear, FEATURES, "margin", "m").select("row_id", _r("m").alias("margin"))


_WIDE = wide_forest()
_wide_sql = scoring.for_duckdb(scoring.margin_sql(_WIDE, [f"list_extract(map_extract(m, {i}), 1)" for i in range(_WIDE.n_features)]))


@query(f"""WITH c AS (SELECT l_orderkey AS row_id, ((l_partkey * 48271 + l_suppkey * 16807) % 100000)::INT AS f, sum(round(l_quantity)::BIGINT)::DOUBLE AS v FROM lineitem GROUP BY ALL),
x AS (SELECT row_id, map(list(f), list(v)) AS m FROM c GROUP BY row_id) SELECT row_id, round({_wide_sql}, 6) AS margin FROM x""")
def score_sparse(spark, d):
    """Orders as a few of 100,000 features each: walked as arrays of numbers and values."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), ((F.col("l_partkey") * 48271 + F.col("l_suppkey") * 16807) % 100000).cast("int").alias("f"), F.round("l_quantity").cast("long").alias("q"))
    cells = li.groupBy("row_id", "f").agg(F.sum("q").cast("double").alias("v"))
    rows = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("c")).select("row_id", F.col("c.f").alias("indices"), F.col("c.v").alias("values"))
    return scoring.sparse_margins(rows, _WIDE).select("row_id", _r(F.get("margins", F.lit(0))).alias("margin"))


def _shares_sql() -> str:
    out = []
    for f in range(4):
        terms = []
        for i, t in enumerate(_tiny.trees):
            paths: dict[int, list[int]] = {}
            todo = [(0, [])]
            while todo:
                n, path = todo.pop()
                path = [*path, t.feature[n]]
                for c in (t.left[n], t.right[n]):
                    todo += [(c, path)] if c >= 0 else []
                    if c < 0:
                        paths[~c] = path
            w = _tiny.weight_of(i)
            terms.append(scoring.for_duckdb(scoring.tree_sql(t, _cols, lambda k, t=t, w=w, paths=paths, f=f: scoring.number(w * t.leaf_value[k][0] * paths[k].count(f) / len(paths[k])))))
        out.append(f"round({' + '.join(terms)}, 6) AS c{f}")
    return f"WITH {OF} SELECT row_id, {', '.join(out)} FROM of_"


@query(_shares_sql())
def explain_path_shares(spark, d):
    at = scoring.predict(order_features(spark, d), _tiny, FEATURES, "approx_contrib", "c")
    return at.select("row_id", *[_r(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(4)])


@query(f"WITH {OF} SELECT row_id, round({_duck(_tiny)}, 6) AS total FROM of_")
def explain_shapley_sum(spark, d):
    """Shapley values and bias add up to the margin."""
    at = scoring.predict(order_features(spark, d), _tiny, FEATURES, "contrib", "c")
    return at.select("row_id", _r(F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _shapley_terms():
    """By the definition: columns of a tree's expectation given each subset of its features, and the weighted differences for one feature and for two."""
    from itertools import combinations

    columns, terms, pairs = [], {f: [] for f in range(4)}, {}
    for i, t in enumerate(_tiny.trees):
        used = sorted(set(t.feature))
        share = [(lambda a, b: (a / (a + b), b / (a + b)))(t.child_cover(a), t.child_cover(b)) for a, b in zip(t.left, t.right)]

        def given(c, known, t=t, share=share):
            if c < 0:
                return scoring.number(t.leaf_value[~c][0])
            left, right = given(t.left[c], known), given(t.right[c], known)
            if t.feature[c] in known:
                return f"(CASE WHEN {scoring.goes_left_sql(t, c, _cols)} THEN {left} ELSE {right} END)"
            return f"({scoring.number(share[c][0])} * {left} + {scoring.number(share[c][1])} * {right})"

        name = lambda s, i=i: f"v{i}_" + "".join(map(str, sorted(s)))
        for n in range(len(used) + 1):
            columns += [f"{given(0, s)} AS {name(s)}" for s in combinations(used, n)]
        w = _tiny.weight_of(i)
        for f in used:
            rest = [x for x in used if x != f]
            for n in range(len(rest) + 1):
                part = math.factorial(n) * math.factorial(len(rest) - n) / math.factorial(len(used))
                terms[f] += [f"{scoring.number(w * part)} * ({name((*s, f))} - {name(s)})" for s in combinations(rest, n)]
        for f, g in combinations(used, 2):
            rest = [x for x in used if x not in (f, g)]
            for n in range(len(rest) + 1):
                part = math.factorial(n) * math.factorial(len(rest) - n) / math.factorial(len(used) - 1) / 2
                pairs.setdefault((f, g), []).extend(f"{scoring.number(w * part)} * ({name((*s, f, g))} - {name((*s, f))} - {name((*s, g))} + {name(s)})" for s in combinations(rest, n))
        # What the values miss of margin(x) - margin(0) goes to the feature of the root.
        zero = scoring.tree_sql(t, [scoring.number(0.0)] * 4, lambda k, t=t: scoring.number(t.leaf_value[k][0]))
        terms[t.feature[0]].append(f"{scoring.number(w)} * ({name(())} - {zero})")
    return columns, terms, pairs


def _shapley_sql() -> str:
    columns, terms, _ = _shapley_terms()
    zero_margin = scoring.margin_sql(_tiny, [scoring.number(0.0)] * 4)
    values = ", ".join(f"round({' + '.join(x)}, 6) AS c{f}" for f, x in terms.items())
    return scoring.for_duckdb(f"WITH {OF}, v AS (SELECT row_id, {', '.join(columns)} FROM of_) SELECT row_id, {values}, round({zero_margin}, 6) AS c4 FROM v")


def _interactions_sql() -> str:
    """Half of a pair's difference to each of its cells; the diagonal has what is left of the feature's value."""
    columns, terms, pairs = _shapley_terms()
    of = lambda f, g: f"({' + '.join(pairs.get((min(f, g), max(f, g)), [scoring.number(0.0)]))})"
    cells = [f"round({' + '.join(terms[f])} - ({' + '.join(of(f, g) for g in range(4) if g != f)}), 6) AS c{f}{f}" for f in range(4)]
    cells += [f"round({of(f, g)}, 6) AS c{f}{g}" for f in range(4) for g in range(f + 1, 4)]
    return scoring.for_duckdb(f"WITH {OF}, v AS (SELECT row_id, {', '.join(columns)} FROM of_) SELECT row_id, {', '.join(cells)} FROM v")


@query(_shapley_sql())
def explain_shapley(spark, d):
    at = scoring.predict(order_features(spark, d), _tiny, FEATURES, "contrib", "c")
    return at.select("row_id", *[_r(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(5)])


@query(_interactions_sql())
def explain_interactions(spark, d):
    """The upper half of the symmetric table."""
    at = scoring.predict(order_features(spark, d), _tiny, FEATURES, "interaction", "c")
    return at.select("row_id", *[_r(F.get(F.get("c", F.lit(i)), F.lit(j))).alias(f"c{i}{j}") for i in range(4) for j in range(i, 4)])


def _rough():
    import copy

    m = copy.deepcopy(_tiny)
    for t in m.trees:
        t.threshold = [float(round(x / 4) * 4) for x in t.threshold]
    return m


@query(f"WITH {OF}, x AS (SELECT abs({_duck(_tiny)} - {_duck(_rough())}) AS diff FROM of_) SELECT count(*) AS n_rows, round(max(diff), 6) AS max_diff, round(avg(diff), 6) AS mean_diff, round(avg((diff > 0.15)::INT), 6) AS fail_rate, max(diff) <= 0.15 AS passes FROM x")
def quantize_parity(spark, d):
    at = quantize.parity(order_features(spark, d), _tiny, _rough(), FEATURES)
    return at.select("n_rows", _r("max_diff").alias("max_diff"), _r("mean_diff").alias("mean_diff"), _r("fail_rate").alias("fail_rate"), "passes")


def _depth_sql(i: int) -> str:
    t = _tiny.trees[i]
    depth: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        c, n = todo.pop()
        if c < 0:
            depth[~c] = n
        else:
            todo += [(t.left[c], n + 1), (t.right[c], n + 1)]
    return scoring.for_duckdb(scoring.tree_sql(t, _cols, lambda k: str(depth[k])))


@query(f"WITH {OF}, x AS ({' UNION ALL '.join(f'SELECT {i} AS tree_id, {_depth_sql(i)} AS steps FROM of_' for i in range(3))}) SELECT tree_id, count(*) AS n_rows, sum(steps)::BIGINT AS total_steps, max(steps) AS max_steps FROM x GROUP BY 1")
def walk_profile(spark, d):
    return scoring.walk_profile(order_features(spark, d), _tiny, FEATURES)


# --- transforms ----------------------------------------------------------------------


@query(f"WITH {CM} SELECT row_id, round(probs[1], 6) AS p0, round(probs[10], 6) AS p9, (list_position(margin, list_max(margin)) - 1)::INT AS best, round(1 / (1 + exp(-margin[1])), 6) AS sig, round(exp(margin[1]), 6) AS ex FROM sm")
def transforms_all(spark, d):
    m = class_margins(spark, d)
    return m.select("row_id", _r(F.get(transforms.softmax(F.col("margin")), F.lit(0))).alias("p0"), _r(F.get(transforms.softmax(F.col("margin")), F.lit(9))).alias("p9"), transforms.argmax(F.col("margin")).alias("best"), _r(transforms.sigmoid(F.get("margin", F.lit(0)))).alias("sig"), _r(F.exp(F.get("margin", F.lit(0)))).alias("ex"))


# --- metrics -----------------------------------------------------------------------------

_POINT = {
    "rmse": ("price", "score", "sqrt(avg((price - score) * (price - score)))"),
    "mae": ("price", "score", "avg(abs(price - score))"),
    "logloss": ("label", "p", "avg(-(label * ln(p) + (1 - label) * ln(1 - p)))"),
    "error": ("label", "p", "avg(((p > 0.5) <> (label > 0.5))::INT)"),
    "mape": ("price", "score", "avg(CASE WHEN price <> 0 THEN abs((price - score) / price) END)"),
    "rmsle": ("price", "score", "sqrt(avg((ln(1 + price) - ln(1 + score)) * (ln(1 + price) - ln(1 + score))))"),
}


def _point(name, label, pred):
    def one(spark, d):
        return metrics.evaluate(scored_orders(spark, d), name, label, pred).select(_r("value").alias("value"))

    def grouped(spark, d):
        return metrics.evaluate(scored_orders(spark, d), name, label, pred, "qid").select(_r("value").alias("value"))

    return one, grouped


for _n, (_l, _p, _sql) in _POINT.items():
    Q[f"metric_{_n}"], _grouped = _point(_n, _l, _p)
    S[f"metric_{_n}"] = f"WITH {SO} SELECT round({_sql}, 6) AS value FROM so"
    if _n not in ("mape",):
        Q[f"metric_{_n}_by_group"] = _grouped
        S[f"metric_{_n}_by_group"] = f"WITH {SO}, g AS (SELECT {_sql} AS v FROM so GROUP BY qid) SELECT round(avg(v), 6) AS value FROM g"

_AUC = f"""WITH {SO}, r AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM so),
t AS (SELECT sum(CASE WHEN label > 0.5 THEN rk ELSE 0 END) AS s, sum(label) AS p, sum(1 - label) AS n FROM r) SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS value FROM t"""


@query(_AUC)
def metric_auc(spark, d):
    return metrics.evaluate(scored_orders(spark, d), "auc", "label", "p").select(_r("value").alias("value"))


@query(_AUC)
def metric_aucpr(spark, d):
    return metrics.evaluate(scored_orders(spark, d), "aucpr", "label", "p").select(_r("value").alias("value"))


@query(f"WITH {CM} SELECT round(avg(-ln(greatest(probs[label::INT + 1], 1e-15))), 6) AS value FROM sm")
def metric_mlogloss(spark, d):
    at = class_margins(spark, d).withColumn("q", transforms.softmax(F.col("margin")))
    return metrics.evaluate(at, "mlogloss", "label", "q").select(_r("value").alias("value"))


@query(f"WITH {CM} SELECT round(avg((list_position(margin, list_max(margin)) - 1 <> label)::INT), 6) AS value FROM sm")
def metric_merror(spark, d):
    return metrics.evaluate(class_margins(spark, d), "merror", "label", "margin").select(_r("value").alias("value"))


_RANKED = EG + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY margin DESC, row_id) AS r, row_number() OVER (PARTITION BY qid ORDER BY label DESC, row_id) AS i, 2 ** label - 1 AS g FROM eg)"""


def _ndcg_sql(k: int) -> str:
    return f"""WITH {_RANKED}, q AS (SELECT qid, sum(CASE WHEN r <= {k} THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= {k} THEN g / log2(i + 1) ELSE 0 END) AS best FROM rk GROUP BY 1)
SELECT round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END), 6) AS value FROM q"""


@query(_ndcg_sql(10**9))
def metric_ndcg(spark, d):
    return metrics.evaluate(event_groups(spark, d), "ndcg", "label", "margin", "qid", "row_id").select(_r("value").alias("value"))


@query(_ndcg_sql(5))
def metric_ndcg_at_5(spark, d):
    return metrics.evaluate(event_groups(spark, d), "ndcg@5", "label", "margin", "qid", "row_id").select(_r("value").alias("value"))


@query(f"""WITH {_RANKED}, h AS (SELECT qid, r, label > 0.5 AS rel, sum((label > 0.5)::INT) OVER (PARTITION BY qid ORDER BY r) AS hits FROM rk),
q AS (SELECT qid, sum(CASE WHEN rel THEN hits / r ELSE 0 END) / greatest(sum(rel::INT), 1) AS v FROM h GROUP BY 1) SELECT round(avg(v), 6) AS value FROM q""")
def metric_map(spark, d):
    return metrics.evaluate(event_groups(spark, d), "map", "label", "margin", "qid", "row_id").select(_r("value").alias("value"))


# --- objectives ------------------------------------------------------------------------------


def _gradient(objective, label, margin, g, h):
    name = "objective_" + objective.split(":")[1]

    def f(spark, d):
        at = scored_orders(spark, d)
        grad, hess = objectives.POINTWISE[objective](F.col(label), F.col(margin), F.lit(1.0))
        return at.select("row_id", _r(grad).alias("grad"), _r(hess).alias("hess"))

    Q[name], S[name] = f, f"WITH {SO} SELECT row_id, round({g}, 6) AS grad, round({h}, 6) AS hess FROM so"


_sig = "(1 / (1 + exp(-p)))"
_gradient("reg:squarederror", "price", "score", "score - price", "1.0::DOUBLE")
_gradient("binary:logistic", "label", "p", f"{_sig} - label", f"greatest({_sig} * (1 - {_sig}), 1e-16)")
_gradient("reg:gamma", "price", "p", "1 - CASE WHEN price > 0 THEN price ELSE 1e-16 END / exp(p)", "greatest(CASE WHEN price > 0 THEN price ELSE 1e-16 END / exp(p), 1e-16)")
_gradient("count:poisson", "price", "p", "exp(p) - price", "greatest(exp(p), 1e-16)")
_gradient("reg:tweedie", "price", "p", "exp(0.5 * p) - price * exp(-0.5 * p)", "greatest(0.5 * exp(0.5 * p) + 0.5 * price * exp(-0.5 * p), 1e-16)")


@query(f"WITH {CM} SELECT row_id, round(probs[1] - (label = 0)::INT, 6) AS g0, round(greatest(2 * probs[1] * (1 - probs[1]), 1e-16), 6) AS h0, round(probs[10] - (label = 9)::INT, 6) AS g9, round(greatest(2 * probs[10] * (1 - probs[10]), 1e-16), 6) AS h9 FROM sm")
def objective_softprob(spark, d):
    g, h = objectives.softprob(F.col("label"), F.col("margin"), F.lit(1.0), 10)
    return class_margins(spark, d).select("row_id", *[_r(F.get(c, F.lit(k))).alias(f"{n}{k}") for k in (0, 9) for n, c in (("g", g), ("h", h))])


_BOUNDS = "lo AS (SELECT row_id, risk, CASE WHEN row_id % 4 = 2 THEN 0.0 ELSE abs(time) / 100 END::DOUBLE AS l, CASE row_id % 4 WHEN 0 THEN abs(time) / 100 WHEN 1 THEN 'Infinity'::DOUBLE ELSE abs(time) / 100 + 1 END::DOUBLE AS u FROM eg), sc AS (SELECT *, l / exp(risk) AS a, u / exp(risk) AS b FROM lo), gg AS (SELECT *, CASE WHEN u = 'Infinity' OR l = u THEN 0 WHEN l = 0 THEN b * exp(-b) / greatest(1 - exp(-b), 1e-16) ELSE (exp(-a) * a - exp(-b) * b) / greatest(exp(-a) - exp(-b), 1e-16) END AS s FROM sc)"


@query(f"WITH {EG}, {_BOUNDS} SELECT row_id, round(CASE WHEN u = 'Infinity' THEN -a WHEN l = u THEN 1 - a ELSE -s END, 6) AS grad, round(greatest(CASE WHEN u = 'Infinity' OR l = u THEN a ELSE abs(s) END, 1e-16), 6) AS hess FROM gg")
def objective_aft(spark, d):
    t = F.abs("time") / 100
    lower = F.when(F.col("row_id") % 4 == 2, 0.0).otherwise(t)
    upper = F.when(F.col("row_id") % 4 == 0, t).when(F.col("row_id") % 4 == 1, float("inf")).otherwise(t + 1)
    g, h = objectives.aft(lower, upper, F.col("risk"), F.lit(1.0))
    return event_groups(spark, d).select("row_id", _r(g).alias("grad"), _r(h).alias("hess"))


@query(f"""WITH {EG}, r AS (SELECT *, abs(time) AS t, exp(risk) AS e, sum(exp(risk)) OVER (ORDER BY abs(time) RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rs FROM eg),
s AS (SELECT *, sum(CASE WHEN time > 0 THEN 1 / rs ELSE 0 END) OVER (ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS rk, sum(CASE WHEN time > 0 THEN 1 / (rs * rs) ELSE 0 END) OVER (ORDER BY t, row_id ROWS UNBOUNDED PRECEDING) AS sk FROM r)
SELECT row_id, round(e * rk - (time > 0)::INT, 5) AS grad, round(greatest(e * rk - e * e * sk, 1e-16), 5) AS hess FROM s""")
def objective_cox(spark, d):
    return objectives.cox(event_groups(spark, d), "time", "risk", "row_id").select("row_id", _r("grad", 5).alias("grad"), _r("hess", 5).alias("hess"))


@query(f"""WITH {EG}, x AS (SELECT *, exp(margin - max(margin) OVER q) AS a, exp(label - max(label) OVER q) AS b, count(*) OVER q AS n FROM eg WINDOW q AS (PARTITION BY qid)),
y AS (SELECT row_id, n, a / sum(a) OVER (PARTITION BY qid) AS p, b / sum(b) OVER (PARTITION BY qid) AS t FROM x)
SELECT row_id, round(CASE WHEN n < 2 THEN 0 ELSE p - t END, 6) AS grad, round(CASE WHEN n < 2 THEN 0 ELSE greatest(p * (1 - p), 1e-16) END, 6) AS hess FROM y""")
def objective_listwise(spark, d):
    return objectives.listwise(event_groups(spark, d)).select("row_id", _r("grad").alias("grad"), _r("hess").alias("hess"))


def _pairs_sql(ndcg: bool, k: int | None, ideal: int = 10**9, position: int = 10**9) -> str:
    delta = f"CASE WHEN b0.best > 0 THEN abs((a.g - b.g) * (1 / log2(a.r + 1) - 1 / log2(b.r + 1))) / b0.best * (least(a.r, b.r) <= {position})::INT ELSE 0 END" if ndcg else "1.0"
    near = f"AND (a.r <= {k} OR b.r <= {k})" if k else ""
    hess = "2 * greatest(rho * (1 - rho), 1e-16)" if k else "rho * (1 - rho)"
    scale = "CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END" if k else "1"
    return f"""WITH {_RANKED}, best AS (SELECT qid, sum(CASE WHEN i <= {ideal} THEN g / log2(i + 1) ELSE 0 END) AS best FROM rk GROUP BY 1),
pr AS (SELECT a.qid, a.row_id AS hi, b.row_id AS lo, 1 / (1 + exp(a.margin - b.margin)) AS rho, {delta} AS delta FROM rk a JOIN rk b ON a.qid = b.qid AND a.label > b.label {near} JOIN best b0 ON a.qid = b0.qid),
ea AS (SELECT qid, hi AS row_id, -rho * delta AS g, {hess} * delta AS h FROM pr UNION ALL SELECT qid, lo, rho * delta, {hess} * delta FROM pr),
tt AS (SELECT qid, 2 * sum(rho * delta) AS total FROM pr GROUP BY 1), su AS (SELECT qid, row_id, sum(g) AS g, sum(h) AS h FROM ea GROUP BY 1, 2)
SELECT eg.row_id, round(coalesce(g * {scale}, 0), 6) AS grad, round(greatest(coalesce(h * {scale}, 0), 1e-16), 6) AS hess FROM eg LEFT JOIN su USING (row_id) LEFT JOIN tt ON eg.qid = tt.qid"""


@query(_pairs_sql(False, None))
def objective_pairwise_full(spark, d):
    at = objectives.pair_gradients(event_groups(spark, d), "pairwise", objectives.RankConfig("full"))
    return at.select("row_id", _r("grad").alias("grad"), _r("hess").alias("hess"))


@query(_pairs_sql(True, 8))
def objective_rank_ndcg(spark, d):
    at = objectives.pair_gradients(event_groups(spark, d), "ndcg", objectives.RankConfig("topk", 8))
    return at.select("row_id", _r("grad").alias("grad"), _r("hess").alias("hess"))


_MEAN = _RANKED + f""", lb AS (SELECT *, min(i) OVER (PARTITION BY qid, label) - 1 AS f, max(i) OVER (PARTITION BY qid, label) AS t, count(*) OVER (PARTITION BY qid) AS n FROM rk),
dr AS (SELECT lb.*, ('0x' || substr(md5('0:' || qid || ':' || row_id || ':' || dn), 1, 8))::BIGINT % (n - t + f) AS p FROM lb, range(4) x(dn) WHERE n - t + f > 0),
pr AS (SELECT a.qid, CASE WHEN a.label > b.label THEN a.row_id ELSE b.row_id END AS hi, CASE WHEN a.label > b.label THEN b.row_id ELSE a.row_id END AS lo,
  1 / (1 + exp(CASE WHEN a.label > b.label THEN a.margin - b.margin ELSE b.margin - a.margin END)) AS rho FROM dr a JOIN rk b ON a.qid = b.qid AND b.i - 1 = CASE WHEN p < f THEN p ELSE p - f + t END),
ea AS (SELECT qid, hi AS row_id, -rho AS g, 2 * rho * (1 - rho) AS h FROM pr UNION ALL SELECT qid, lo, rho, 2 * rho * (1 - rho) FROM pr),
tt AS (SELECT qid, 2 * sum(rho) AS total FROM pr GROUP BY 1), su AS (SELECT qid, row_id, sum(g) AS g, sum(h) AS h FROM ea GROUP BY 1, 2)"""


@query(_pairs_sql(True, 8, 5, 4))
def objective_rank_ndcg_cut(spark, d):
    """The ideal gain of the best 5 rows; pairs of which neither is among the first 4 have no weight."""
    at = objectives.pair_gradients(event_groups(spark, d), "ndcg", objectives.RankConfig("topk", 8, ndcg_k=5, max_position=4))
    return at.select("row_id", _r("grad").alias("grad"), _r("hess").alias("hess"))


@query(f"""WITH {EG}, x AS (SELECT qid, exp(margin - max(margin) OVER q) AS a, exp(label - max(label) OVER q) AS b FROM eg WINDOW q AS (PARTITION BY qid)),
y AS (SELECT qid, a / sum(a) OVER (PARTITION BY qid) AS p, b / sum(b) OVER (PARTITION BY qid) AS t FROM x) SELECT qid, round(-sum(t * ln(greatest(p, 1e-15))), 6) AS loss FROM y GROUP BY 1""")
def listwise_loss(spark, d):
    return objectives.listwise_loss(event_groups(spark, d)).select("qid", _r("loss").alias("loss"))


@query(f"WITH {_MEAN} SELECT eg.row_id, round(coalesce(g * CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END, 0), 6) AS grad, round(greatest(coalesce(h * CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END, 0), 1e-16), 6) AS hess FROM eg LEFT JOIN su USING (row_id) LEFT JOIN tt ON eg.qid = tt.qid")
def objective_pairwise_mean(spark, d):
    at = objectives.pair_gradients(event_groups(spark, d), "pairwise", objectives.RankConfig("mean", 4))
    return at.select("row_id", _r("grad").alias("grad"), _r("hess").alias("hess"))


@query(f"WITH {SO} SELECT round(avg(price), 6) AS mean, round(ln(sum(label) / sum(1 - label)), 6) AS log_odds, round(ln(avg(CASE WHEN price > 0 THEN price END)), 6) AS log_mean FROM so")
def objective_starts(spark, d):
    y, b, w = F.col("price"), F.col("label"), F.lit(1.0)
    return scored_orders(spark, d).agg(_r(objectives.weighted_mean(y, w)).alias("mean"), _r(objectives.log_odds(b, w)).alias("log_odds"), _r(objectives.log_mean(y, w, True)).alias("log_mean"))


# --- splits and training -------------------------------------------------------------------------

_TRAIN = OF + ", tr AS (SELECT row_id, tax, coalesce(quantity, 'NaN'::DOUBLE) AS quantity, lines, price, label, 0 AS node, 0.5 - label AS grad, 0.25::DOUBLE AS hess FROM of_)"


def training_rows(spark, d):
    at = order_features(spark, d)
    return at.withColumns({"node": F.lit(0), "grad": 0.5 - F.col("label"), "hess": F.lit(0.25), "quantity": F.coalesce("quantity", F.lit(float("nan")))})


_CUTS = {"tax": [5.5, 11.5, 17.5, 23.5], "quantity": [30.0, 60.0, 90.0, 120.0, 150.0]}
_BINS = {f: splits.bin_sql(f, c) for f, c in _CUTS.items()}
_HIST = f"{_TRAIN}, hi AS (" + " UNION ALL ".join(f"SELECT node, {i} AS feature, CASE WHEN isnan({f}) THEN {len(_CUTS[f])} ELSE {b} END::INT AS pos, sum(grad) AS g, sum(hess) AS h, count(*) AS n FROM tr GROUP BY ALL" for i, (f, b) in enumerate(_BINS.items())) + ")"


_DENSE = dense.Search(tuple(map(len, _CUTS.values())), (frozenset(range(len(_CUTS))),), lam=1.0)


def _dense_histograms(spark, d):
    rows = training_rows(spark, d)
    bins = F.array(*[splits.bin_of(F.col(f), c) for f, c in _CUTS.items()])
    work = rows.select(bins.alias("_x"), F.array("grad").alias("_g"), F.array("hess").alias("_h"), F.array(F.col("node").cast("long")).alias("_at"))
    return dense.level_histograms(work, int(spark.conf.get("spark.sql.shuffle.partitions")), [(0, 0)], [], _DENSE, 1, [0], None)


@query(f"WITH {_HIST} SELECT node, feature, pos, round(g, 6) AS g, round(h, 6) AS h, n FROM hi")
def histogram(spark, d):
    return dense.as_rows(_dense_histograms(spark, d), _DENSE).select(F.col("node").cast("int").alias("node"), "feature", "pos", _r("g").alias("g"), _r("h").alias("h"), "n")


def _best(hist: str, lam: float) -> str:
    return f"""cu AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY node, feature) AS gt, sum(h) OVER (PARTITION BY node, feature) AS ht FROM {hist} WINDOW w AS (PARTITION BY node, feature ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ga AS (SELECT *, 0.5 * (gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / (ht - hl + {lam}) - gt * gt / (ht + {lam})) AS gain FROM cu WHERE threshold IS NOT NULL AND hl > 0 AND ht - hl > 0),
be AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, threshold) AS k FROM ga)
SELECT node, feature, round(threshold, 6) AS threshold, round(gain, 5) AS gain FROM be WHERE k = 1 AND gain > 0"""


_ENDS = " ".join(f"WHEN feature = {i} THEN ([{', '.join(map(str, c))}]::DOUBLE[])[pos + 1]" for i, c in enumerate(_CUTS.values()))


@query(f"WITH {_HIST}, hc AS (SELECT *, CASE {_ENDS} END AS threshold FROM hi), {_best('hc', 1.0)}")
def split_histogram(spark, d):
    ends = F.array(*[F.array(*[F.lit(x) for x in c]) for c in _CUTS.values()])
    found = _dense_histograms(spark, d).where("feature IS NOT NULL")
    best = found.groupBy("node").agg(F.min_by(F.struct("feature", "pos", "gain"), F.struct(-F.col("gain"), "feature")).alias("b"))  # of the blocks of features
    return best.select(F.col("node").cast("int").alias("node"), "b.feature", _r(F.get(F.get(ends, F.col("b.feature")), F.col("b.pos"))).alias("threshold"), _r("b.gain", 5).alias("gain"))


_EXACT = f"{_TRAIN}, hx AS (" + " UNION ALL ".join(f"SELECT node, {i} AS feature, {f} AS pos, sum(grad) AS g, sum(hess) AS h FROM tr GROUP BY ALL" for i, f in enumerate(("tax", "quantity", "lines"))) + "), hn AS (SELECT *, lead(pos) OVER (PARTITION BY node, feature ORDER BY pos) AS nx FROM hx), he AS (SELECT *, CASE WHEN nx IS NOT NULL AND NOT isnan(nx) AND NOT isnan(pos) THEN (pos + nx) / 2 END AS threshold FROM hn)"


@query(f"WITH {_EXACT}, {_best('he', 1.0)}")
def split_exact(spark, d):
    hist = splits.histogram(training_rows(spark, d), "node", {f: F.col(f) for f in ("tax", "quantity", "lines")})
    found = splits.best_splits(splits.candidates(hist, splits.next_midpoint(), 1.0, F.isnan("pos")))
    return found.select("node", "feature", _r("threshold").alias("threshold"), _r("gain", 5).alias("gain"))


@query(f"""WITH {_TRAIN}, hx AS (SELECT node, 0 AS feature, lines AS pos, sum(grad) AS g, sum(hess) AS h FROM tr GROUP BY ALL), t AS (SELECT *, sum(g) OVER () AS gt, sum(h) OVER () AS ht FROM hx),
ga AS (SELECT *, 0.5 * (g * g / (h + 1) + (gt - g) * (gt - g) / (ht - h + 1) - gt * gt / (ht + 1)) AS gain FROM t WHERE NOT isnan(pos) AND pos >= 0 AND pos < 32 AND ht - h > 0)
SELECT node, feature, pos AS threshold, round(gain, 5) AS gain FROM ga WHERE gain > 0 ORDER BY gain DESC, pos LIMIT 1""")
def split_categorical(spark, d):
    hist = splits.histogram(training_rows(spark, d), "node", {"lines": F.col("lines")})
    return splits.best_splits(splits.one_against_rest(hist, 1.0)).select("node", "feature", "threshold", _r("gain", 5).alias("gain"))


@query(f"""WITH {_EXACT}, cu AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM he WINDOW w AS (PARTITION BY feature ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ga AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM cu WHERE threshold IS NOT NULL AND hl > 0 AND ht - hl > 0
 AND (feature <> 0 OR -gl / (hl + 1) <= -(gt - gl) / (ht - hl + 1)) AND (feature <> 1 OR -gl / (hl + 1) >= -(gt - gl) / (ht - hl + 1)))
SELECT node, feature, round(threshold, 6) AS threshold, round(gain, 5) AS gain FROM ga WHERE gain > 0 ORDER BY gain DESC, feature, threshold LIMIT 1""")
def split_monotone(spark, d):
    hist = splits.histogram(training_rows(spark, d), "node", {f: F.col(f) for f in ("tax", "quantity", "lines")})
    found = splits.candidates(hist, splits.next_midpoint(), 1.0, F.isnan("pos"))
    return splits.best_splits(found, monotone={0: 1, 1: -1}, lam=1.0).select("node", "feature", _r("threshold").alias("threshold"), _r("gain", 5).alias("gain"))


@query(f"""WITH {_EXACT}, cu AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM he WINDOW w AS (PARTITION BY feature ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ga AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM cu WHERE threshold IS NOT NULL AND feature < 2 AND hl > 0 AND ht - hl > 0),
be AS (SELECT * FROM ga ORDER BY gain DESC, feature, threshold LIMIT 1)
SELECT row_id, round(CASE WHEN CASE be.feature WHEN 0 THEN tax ELSE quantity END <= threshold THEN -gl / (hl + 1) ELSE -(gt - gl) / (ht - hl + 1) END * 0.3, 6) AS margin FROM tr, be""")
def train_stump(spark, d):
    """One round of depth one from a start of zero, scored on its training rows."""
    p = boosting.Params("binary:logistic", max_depth=1, lam=1.0, method="exact")
    c = boosting.Columns(["tax", "quantity"])
    rows = training_rows(spark, d).withColumns({"margin": F.array(F.lit(0.0)), "_x": boosting.values_array(c.features)})
    model = Forest(boosting.grow_round(boosting.round_table(rows, p, c), p, boosting.Round("exact", 1, [0], [[0, 1]]), 2, 0.3), 2)
    return scoring.predict(rows, model, ["tax", "quantity"], "margin", "m").select("row_id", _r("m").alias("margin"))


_NODE_BINS = 16


@query(f"""WITH {OF}, tr AS (SELECT 3 + qid % 3 AS node, tax, lines, 0.5 - label AS grad, 0.25::DOUBLE AS hess FROM of_),
lf AS (SELECT node, 0 AS feature, tax AS v, grad, hess FROM tr UNION ALL SELECT node, 1, lines, grad, hess FROM tr),
st AS (SELECT node, feature, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS nd FROM lf WHERE NOT isnan(v) GROUP BY ALL),
dv AS (SELECT node, feature, v, lead(v) OVER (PARTITION BY node, feature ORDER BY v) AS nx FROM (SELECT DISTINCT node, feature, v FROM lf WHERE NOT isnan(v))),
cu AS (SELECT node, feature, (v + nx) / 2 AS threshold FROM dv JOIN st USING (node, feature) WHERE nd <= {_NODE_BINS} AND nx IS NOT NULL
  UNION ALL SELECT node, feature, lo + (hi - lo) * k / {_NODE_BINS}.0::DOUBLE FROM st, range(1, {_NODE_BINS}) t(k) WHERE nd > {_NODE_BINS}),
su AS (SELECT c.node, c.feature, threshold, sum(grad) FILTER (NOT isnan(v) AND v <= threshold) AS gl, sum(hess) FILTER (NOT isnan(v) AND v <= threshold) AS hl, sum(grad) AS gt, sum(hess) AS ht FROM cu c JOIN lf ON c.node = lf.node AND c.feature = lf.feature GROUP BY ALL),
ga AS (SELECT *, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM su WHERE hl > 0 AND ht - hl > 0)
SELECT node, feature, round(threshold, 6) AS threshold, round(gain, 5) AS gain FROM ga WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, threshold) = 1""")
def split_per_node(spark, d):
    """Three nodes with bins of their own: equal widths for the many values of one feature, midpoints for the few of the other."""
    p = boosting.Params("binary:logistic", lam=1.0, max_bin=_NODE_BINS)
    node = (F.lit(3) + F.col("qid") % 3).cast("long")
    work = training_rows_of(spark, d).select(boosting.values_array(["tax", "lines"]).alias("_x"), F.array("grad").alias("_g"), F.array("hess").alias("_h"), F.array(node).alias("_at"))
    found = boosting._per_node_level(work, int(spark.conf.get("spark.sql.shuffle.partitions")), [(0, n) for n in (3, 4, 5)], [], p, boosting.Round("per-node", 1, [0], [[0, 1]]), 2)
    return spark.createDataFrame([(n, f, round(threshold, 6), round(gain, 5)) for (_, n), (f, threshold, _, gain, *_) in found.items()], "node long, feature int, threshold double, gain double")


def training_rows_of(spark, d):
    return order_features(spark, d).withColumns({"grad": 0.5 - F.col("label"), "hess": F.lit(0.25)})


_MIDS = "lf AS (SELECT {key}, row_id, 0 AS feature, tax AS v, grad, hess FROM tr UNION ALL SELECT {key}, row_id, 1, lines, grad, hess FROM tr), mi AS (SELECT feature, v, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS threshold FROM (SELECT DISTINCT feature, v FROM lf WHERE NOT isnan(v)))"


def _search_sql(rows: str, key: str, to: str) -> str:
    """The best split of each ``key`` of ``rows``, among midpoints of all rows."""
    return f"""{to}_h AS (SELECT {key}, feature, v, sum(grad) AS g, sum(hess) AS h FROM {rows} GROUP BY ALL),
{to}_c AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY {key}, feature) AS gt, sum(h) OVER (PARTITION BY {key}, feature) AS ht FROM {to}_h WINDOW w AS (PARTITION BY {key}, feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
{to}_g AS (SELECT {key}, feature, threshold, gl, hl, gt, ht, 0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)) AS gain FROM {to}_c JOIN mi USING (feature, v) WHERE threshold IS NOT NULL AND hl > 0 AND ht - hl > 1e-9),
{to} AS (SELECT * FROM {to}_g WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gain DESC, feature, threshold) = 1)"""


_CLASSES = f"""{OF}, tr AS (SELECT row_id, k AS class_id, tax, lines, 1 / 3.0::DOUBLE - (least(floor(price / 100), 2) = k)::INT AS grad, 4 / 9.0::DOUBLE AS hess FROM of_, range(3) t(k)), {_MIDS.format(key="class_id")}, {_search_sql("lf", "class_id", "be")}"""


def _price_bands(spark, d):
    """A model of one round over three price bands, a tree for each."""
    rows = order_features(spark, d).withColumn("band", F.least(F.floor(F.col("price") / 100), F.lit(2)).cast("double"))
    p = boosting.Params("multi:softprob", rounds=1, max_depth=1, lam=1.0, method="hist", num_class=3)
    return boosting.train(rows, p, boosting.Columns(["tax", "lines"], "band"))[0]


@query(f"""WITH {_CLASSES} SELECT class_id::INT AS class_id, feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, round(-gl / (hl + 1) * 0.3, 6) AS left_value, round(-(gt - gl) / (ht - hl + 1) * 0.3, 6) AS right_value FROM be""")
def train_multiclass(spark, d):
    """The first round of three classes, in the same jobs: root splits and leaf values."""
    model = _price_bands(spark, d)
    found = [(k, t.feature[0], round(t.threshold[0], 6), round(t.gain[0], 4), *(round(float(v[0]), 6) for v in t.leaf_value)) for k, t in zip(model.tree_class, model.trees) if t.nodes]
    return spark.createDataFrame(found, "class_id int, feature int, threshold double, gain double, left_value double, right_value double")


@query(f"WITH {_CLASSES} SELECT 3::BIGINT AS n_trees, 1::BIGINT AS n_iterations, count(*) AS n_nodes, 3 + count(*) AS n_tips, max(feature) + 1 AS n_features FROM be")
def model_metadata(spark, d):
    """Of the model of :func:`train_multiclass`."""
    return explain.metadata(_price_bands(spark, d).node_table(spark))


_LEVELS = f"""{OF}, m AS (SELECT avg(label) AS p FROM of_), tr AS (SELECT 0 AS node, row_id, tax, lines, p - label AS grad, p * (1 - p) AS hess FROM of_, m), {_MIDS.format(key="node")}, {_search_sql("lf", "node", "top")},
rn AS (SELECT tr.row_id, CASE WHEN (top.feature = 0 AND tax <= threshold) OR (top.feature = 1 AND NOT isnan(lines) AND lines <= threshold) THEN 1 ELSE 2 END AS node FROM tr, top),
l2 AS (SELECT rn.node, lf.row_id, feature, v, grad, hess FROM lf JOIN rn USING (row_id)), {_search_sql("l2", "node", "low")},
nodes AS (SELECT node::INT AS node, feature, threshold, gain, ht FROM top UNION ALL SELECT node::INT, feature, threshold, gain, ht FROM low)"""


def _two_levels(spark, d):
    """A model of one tree of two levels."""
    p = boosting.Params("binary:logistic", rounds=1, max_depth=2, lam=1.0, method="hist")
    return boosting.train(order_features(spark, d), p, boosting.Columns(["tax", "lines"]))[0]


@query(f"WITH {_LEVELS} SELECT node, feature, round(threshold, 6) AS threshold, round(gain, 3) AS gain FROM nodes")
def train_levels(spark, d):
    """The first round of a tree of two levels: its splits by node."""
    t, at = _two_levels(spark, d).trees[0], {}
    for j in range(t.nodes):
        n = at.setdefault(j, 0)
        at |= {c: 2 * n + k for k, c in ((1, t.left[j]), (2, t.right[j])) if c >= 0}
    return spark.createDataFrame([(at[j], t.feature[j], round(t.threshold[j], 6), round(t.gain[j], 3)) for j in range(t.nodes)], "node int, feature int, threshold double, gain double")


@query(f"""WITH {_LEVELS}, s AS (SELECT feature, count(*)::DOUBLE AS weight, sum(gain) AS gain, sum(ht) AS cover FROM nodes GROUP BY 1)
SELECT feature, round(weight, 3) AS weight, round(gain, 3) AS gain, round(gain / sum(gain) OVER (), 3) AS total_gain, round(cover, 3) AS cover, round(cover / sum(cover) OVER (), 3) AS total_cover FROM s""")
def importance_all(spark, d):
    """Of the model of :func:`train_levels`."""
    nodes = _two_levels(spark, d).node_table(spark)
    out = None
    for kind in explain.IMPORTANCE:
        one = explain.importance(nodes, kind).select("feature", _r("score", 3).alias(kind))
        out = one if out is None else out.join(one, "feature")
    return out


@query(f"""WITH {_LEVELS}, w AS (SELECT 0 AS tree_id, (row_number() OVER (ORDER BY node) - 1)::INT AS node_id, feature, threshold, min(threshold) OVER (PARTITION BY feature) AS lo, max(threshold) OVER (PARTITION BY feature) AS hi FROM nodes),
q AS (SELECT *, CASE WHEN hi > lo THEN floor((threshold - lo) / (hi - lo) * 127 + 0.5) ELSE 0 END::INT AS q FROM w)
SELECT tree_id, node_id, feature, threshold, q, round(lo + q / 127.0::DOUBLE * (hi - lo), 6) AS decoded FROM q""")
def quantize_thresholds(spark, d):
    """Of the model of :func:`train_levels`."""
    return quantize.quantize_nodes(_two_levels(spark, d).node_table(spark)).withColumn("decoded", _r("decoded"))


@query()
def train_boosted(spark, d):
    rows = order_features(spark, d)
    p = boosting.Params("binary:logistic", rounds=3, max_depth=3, lam=1.0, method="hist", max_bin=32)
    c = boosting.Columns(FEATURES)
    model, history = boosting.train(rows, p, c)
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(history.train)], "round int, auc double")


def _ranking_stump_sql() -> str:
    gradients = _pairs_sql(True, 8).replace(", 6) AS grad, round(greatest(", " AS grad, greatest(").replace("SELECT eg.row_id, round(coalesce(", "SELECT eg.row_id, eg.label, coalesce(").replace("1e-16), 6) AS hess FROM eg", "1e-16) AS hess FROM eg")
    start = gradients.replace("(event_id * 7919 % 211) / 100.0::DOUBLE AS margin", "0.0::DOUBLE AS margin")
    return f"""WITH gr AS ({start}), lf AS (SELECT 0 AS node, row_id, 0 AS feature, row_id % 17 + label AS v, grad, hess FROM gr UNION ALL SELECT 0, row_id, 1, (row_id % 5)::DOUBLE, grad, hess FROM gr),
mi AS (SELECT feature, v, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS threshold FROM (SELECT DISTINCT feature, v FROM lf)), {_search_sql("lf", "node", "be")}
SELECT feature, round(threshold, 6) AS threshold, round(gain, 4) AS gain, round(-gl / (hl + 1) * 0.3, 5) AS left_value, round(-(gt - gl) / (ht - hl + 1) * 0.3, 5) AS right_value FROM be"""


def _ranking_rows(spark, d):
    return event_groups(spark, d).withColumns({"f0": F.col("row_id") % 17 + F.col("label"), "f1": (F.col("row_id") % 5).cast("double")})


@query(_ranking_stump_sql())
def train_ranking_stump(spark, d):
    """The first round of LambdaMART: its split and leaf values."""
    p = boosting.Params("rank:ndcg", rounds=1, max_depth=1, lam=1.0, method="hist", rank=objectives.RankConfig("topk", 8))
    t = boosting.train(_ranking_rows(spark, d), p, boosting.Columns(["f0", "f1"], group="qid"))[0].trees[0]
    return spark.createDataFrame([(t.feature[0], round(t.threshold[0], 6), round(t.gain[0], 4), *(round(float(v[0]), 5) for v in t.leaf_value))], "feature int, threshold double, gain double, left_value double, right_value double")


@query()
def train_ranking(spark, d):
    rows = _ranking_rows(spark, d)
    p = boosting.Params("rank:ndcg", rounds=2, max_depth=2, lam=1.0, method="exact", rank=objectives.RankConfig("topk", 8))
    model, history = boosting.train(rows, p, boosting.Columns(["f0", "f1"], group="qid"))
    return spark.createDataFrame([(r, float(v)) for r, v in enumerate(history.train)], "round int, ndcg double")


@query(f"WITH {OF}, x AS (SELECT tax, 0.5 - label AS grad, 0.25::DOUBLE AS hess FROM of_) SELECT round(-0.5 * sum(grad * tax) / (sum(hess * tax * tax) + 1), 6) AS w_tax, round(-0.5 * sum(grad) / sum(hess), 6) AS bias FROM x")
def linear_round(spark, d):
    """One round of the coordinate step of the linear booster, from a margin of zero."""
    rows = order_features(spark, d).withColumn("margin", F.array(F.lit(0.0)))
    p = boosting.Params("binary:logistic")
    s = boosting.linear_sums(rows, p, boosting.Columns(["tax"]), 0)
    return s.select(_r(-0.5 * F.col("g0") / (F.col("h0") + 1)).alias("w_tax"), _r(-0.5 * F.col("g") / F.col("h")).alias("bias"))


@query(f"WITH {OF}, v AS (SELECT DISTINCT tax FROM of_), s AS (SELECT min(tax) AS lo, max(tax) AS hi FROM of_) SELECT k::INT AS k, round(lo + (hi - lo) * k / 8.0, 6) AS cut FROM s, range(1, 8) t(k)")
def cut_points_equal_width(spark, d):
    cuts = splits.cut_points(order_features(spark, d), ["tax"], 8)["tax"]
    return spark.createDataFrame([(k + 1, round(x, 6)) for k, x in enumerate(cuts)], "k int, cut double")


@query(f"WITH {OF}, v AS (SELECT DISTINCT lines FROM of_ WHERE NOT isnan(lines)), n AS (SELECT lines, lead(lines) OVER (ORDER BY lines) AS nx, row_number() OVER (ORDER BY lines) AS k FROM v) SELECT k::INT AS k, (lines + nx) / 2 AS cut FROM n WHERE nx IS NOT NULL")
def cut_points_midpoints(spark, d):
    cuts = splits.cut_points(order_features(spark, d), ["lines"], 256)["lines"]
    return spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(cuts)], "k int, cut double")


@query("SELECT fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey, least((row_number() OVER (ORDER BY md5('5:' || o_orderkey::VARCHAR)) - 1) // (SELECT count(*) // 5 FROM orders), 4)::INT AS fold FROM orders) GROUP BY fold")
def kfold_assignment(spark, d):
    """Folds by rank of a hash; the last takes the rest. Ranks come from block counts, not one sorted task."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("User"), recsys.hash_order(F.col("o_orderkey"), 5).alias("_h"))
    n = o.count()
    from .functions.windows import running_sum

    ranked = running_sum(o.withColumn("one", F.lit(1)), "_h", "one", "rank")
    fold = F.least(F.floor((F.col("rank") - 1) / (n // 5)), F.lit(4)).cast("int")
    return ranked.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("User").alias("keys"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY md5('9:' || o_orderkey::VARCHAR)) <= (SELECT floor(count(*) * 0.1) FROM orders)")
def row_sample(spark, d):
    """An exact tenth of the rows, by rank of a hash; ranks come from block counts."""
    o = _t(spark, d, "orders").select("o_orderkey", recsys.hash_order(F.col("o_orderkey"), 9).alias("_h"))
    most = math.floor(o.count() * 0.1)
    from .functions.windows import running_sum

    ranked = running_sum(o.withColumn("one", F.lit(1)), "_h", "one", "rank")
    return ranked.where(F.col("rank") <= most).select("o_orderkey")


# --- recommendation ---------------------------------------------------------------------------------


@query(f"WITH {IN} SELECT * FROM dd")
def prep_dedupe(spark, d):
    return recsys.dedupe_interactions(interactions(spark, d)).select("User", "Item", "Score", "Tag")


def _split(spark, d, once=lambda df: df):
    """Interactions, and those of train and test users; ``once`` stores what several consumers read."""
    x = once(recsys.dedupe_interactions(interactions(spark, d)))
    users = x.select("User").distinct()
    return x, *recsys.split_users(x, users.where("User % 4 <> 0"), users.where("User % 4 = 0"))


@query(f"""WITH {IN}, u AS (SELECT DISTINCT "User", CASE WHEN "User" % 4 <> 0 THEN 'train' ELSE 'test' END AS split FROM dd)
SELECT "User", (row_number() OVER (ORDER BY split DESC, "User"::VARCHAR) - 1)::INT AS qid, split FROM u""")
def prep_qids(spark, d):
    _, train, test = _split(spark, d)
    return recsys.assign_qids(train, test)


@query(f"""WITH {IN}, a AS (SELECT * FROM dd WHERE "User" % 4 <> 0), b AS (SELECT * FROM dd WHERE "User" % 4 = 0)
SELECT (SELECT count(DISTINCT "User") FROM a) AS train_users, (SELECT count(*) FROM a) AS train_rows, (SELECT count(DISTINCT "User") FROM b) AS test_users, (SELECT count(*) FROM b) AS test_rows,
(SELECT count(*) FROM ca) AS catalog_size, (SELECT count(DISTINCT "Tag") FROM ca) AS tags, (SELECT count(*) FROM ia) - (SELECT count(*) FROM dd) AS dropped""")
def prep_report(spark, d):
    _, train, test = _split(spark, d)
    at = recsys.prep_report(interactions(spark, d), train, test, catalog(spark, d))
    return at.select("train_users", "train_rows", "test_users", "test_rows", "catalog_size", F.size("tag_vocab").cast("long").alias("tags"), "dropped")


@query(f'WITH {IN} SELECT DISTINCT "Item" FROM dd WHERE "Item" NOT IN (SELECT "Item" FROM ca WHERE feat_pop >= 3.2)')
def prep_coverage(spark, d):
    return recsys.not_in_catalog(recsys.dedupe_interactions(interactions(spark, d)), catalog(spark, d).where("feat_pop >= 3.2"))


_N = 40
_RECALL = IN + f""", us AS (SELECT * FROM dd WHERE "User" % 4 <> 0), tp AS (SELECT "User", "Tag", sum("Score") AS pref FROM us GROUP BY 1, 2),
tr AS (SELECT *, row_number() OVER (PARTITION BY "User" ORDER BY pref DESC, "Tag") AS tk FROM tp),
al AS (SELECT "User", ca."Item", ca."Tag", feat_pop, feat_quality, 0.5 * pref + 0.3 * feat_pop + 0.2 * feat_quality AS rs, 0 AS src, tk FROM tr JOIN ca USING ("Tag")
  UNION ALL SELECT u."User", ca."Item", ca."Tag", feat_pop, feat_quality, 0.3 * feat_pop + 0.2 * feat_quality, 1, 0 FROM (SELECT DISTINCT "User" FROM us) u, ca),
un AS (SELECT *, row_number() OVER (PARTITION BY "User", "Item" ORDER BY src, tk) AS k FROM al),
rc AS (SELECT *, row_number() OVER (PARTITION BY "User" ORDER BY src, tk, feat_pop DESC, "Item") AS position FROM un WHERE k = 1),
re AS (SELECT "User", "Item", "Tag", round(rs, 6) AS recall_score, position::INT AS position FROM rc WHERE position <= {_N})"""


def _recalled(spark, d):
    _, train, _ = _split(spark, d, stored)
    return train, recsys.recall(train, stored(catalog(spark, d)), _N)


@query(f"WITH {_RECALL} SELECT * FROM re")
def recall_items(spark, d):
    return _recalled(spark, d)[1].select("User", "Item", "Tag", _r("recall_score").alias("recall_score"), "position")


@query(f"""WITH {_RECALL}, bad AS (SELECT "User", "Item" FROM re WHERE NOT ("User" % 10 = 1 AND position = 1) UNION ALL SELECT "User", "Item" FROM re WHERE "User" % 10 IN (2, 3) AND position = 2),
ok AS (SELECT "User", "Item" FROM bad WHERE NOT ("User" % 10 = 3 AND "Item" IN (SELECT "Item" FROM re r WHERE r."User" = bad."User" AND r.position = 5)))
SELECT "User", count(*) AS "rows", count(DISTINCT "Item") AS items FROM ok GROUP BY 1 HAVING count(*) <> {_N} OR count(DISTINCT "Item") <> {_N}""")
def recall_validate(spark, d):
    """Faults are planted: users who lack a row, have one twice, or have one twice in place of another."""
    found = _recalled(spark, d)[1]
    bad = found.where("NOT (User % 10 = 1 AND position = 1)").where("NOT (User % 10 = 3 AND position = 5)").unionByName(found.where("User % 10 IN (2, 3) AND position = 2"))
    return recsys.validate_recall(bad, _N)


_RANK = _RECALL + """, qi AS (SELECT "User", (row_number() OVER (ORDER BY "User"::VARCHAR) - 1)::INT AS qid FROM (SELECT DISTINCT "User" FROM us)),
ra AS (SELECT qid, "User", "Item", "Tag", recall_score, position, coalesce(s."Score", 0.0) AS label FROM re JOIN qi USING ("User") LEFT JOIN (SELECT "User", "Item", max("Score") AS "Score" FROM us GROUP BY 1, 2) s USING ("User", "Item"))"""


def _ranking(spark, d):
    _, train, test = _split(spark, d, stored)
    return train, recsys.to_ranking(recsys.recall(train, stored(catalog(spark, d)), _N), train, recsys.assign_qids(train, test))


@query(f'WITH {_RANK} SELECT qid, "User", "Item", recall_score, label FROM ra')
def ranking_rows(spark, d):
    return _ranking(spark, d)[1].select("qid", "User", "Item", _r("recall_score").alias("recall_score"), "label")


_DEAL = _RANK + """, sc AS (SELECT "User", "Item", "Tag", round((("Item" * 7919 + "User" * 31) % 1009) / 100.0, 4)::DOUBLE AS "Score" FROM ra),
rx AS (SELECT DISTINCT "User", "Item" FROM us WHERE "Item" % 3 = 0),
fr AS (SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM rx WHERE rx."User" = sc."User" AND rx."Item" = sc."Item")),
a1 AS (SELECT *, row_number() OVER (PARTITION BY "User" ORDER BY "Score" DESC, "Item") AS r, row_number() OVER (PARTITION BY "User", "Tag" ORDER BY "Score" DESC, "Item") <= 2 AS ok FROM fr),
a2 AS (SELECT *, sum(ok::INT) OVER (PARTITION BY "User" ORDER BY r) AS upto, sum(ok::INT) OVER (PARTITION BY "User") AS acc, min(CASE WHEN NOT ok THEN r END) OVER (PARTITION BY "User") AS spare FROM a1),
dk AS (SELECT "User", "Item", "Tag", "Score", (CASE WHEN ok THEN upto ELSE acc + 1 END)::INT AS rank FROM a2 WHERE (ok AND upto <= 10) OR (acc < 10 AND NOT ok AND r = spare))"""


def _dealt(spark, d):
    train, rows = _ranking(spark, d)
    scored = rows.select("User", "Item", "Tag", F.round((F.col("Item") * 7919 + F.col("User") * 31) % 1009 / 100.0, 4).alias("Score"))
    recent = train.where("Item % 3 = 0")
    return recent, recsys.deal(scored, recent, 10, 2)


@query(f"WITH {_DEAL} SELECT * FROM dk")
def deal_decks(spark, d):
    return _dealt(spark, d)[1][0]


@query(f"""WITH {_DEAL}, c AS (SELECT "User", count(*) AS input_candidates FROM sc GROUP BY 1), g AS (SELECT "User", count(*) AS after_dedup, sum((NOT ok AND upto < 10)::INT)::BIGINT AS dropped_tag FROM a2 GROUP BY 1), k AS (SELECT "User", count(*) AS n, max((rank > acc)::INT) AS ov FROM dk JOIN (SELECT DISTINCT "User", acc FROM a2) USING ("User") GROUP BY 1)
SELECT c."User", input_candidates, coalesce(after_dedup, 0) AS after_dedup, coalesce(n, 0) AS after_tag_filter, input_candidates - coalesce(after_dedup, 0) AS dropped_recent, coalesce(dropped_tag, 0) AS dropped_tag, coalesce(ov, 0) = 1 AS overflow FROM c LEFT JOIN g USING ("User") LEFT JOIN k USING ("User")""")
def deal_log(spark, d):
    return _dealt(spark, d)[1][1]


@query(f"""WITH {_DEAL}, bd AS (SELECT "User", "Item", CASE WHEN "User" % 10 = 1 THEN 'one' ELSE "Tag" END AS "Tag" FROM dk UNION ALL SELECT "User", "Item", "Tag" FROM dk WHERE "User" % 10 = 2 AND rank = 1
 UNION ALL SELECT "User", min("Item"), 'recent' FROM rx WHERE "User" % 10 = 3 GROUP BY 1 UNION ALL SELECT "User", -rank, 'more' || rank FROM dk WHERE "User" % 10 = 5 AND rank <= 2),
sz AS (SELECT "User", count(*) AS n, count(DISTINCT "Item") AS items FROM bd GROUP BY 1)
SELECT "User", 'too many' AS problem FROM sz WHERE n > 10 UNION SELECT "User", 'repeated item' FROM sz WHERE n <> items
UNION SELECT "User", 'recent item' FROM bd JOIN rx USING ("User", "Item") UNION SELECT "User", 'too many of a tag' FROM (SELECT "User", "Tag" FROM bd GROUP BY 1, 2 HAVING count(*) > 3)""")
def deal_validate(spark, d):
    """Faults of every kind are planted in some users' decks."""
    recent, (decks, _) = _dealt(spark, d)
    rows = decks.select("User", "Item", F.when(F.col("User") % 10 == 1, F.lit("one")).otherwise(F.col("Tag")).alias("Tag"))
    twice = decks.where("User % 10 = 2 AND rank = 1").select("User", "Item", "Tag")
    again = recent.where("User % 10 = 3").groupBy("User").agg(F.min("Item").alias("Item")).withColumn("Tag", F.lit("recent"))
    more = decks.where("User % 10 = 5 AND rank <= 2").selectExpr("User", "-rank AS Item", "concat('more', rank) AS Tag")
    return recsys.validate_deal(rows.unionByName(twice).unionByName(again).unionByName(more), recent, 10, 2)


@query()
def recommend_end_to_end(spark, d):
    """Prepare, recall, convert, train a ranker, deal: decks of the test users."""
    items = _t(spark, d, "part").select(F.col("p_partkey").alias("Item"), F.col("p_brand").alias("Tag"))
    decks, _, _ = recsys.run_pipeline(interactions(spark, d), items, F.col("User") % 4 != 0, n=_N, rounds=2)
    return decks.select("User", "Item", "Tag", _r("Score").alias("Score"), "rank")


def _ndcg_of(order: str, to: str) -> str:
    return f"""{to}_r AS (SELECT qid, 2 ** label - 1 AS g, row_number() OVER (PARTITION BY qid ORDER BY {order} DESC, "Item") AS r, row_number() OVER (PARTITION BY qid ORDER BY label DESC, "Item") AS i FROM rp),
{to}_q AS (SELECT qid, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS best FROM {to}_r GROUP BY 1),
{to} AS (SELECT avg(CASE WHEN best > 0 THEN dcg / best ELSE 0 END) AS v FROM {to}_q)"""


@query(f"""WITH {_RANK}, rp AS (SELECT ra.*, feat_pop FROM ra JOIN ca USING ("Item")), {_ndcg_of("recall_score", "o")}, {_ndcg_of("feat_pop", "p")}
SELECT 'ndcg@10' AS metric, round(o.v, 6) AS value, round(p.v, 6) AS baseline, round(o.v - p.v, 6) AS difference, o.v - p.v >= -0.1 AS within FROM o, p""")
def recommend_against_popularity(spark, d):
    """NDCG of the recall order against that of popularity alone."""
    rows = stored(_ranking(spark, d)[1].withColumn("recall_score", _r("recall_score")))
    value = lambda c: float(metrics.evaluate(rows, "ndcg@10", "label", c, "qid", "Item").first()["value"])
    found = recsys.against_baseline(spark, {"ndcg@10": value("recall_score")}, {"ndcg@10": value("feat_pop")}, 0.1)
    return found.select("metric", *[_r(c).alias(c) for c in ("value", "baseline", "difference")], "within")


@query(f'WITH {_RANK} SELECT "User", "Item", recall_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY "User" ORDER BY recall_score DESC, "Item")::INT AS rank FROM re) WHERE rank <= 5')
def recommend_top_k(spark, d):
    rows = _recalled(spark, d)[1].withColumn("recall_score", _r("recall_score"))
    return recsys.top_k(rows, "User", "recall_score", "Item", 5).select("User", "Item", "recall_score", "rank")


@query(f"""WITH {IN}, act AS (SELECT "User" FROM ia GROUP BY 1 HAVING count(*) >= 12) SELECT "User", "Item", feat_pop, feat_quality, max("Score") AS label FROM ia JOIN act USING ("User") JOIN ca USING ("Item") GROUP BY ALL""")
def item_features(spark, d):
    x = interactions(spark, d)
    at = x.join(recsys.active_users(x), "User").join(catalog(spark, d).drop("Tag"), "Item")
    return at.groupBy("User", "Item", "feat_pop", "feat_quality").agg(F.max("Score").alias("label"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_value(spark, sf_dir)


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(S)

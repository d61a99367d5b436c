"""Recommendation pipeline: prepare, recall, convert for ranking, deal.

Tables in, tables out. Interactions are (User, Item, Score, Tag); a catalog is
(Item, Tag, feat_*). Every order that decides something ends in an id, so
results do not depend on how rows were dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import in_blocks

# --- prepare -------------------------------------------------------------------


def dedupe_interactions(interactions: DataFrame) -> DataFrame:
    """One row a (User, Item): the largest score, then the first tag."""
    return interactions.groupBy("User", "Item").agg(F.max("Score").alias("Score"), F.min_by("Tag", F.struct(-F.col("Score"), "Tag")).alias("Tag"))


def split_users(interactions: DataFrame, train_users: DataFrame, test_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    return interactions.join(train_users.select("User"), "User", "left_semi"), interactions.join(test_users.select("User"), "User", "left_semi")


def assign_qids(train: DataFrame, test: DataFrame) -> DataFrame:
    """(User, qid, split): numbers from 0 in order of user, train before test.

    Counts by range partition, then numbers within: no task orders all users.
    """
    users = train.select("User", F.lit("train").alias("split")).unionByName(test.select("User", F.lit("test").alias("split"))).distinct()
    ranged = in_blocks(users.withColumn("_o", F.concat(F.when(F.col("split") == "train", "0").otherwise("1"), F.col("User").cast("string"))), F.col("_o"))
    sizes = ranged.groupBy("_block").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("_block", F.coalesce(F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    number = F.row_number().over(Window.partitionBy("_block").orderBy("_o")) - 1
    return ranged.withColumn("_n", number).join(F.broadcast(ahead), "_block").select("User", (F.col("_n") + F.col("ahead")).cast("int").alias("qid"), "split")


def prep_report(raw: DataFrame, train: DataFrame, test: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of counts; ``dropped`` is how many rows deduplication removed of those split."""
    part = lambda df, name, user=True: df.select(F.lit(name).alias("p"), (F.col("User") if user else F.lit(None)).cast("string").alias("u"), (F.lit(None) if user else F.col("Tag")).cast("string").alias("t"))
    rows = part(raw, "raw").unionByName(part(train, "train")).unionByName(part(test, "test")).unionByName(part(catalog, "catalog", False))
    of = lambda name, x: F.when(F.col("p") == name, x)
    counts = [x for n in ("train", "test") for x in (F.countDistinct(of(n, F.col("u"))).alias(f"{n}_users"), F.count(of(n, F.lit(1))).alias(f"{n}_rows"))]
    out = rows.agg(*counts, F.count(of("catalog", F.lit(1))).alias("catalog_size"), F.sort_array(F.collect_set("t")).alias("tag_vocab"), F.count(of("raw", F.lit(1))).alias("raw_rows"))
    return out.withColumn("dropped", F.col("raw_rows") - F.col("train_rows") - F.col("test_rows")).drop("raw_rows")


def not_in_catalog(interactions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Items without a catalog row; empty if the catalog covers all."""
    return interactions.select("Item").distinct().join(catalog.select("Item"), "Item", "left_anti")


# --- recall ----------------------------------------------------------------------


def tag_preferences(interactions: DataFrame) -> DataFrame:
    """(User, Tag, pref, tag_rank): tags by summed score."""
    sums = interactions.groupBy("User", "Tag").agg(F.sum("Score").alias("pref"))
    return sums.withColumn("tag_rank", F.row_number().over(Window.partitionBy("User").orderBy(F.col("pref").desc(), "Tag")))


def recall(interactions: DataFrame, catalog: DataFrame, n: int = 100) -> DataFrame:
    """Top ``n`` items a user: its tags' items in order of preference and popularity, then popular ones.

    A catalog has one row an item. A user needs at most ``n`` items of a tag, so
    a tag's items, best first, are one row of that many, which meets the user's
    tags until they make ``n``. What a user has is then an array of at most 2n
    items, in the partition that ranked its tags. Popular items fill up only
    what it lacks: of the ``n`` most popular, one row for all, those it has
    already are left out before any is unpacked.
    """
    pop = [F.col("feat_pop").desc(), F.col("Item").asc()]
    feats = [c for c in catalog.columns if c not in ("Item", "Tag")]
    score = 0.3 * F.col(feats[0]) + 0.2 * F.col(feats[1]) if len(feats) > 1 else 0.3 * F.col(feats[0])
    item = F.struct((-F.col("feat_pop")).alias("_o"), "Item", "Tag", score.alias("_score"), *feats)  # in the order of ``pop``
    best = catalog.withColumn("_in_tag", F.row_number().over(Window.partitionBy("Tag").orderBy(*pop))).where(F.col("_in_tag") <= n)
    pools = best.groupBy("Tag").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    popular = catalog.orderBy(*pop).limit(n).agg(F.sort_array(F.collect_list(item)).alias("_popular"))  # one row

    wanted = tag_preferences(interactions).join(pools, "Tag", "left").withColumn("_size", F.coalesce(F.size("_items"), F.lit(0)))
    before = F.sum("_size").over(Window.partitionBy("User").orderBy("tag_rank").rowsBetween(Window.unboundedPreceding, -1))
    wanted = wanted.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < n) | (F.col("tag_rank") == 1))  # tags past the n-th item add nothing
    row = lambda x, value: F.struct(x["Item"].alias("Item"), x["Tag"].alias("Tag"), value.alias("recall_score"), *[x[f].alias(f) for f in feats])
    of_tag = F.transform(F.coalesce("_items", F.array().cast(dict(pools.dtypes)["_items"])), lambda x: row(x, 0.5 * F.col("pref") + x["_score"]))
    users = wanted.groupBy("User").agg(F.sort_array(F.collect_list(F.struct("tag_rank", of_tag.alias("items")))).alias("_tags"))
    own = users.select("User", F.slice(F.flatten(F.col("_tags.items")), 1, n).alias("_own"))
    new = F.filter("_popular", lambda x: ~F.array_contains("_own.Item", x["Item"]))
    lacks = F.slice(F.transform(new, lambda x: row(x, x["_score"])), F.lit(1), F.lit(n) - F.size("_own"))
    whole = F.when(F.size("_own") < n, F.concat("_own", lacks)).otherwise(F.col("_own"))
    filled = own.crossJoin(F.broadcast(popular)).select("User", F.posexplode(whole).alias("_i", "x"))  # a row of n items
    return filled.select("User", *[f"x.{c}" for c in ("Item", "Tag", "recall_score", *feats)], (F.col("_i") + 1).alias("position"))


def validate_recall(recalled: DataFrame, n: int) -> DataFrame:
    """Users whose rows aren't n different items; empty if all are right."""
    return recalled.groupBy("User").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("Item").alias("items")).where((F.col("rows") != n) | (F.col("items") != n))


# --- convert ------------------------------------------------------------------------


def to_ranking(recalled: DataFrame, interactions: DataFrame, qids: DataFrame) -> DataFrame:
    """Recalled rows with qid and label: the largest interaction score, 0 without one."""
    labels = interactions.groupBy("User", "Item").agg(F.max("Score").alias("_score"))
    at = recalled.join(qids.select("User", "qid", "split"), "User").join(labels, ["User", "Item"], "left")
    return at.withColumn("label", F.coalesce("_score", F.lit(0.0))).drop("_score")


def missing_qids(recalled: DataFrame, qids: DataFrame) -> DataFrame:
    return recalled.select("User").distinct().join(qids, "User", "left_anti")


# --- train the ranker ------------------------------------------------------------------


def train_ranker(train: DataFrame, test: DataFrame, features: list[str], rounds: int = 25, k: int = 10, seed: int = 42):
    """(model, scored, report): LambdaMART on the training rows, the test rows with Score, and one row of NDCG@k of both."""
    from ..functions import metrics, objectives
    from ..plans import boosting
    from . import scoring

    columns = boosting.Columns(features, group="qid", row_id="Item")
    config = boosting.Params("rank:ndcg", rounds=rounds, max_depth=4, eta=0.1, lam=1.0, method="hist", metric=f"ndcg@{k}", seed=seed, rank=objectives.RankConfig(ndcg_k=k))
    model, _ = boosting.train(train, config, columns)
    score = lambda df: scoring.predict(df, model, features, "margin", to="Score")
    scored = score(test)
    value = lambda df, name: metrics.evaluate(df, f"ndcg@{k}", "label", "Score", "qid", "Item").select(F.col("value").alias(name))
    report = value(score(train), "train_ndcg").crossJoin(value(scored, "test_ndcg"))  # a row each
    return model, scored, report.withColumns({"ndcg_k": F.lit(k), "rounds": F.lit(rounds), "objective": F.lit("rank:ndcg")})


def against_baseline(spark, values: dict[str, float], baseline: dict[str, float], tolerance: float) -> DataFrame:
    """(metric, value, baseline, difference, within): metrics of a model beside those published for another."""
    rows = [(m, float(v), float(baseline[m]), float(v) - float(baseline[m]), float(v) - float(baseline[m]) >= -tolerance) for m, v in values.items() if m in baseline]
    return spark.createDataFrame(rows, "metric string, value double, baseline double, difference double, within boolean")


def run_pipeline(interactions: DataFrame, items: DataFrame, is_train: Column, n: int = 100, rounds: int = 25, k: int = 10, deck: int = 10, max_tag: int = 3, recent: DataFrame | None = None):
    """Prepare, recall, convert, train, deal: (decks of the test users, log, report). ``recent`` rows (User, Item) are not dealt."""
    from ..functions.storage import stored

    clean = stored(dedupe_interactions(interactions))
    catalog = stored(catalog_features(interactions, items))
    users = clean.select("User").distinct()
    train, test = split_users(clean, users.where(is_train), users.where(~is_train))
    rows = stored(to_ranking(recall(clean, catalog, n), clean, assign_qids(train, test)))
    features = ["recall_score", *[c for c in catalog.columns if c.startswith("feat_")]]
    _, scored, report = train_ranker(rows.where("split = 'train'"), rows.where("split = 'test'"), features, rounds, k)
    decks, log = deal(scored, test.where(F.lit(False)) if recent is None else recent, deck, max_tag)
    return decks, log, report


# --- deal -----------------------------------------------------------------------------


def deal(scored: DataFrame, recent: DataFrame, deck: int = 10, max_tag: int = 3) -> tuple[DataFrame, DataFrame]:
    """Decks (User, Item, Tag, Score, rank) and a log a user.

    Best first, without recent items, at most ``max_tag`` of a tag. A deck that
    stays short gets one more row: the best one left.
    """
    fresh = scored.join(recent.select("User", "Item").distinct(), ["User", "Item"], "left_anti")
    by_score = [F.col("Score").desc(), "Item"]
    user = Window.partitionBy("User").orderBy(*by_score)
    at = fresh.select("User", "Item", "Tag", "Score", F.row_number().over(user).alias("_r"), (F.row_number().over(Window.partitionBy("User", "Tag").orderBy(*by_score)) <= max_tag).alias("_ok"))
    upto = F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(Window.partitionBy("User").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("User")
    at = at.withColumns({"_upto": upto, "_accepted": F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(whole), "_spare": F.min(F.when(~F.col("_ok"), F.col("_r"))).over(whole)})
    taken = F.col("_ok") & (F.col("_upto") <= deck)
    extra = (F.col("_accepted") < deck) & ~F.col("_ok") & (F.col("_r") == F.col("_spare"))
    rank = F.when(taken, F.col("_upto")).otherwise(F.col("_accepted") + 1).cast("int")
    decks = at.where(taken | extra).select("User", "Item", "Tag", "Score", rank.alias("rank"))
    # A rejection counts for its tag while the deck is not full yet.
    log = at.groupBy("User").agg(
        F.count(F.lit(1)).alias("after_dedup"),
        F.sum(F.when(taken | extra, 1).otherwise(0)).alias("after_tag_filter"),
        F.sum(F.when(~F.col("_ok") & (F.col("_upto") < deck), 1).otherwise(0)).alias("dropped_tag"),
        F.max(extra).alias("overflow"),
    )
    counts = scored.groupBy("User").agg(F.count(F.lit(1)).alias("input_candidates"))
    log = counts.join(log, "User", "left").na.fill(0, ["after_dedup", "after_tag_filter", "dropped_tag"]).na.fill(False, ["overflow"])
    return decks, log.select("User", "input_candidates", "after_dedup", "after_tag_filter", (F.col("input_candidates") - F.col("after_dedup")).alias("dropped_recent"), "dropped_tag", "overflow")


def validate_deal(decks: DataFrame, recent: DataFrame, deck: int, max_tag: int) -> DataFrame:
    """(User, problem) rows; empty if every deck is right."""
    size = decks.groupBy("User").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Item").alias("items"))
    problems = size.where(F.col("n") > deck).select("User", F.lit("too many").alias("problem")).unionByName(size.where("n <> items").select("User", F.lit("repeated item").alias("problem")))
    again = decks.join(recent.select("User", "Item").distinct(), ["User", "Item"], "left_semi").select("User", F.lit("recent item").alias("problem"))
    tags = decks.groupBy("User", "Tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_tag + 1).select("User", F.lit("too many of a tag").alias("problem"))
    return problems.unionByName(again).unionByName(tags).distinct()


# --- shared ------------------------------------------------------------------------------


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with their rank; a ranked filter that runs before its shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie))).where(F.col("rank") <= k)


def catalog_features(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """(Item, Tag, feat_pop = ln(1 + count), feat_quality = mean score) of every item."""
    stats = interactions.groupBy("Item").agg(F.count(F.lit(1)).alias("n"), F.avg("Score").alias("m"))
    return items.join(stats, "Item", "left").select("Item", "Tag", F.log1p(F.coalesce("n", F.lit(0))).alias("feat_pop"), F.coalesce("m", F.lit(0.0)).alias("feat_quality"))


def active_users(interactions: DataFrame, at_least: int = 12) -> DataFrame:
    return interactions.groupBy("User").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least).select("User")


def hash_order(key: Column, seed: int) -> Column:
    """A stable pseudo-random order of keys, the same in any SQL engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))

"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from silvatrix import queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the tables are not here")


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0).removesuffix(".0")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_results_do_not_depend_on_partitioning(spark, parts):
    from pyspark.sql import functions as F

    from silvatrix.functions import metrics

    df = queries.scored_orders(spark, D).repartition(parts)
    assert metrics.evaluate(df, "auc", "label", "p").first()[0] == pytest.approx(metrics.evaluate(queries.scored_orders(spark, D), "auc", "label", "p").first()[0])
    assert df.agg(F.count("*")).first()[0] == queries.scored_orders(spark, D).count()


def test_row_sample_has_no_global_limit(spark):
    plan = queries.row_sample(spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan

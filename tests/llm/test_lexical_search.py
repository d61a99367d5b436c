"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from silvatrix.llm import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, items, k):
    docs = [(i, Counter(w)) for i, t in rows if (w := terms(t))]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(odd_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "x1"]
    draw = lambda n: " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=n))
    rows = odd_rows + [(100 + i, draw(rng.randrange(1, 60))) for i in range(900)] + [(5000 + i, "w1, w2; W3\x00w4 naïve") for i in range(150)]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(25)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "twice word é"), (53, "w3 w4"), (None, "w7 日本")]
    return rows, items


ITEMS = "item_id long, text string, doc_id long, score string"


@pytest.mark.parametrize("most_terms", [50_000, 40])
def test_ranks(spark, make_docs, odd_rows, monkeypatch, most_terms):
    """Whole, and with queries in several blocks; blocks and segments are small, so most are skipped."""
    monkeypatch.setattr(lexical_search, "BLOCK", 8)
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 64)
    rows, items = corpus(odd_rows)
    table = spark.createDataFrame([(i, t, None, "x") for i, t in items], ITEMS)
    got = lexical_search.rank_documents(make_docs(rows), table, 10, most_terms=most_terms)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr) == plain(rows, items, 10)


def test_blocks_below_the_threshold_stay_compressed(monkeypatch):
    """The best documents first: of what follows hardly a block is read."""
    rng = random.Random(1)
    best = [("a b c d " * 5).encode()] * 10
    rest = [" ".join(rng.choice("abcd") if k == 0 else f"z{rng.randrange(50)}" for k in range(30)).encode() for _ in range(5000)]
    held = {"ids": [], "n": [], "terms": {}, "parts": ([], [], [])}
    for i, t in enumerate(best + rest):
        c = Counter(lexical_search.terms_of(t))
        held["ids"].append(i)
        held["n"].append(sum(c.values()))
        held["parts"][0].append(np.array([held["terms"].setdefault(x, len(held["terms"])) for x in c], np.int32))
        held["parts"][1].append(np.array(list(c.values())))
        held["parts"][2].append(len(c))
    rows = lexical_search._segment(0, held["ids"], held["n"], held["terms"], held["parts"]).to_pylist()
    seg = lexical_search._Segment(rows, 5010, sum(held["n"]))
    none = np.zeros(0, np.int64)
    query = [(t, 1000) for t in (b"a", b"b", b"c", b"d")]
    once = seg.search(query, (none, none.astype(np.uint8), none), 10)
    assert sorted(once[2].tolist()) == list(range(10))
    seg.decoded.clear()
    again = seg.search(query, once, 10)
    blocks = sum(len(v) for v in seg.lists.values() if v[0]["term"] in (b"a", b"b", b"c", b"d"))
    assert again[0][0] == once[0][0] and len(seg.decoded) <= 8 < blocks  # the best documents' own


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 300, 1 << 40):
        at, count = np.unique(rng.integers(0, top + 200, 128)), None
        count = rng.integers(1, top + 1, len(at))
        got = lexical_search.decode_block(lexical_search.encode_block(at, count), int(at[0]), len(at))
        assert (got[0] == at).all() and (got[1] == count).all()


def test_impacts_bound_a_block():
    rng = np.random.default_rng(2)
    c, n = rng.integers(1, 9, 128), rng.integers(9, 500, 128)
    pairs = lexical_search.impacts_of(c, n)
    assert lexical_search.factor(pairs[0], lexical_search.norm(pairs[1], 10, 300)).max() == lexical_search.factor(c, lexical_search.norm(n, 10, 300)).max()
    assert (np.diff(pairs[0]) < 0).all() and (np.diff(pairs[1]) < 0).all()


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", None, "x")], ITEMS)
    assert lexical_search.rank_documents(make_docs([(1, "a")]), none).count() == 0
    assert lexical_search.rank_documents(make_docs([]), some).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from silvatrix.llm import queries

    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = duckdb.sql(f"SELECT * FROM ({lexical_search.SQL}) ORDER BY 1, 2").fetchall()
    got = [tuple(r) for r in queries.op11_lexical_search(spark, d).select("item_id", "rank", "doc_id", "score").orderBy("item_id", "rank").collect()]
    assert got == want and want

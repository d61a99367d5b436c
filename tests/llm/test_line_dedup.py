"""Line deduplication against brute force."""

import hashlib
import random

import pytest

from silvatrix.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is None, i or 0)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def table(odd_rows):
    rng = random.Random(3)
    common = ["  The Same Line Again ", "the same line again", "THE SAME LINE AGAIN\t", "short", "éééééééééé", "ééééééééé", "É same line again", "a\x0bb    c d e", ""]
    rows = odd_rows + [(100 + k, "\n".join(rng.choice(common + [f"line of its own {rng.randrange(400)}"]) for _ in range(rng.randrange(12)))) for k in range(200)]
    return rows + [(None, "the same line again\nlast of all lines"), (None, "last of all lines"), (9000, "only here twice\nonly here twice"), (9001, "crlf line end\r\nx"), (9002, "crlf line end")]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_lines(make_docs, odd_rows, most):
    """With the repeated keys sent to the tasks, and with them met in a join."""
    rows = table(odd_rows)
    got = line_dedup.dedup_lines(make_docs(rows), max_keys=most)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_filters_in_parts(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE_WORDS", 2)
    rows = table(odd_rows)
    got = line_dedup.dedup_lines(make_docs(rows), max_filter_bytes=64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_only_possible_repeats_are_suspected(spark, make_docs):
    keys = line_dedup.key_hashes(make_docs([(i, f"a line that no other has {i}\nthat one and that\n{i // 2} is twice there") for i in range(20_000)]))
    twice = line_dedup.twice_seen(keys, 1 << 14)
    got = {r["k1"] for r in line_dedup.suspects(keys, twice).collect()}
    assert 10_001 <= len(got) < 11_500


def test_empty_table(make_docs):
    assert line_dedup.dedup_lines(make_docs([])).count() == 0


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    from silvatrix.llm import queries

    d = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in queries.op13_line_dedup(spark, d).select("doc_id", "n_lines", "n_dropped", "kept_sha256").orderBy("doc_id").collect()]
    assert got == want and hashlib.sha256(b"").hexdigest() not in {x[3] for x in want if x[2] == 0 and x[1] > 1}

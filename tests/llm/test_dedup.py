"""Exact, near and suffix deduplication against brute force."""

import hashlib
import random
import re

import pytest
import xxhash

from silvatrix.llm import exact_dedup, simhash, suffix_dedup
from silvatrix.llm.components import connected_components
from silvatrix.llm.suffix_sort import deep_shallow_sort


def exact_plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [{}, {"max_filter_bytes": 0}, {"max_filter_bytes": 0, "max_bitmap_bytes": 0}])
def test_exact(spark, make_docs, odd_rows, most, tmp_path):
    """With the filter broadcast, met in a shuffle, and with a group of bitmaps a file."""
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, rng.choice(["a b", "a  b", "a\tb", f"t{i % 40}"])) for i in range(300)]
    plain = exact_plain(rows)
    got = exact_dedup.exact_dedup(make_docs(rows), **most).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got), key=repr) == plain
    make_docs(rows).repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs, stored in ((spark.read.parquet(str(tmp_path / "docs")), True), (make_docs(rows), True), (make_docs(rows), False))[: 1 if len(most) == 2 else 3]:
        kept = exact_dedup.keep_first_copies(docs, **most, stored=stored)
        assert kept.columns == make_docs(rows).columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((x[0] for x in plain if x[3]), key=repr)


def test_no_text_is_in_a_shuffle(spark, make_docs, tmp_path):
    """Whole rows are neither exchanged nor sorted, with a filter of any size."""
    make_docs([(i, f"text {i % 900}") for i in range(1000)]).write.parquet(str(tmp_path / "docs"))
    for most in (8 << 20, 0):
        kept = exact_dedup.keep_first_copies(spark.read.parquet(str(tmp_path / "docs")), max_filter_bytes=most, stored=True)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan and kept.count() == 900


def test_filter_grows_with_the_rows():
    for rows in (0, 1, 10**4, 10**7, 10**10):
        slots = exact_dedup._filter_blocks(rows) * exact_dedup.BLOCK_BITS
        assert 16 * rows <= slots <= max(32 * rows, exact_dedup.BLOCK_BITS)


def test_only_possible_repeats_are_grouped(spark, make_docs):
    """Of texts that all differ, the filter lets pass all but a few, broadcast or not."""
    rows = exact_dedup._hashes(make_docs([(i, f"text {i}") for i in range(20_000)]), "doc_id", "text")
    for most in (8 << 20, 0):
        probed = exact_dedup._probed(rows, most, 64 << 20)
        assert probed.where("_sv_maybe").count() < 600 and probed.count() == 20_000


def test_a_crowded_filter_still_gives_whole_results(make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_filter_blocks", lambda rows: 1)  # 32768 slots for 9000 rows
    got = exact_dedup.exact_dedup(make_docs([(i, f"t{i % 7000}") for i in range(9000)]))
    assert got.where("kept").count() == 7000


def test_empty_tables(make_docs):
    none = make_docs([])
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_first_copies(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0 and suffix_dedup.remove_repeats(none).count() == 0


def fingerprint_plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_plain(rows, distance=3):
    prints = [fingerprint_plain(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None]
        out.append((k, prints[i], min(ids, default=None)))
    return sorted(out, key=repr)


def test_simhash(make_docs, odd_rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(260)] for _ in range(8)]
    rows = list(odd_rows)
    for i in range(60):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(words).upper()
        rows.append((50 + i, " ".join(text)))
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=repr) == components_plain(rows)
    kept = simhash.keep_one_of_each(make_docs(rows[9:]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({x[2] for x in components_plain(rows[9:])})


def test_links_lose_none(spark):
    rng = random.Random(3)
    points = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        points.add(p)
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            points.add(q)
    signed = lambda x: x - 2**64 if x >> 63 else x
    got = {(r["u"], r["v"]) for r in simhash.near_links(spark.createDataFrame([(signed(p),) for p in points], "fp long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in points for b in points if a < b and (a ^ b).bit_count() <= 3}
    assert got == want
    with pytest.raises(ValueError):
        simhash.near_links(spark.range(0).selectExpr("id AS fp"), 4)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["u"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def repeats_plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, large", [(20, 8192), (20, 2), (7, 8192), (2, 8192)])
def test_suffix_spans(make_docs, length, large):
    rng = random.Random(length + large)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(90))
    rows = [(1, None), (2, ""), (3, "short"), (None, "null id " * 3), (4, "same row " * 9), (4, "same row " * 9), (4, "same id, other text"), (5, "a" * 300), (6, "xy" * 200)]
    for i in range(40):
        t = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 160)))
        a = rng.randrange(60)
        rows.append((20 + i, t[:50] + passage[a : a + rng.randint(5, 60)] + t[50:] if rng.random() < 0.7 else t))
    got = suffix_dedup.repeated_spans(make_docs(rows), length=length, large=large).collect()
    have = sorted(((r["doc_id"], [(x["b"], x["e"]) for x in r["spans"]], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr)
    assert have == repeats_plain(rows, length)


def test_segments_of_a_long_text(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    rng = random.Random(9)
    long = "".join(rng.choice("abcd") for _ in range(900))
    rows = [(1, long + "".join(rng.choice("efgh") for _ in range(400)) + long[200:500]), (2, long[333:444])]
    portions = list(suffix_dedup._segments([t.encode() for _, t in rows], 30))
    assert sum(len(p) - 29 for portion in portions for _, _, p in portion) == sum(len(t) - 29 for _, t in rows)
    got = suffix_dedup.repeated_spans(make_docs(rows), length=30).collect()
    assert sorted(((r["doc_id"], [(x["b"], x["e"]) for x in r["spans"]], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=repr) == repeats_plain(rows, 30)


def test_cut_text_stays_text(make_docs):
    rows = [(1, "aé" * 40 + "end"), (2, "xé" + "aé" * 40), (3, None)]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(make_docs(rows), 21).collect()}
    assert out[3] is None and "\ufffd" not in out[1] + out[2] and out[1].endswith("end") and out[2].startswith("x")


def test_passages_of_enough_words(make_docs):
    """Only runs that hold the words go; the other setting tells them beside the removed bytes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short, solid = text(30), text(8), "x" * 60
    rows = [(i, f"{text(9)} {long} {text(9)} {short} {text(3)} {solid} {text(4)}") for i in range(3)] + [(9, text(40)), (10, None)]
    plain = {i: spans for i, spans, _ in repeats_plain(rows, 20)}
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(make_docs(rows), 20, 29).collect()}
    told = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(make_docs(rows), length=25, passage=(20, 29)).collect()}
    at_25 = {i: spans for i, spans, _ in repeats_plain(rows, 25)}
    for i, t in rows:
        data = (t or "").encode()
        enough = [(b, e) for b, e in plain[i] if len(re.findall(rb"\S+", data[b:e])) >= 29]
        assert [(x["b"], x["e"]) for x in told[i]["passages"]] == enough and len(enough) == (i < 3)
        assert [(x["b"], x["e"]) for x in told[i]["spans"]] == at_25[i]
        whole = [(b, e) for b, e in enough for b, e in [suffix_dedup._shrunk(data, b, e, True)]]
        assert out[i] == (None if t is None else "".join(t[a:b] for a, b in zip([0, *[e for _, e in whole]], [*[b for b, _ in whole], len(t)])))
    assert suffix_dedup._shrunk(b"ab cd ef gh", 1, 7, True) == (3, 6)


def test_clashing_names_pass(spark):
    """Columns named like the operators' own come back as they were."""
    rows = [(i, f"t{i % 3} " * 90, f"k{i}", f"h{i}", "c") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _sv_key string, _sv_h string, c0 string")
    kept = sorted(map(tuple, exact_dedup.keep_first_copies(docs).collect()))
    assert kept == rows[:3]
    assert sorted(map(tuple, simhash.keep_one_of_each(docs).collect())) == rows[:3]
    assert [r[2:] for r in sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()))] == [r[2:] for r in rows]


def test_sort_of_long_common_prefixes():
    buf = b"abcabcabcabcabcabcabcabcabcabcabcabcabcabcabd" * 3
    starts = list(range(len(buf)))
    order, lcp = deep_shallow_sort(buf, starts, [len(buf)] * len(buf))
    assert order == sorted(starts, key=lambda s: buf[s:])
    for k in range(1, len(order)):
        a, b = buf[order[k - 1] :], buf[order[k] :]
        assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

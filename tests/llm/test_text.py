"""Tokenising, packing, media, URLs and pages against libraries and plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from silvatrix.llm import bpe, html_extract, media, packing, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", "  a   b \n\n c", "x \n y", "\n", "a\x1cb c\x85d", "ΑΣΣ x İ", "<|endoftext|> hi", "a\xa0b  \xa0c", "don't I'LL 're 12345 ½²³ ﬀ", "日本語 テキスト", "e\u0301 x", "a\r\nb\r\n\r\nc\td",
    "!!'s x", "a" * 300, "\x00\x01 b", " lead", "trail ", "a \nb", "\nb", "a\n", "hello <|endoftext|> there", "A<|startoftext|>b<|endoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "e<|endoftext|>\u0301 x", "The quick brown fox\njumps over the lazy dog.", "word " * 5000, "twice", "twice",
]


@pytest.fixture
def docs(make_docs):
    return make_docs([*enumerate(TEXTS), (None, "null id")])


def test_bpe_as_the_library(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    sums = {r["doc_id"]: r for r in bpe.round_trip(docs).collect()}
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        want = lib.encode_ordinary(t or "")
        assert ids[i] == want, t
        assert sums[i]["n_tokens"] == len(want)
        assert sums[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert sums[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_replay_equals_merging_word_by_word():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 301, b"aa": 298, b"aaa": 297, b"cab": 302}
    table = bpe.MergeTable(ranks)
    words = [b"abc", b"aaaaa", b"cabcab", b"", b"abab", b"aabc"]
    assert bpe.replay_merges(table, words) == [bpe.merge_one(table, w) for w in words]


@pytest.mark.parametrize("common", [0, 700, 1 << 30])
def test_bpe_replay_by_arrays(monkeypatch, common):
    """Merges by arrays of positions and by single ones: the ids of each word merged by itself, in runs of a letter too."""
    monkeypatch.setattr(bpe, "_COMMON", common)
    table = bpe.MergeTable.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(3)
    words = [b"", b"\0", b"\0\0a", b"a" * 37, b" " * 50, b"-" * 41 + b"aab", b"ababababa", b"aabaabaabaab"]
    words += ["".join(rng.choice("aeinst \u00e9\u4e2d") for _ in range(rng.randint(1, 30))).encode() for _ in range(3000)]
    words += [bytes(rng.randrange(256) for _ in range(rng.randint(1, 20))) for _ in range(500)]
    assert bpe.packed_ids(table, []) == []
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.packed_ids(table, words)] == [bpe.merge_one(table, w) for w in words]


@pytest.mark.parametrize("common", [0, 1 << 30])
def test_bpe_replay_by_arrays_of_any_table(monkeypatch, common):
    """Tables that rank a later merge earlier than what it is made of."""
    monkeypatch.setattr(bpe, "_COMMON", common)
    rng = random.Random(9)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(14)}
        table = bpe.MergeTable({bytes([b]): b for b in range(256)} | dict(zip(sorted(tokens), rng.sample(range(256, 300), len(tokens)))))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(40)]
        assert bpe.replay_merges(table, words) == [bpe.merge_one(table, w) for w in words]


def test_bpe_chunks_are_cut_as_the_pattern_cuts():
    """Chunks only where single spaces and line ends stand between words, whatever else counts as white space."""
    tok = bpe.ByteTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    texts = ["", " ", "\n", "a\n", "\na", "a b\nc d", "a \nb", "a\n\nb", "a\u00a0b", "a\u2003b c", "a\x1cb", "a\x85b", "a\tb c"]
    texts += ["".join(rng.choice(["a", "B'", "s", " ", "\n", "1", "!", "\u3000", "\r"]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for text, ids in zip(texts, tok.encode_batch(texts)):
        assert ids.tolist() == [x for w in tok.find(text) for x in bpe.merge_one(tok.table, w.encode())]


@pytest.mark.parametrize("as_text", [False, True])
def test_pack(docs, as_text):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.encode_special_tokens = as_text
    rows = packing.pack(docs, keep_ids=True, special_as_text=as_text, remembered=7 if as_text else packing.REMEMBERED).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert len(r["ids"]) == r["length"] <= packing.SEQUENCE
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == want
        assert all(p["doc_tokens"] == len(want) for p in pieces)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= packing.SEQUENCE


def test_first_fit_decreasing_is_plain_first_fit():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = (b, 100 - room[b])
        room[b] -= sizes[i]
    assert [(b, o) for b, o in zip(bins, offsets)] == [want[i] for i in range(300)]


def test_media_round_trip(docs):
    store = media.store_payloads(docs)
    items = media.sequences(store, "doc_id").drop("row_key")
    got = {r["doc_id"]: r for r in media.resolve(items, media.store_features(store)).where("kind = 'media'").collect()}
    for i, t in [*enumerate(TEXTS), (None, "null id")]:
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == r["digest"] and r["caption"].endswith(f"{len(data)} bytes")
    assert got[len(TEXTS) - 1]["feature"] == got[len(TEXTS) - 2]["feature"]
    assert np.array_equal(media.from_png(media.to_png(bytes(range(64)) * 2)).ravel(), np.tile(np.arange(64), 2))
    with pytest.raises(ValueError):
        media.from_png(media.to_png(bytes(64))[:-20] + bytes(20))


def test_interleaving_keeps_order_and_captions(spark):
    page = '<h1>T</h1><p>one<figure><img src="sha256:AA"><figcaption>cap <b>x</b></figcaption></figure>two <img src="b.png" data-sha256="bb" alt="alt"> three<script>no()</script>'
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, "", "z")], "page_id long, html string, items string")
    store = spark.createDataFrame([("aa", 5)], "digest string, size int")
    rows = media.regroup(media.resolve(media.sequences(pages), store), ["page_id"]).collect()
    assert [r["page_id"] for r in rows] == [1]
    items = rows[0]["items"]
    assert [i["position"] for i in items] == list(range(6))
    assert [(i["text"], i["digest"], i["caption"], i["size"]) for i in items] == [("T", None, None, None), ("one", None, None, None), (None, "aa", "cap x", 5), ("two", None, None, None), (None, "bb", "alt", None), ("three", None, None, None)]


URLS = [
    (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("https://A.Example.ORG/es/x?q#f", ("a.example.org", "/es/x", "example.org/es/", "block")),
    ("http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")), ("http://example.org/en/2", ("example.org", "/en/2", "org/", "allow")), ("http://casino.org/", ("casino.org", "/", "org/", "allow")),
    ("http://notorg/x", ("notorg", "/x", None, "allow")), ("http://x.com/de/", ("x.com", "/de/", "com/de/", "block")), ("http://x.com", ("x.com", "", None, "allow")), ("http://x.net/Casino", ("x.net", "/Casino", None, "block")),
    ("http://occasinos.net/", ("occasinos.net", "/", None, "allow")), ("http://free.net/free", ("free.net", "/free", None, "allow")), ("http://free-pills.net/", ("free-pills.net", "/", None, "block")), ("a://b://c/d", ("b:", "//c/d", None, "allow")),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, (u, _) in enumerate(URLS)] + [(None, "http://x.net/", "h", "r")], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(URLS))] == [w for _, w in URLS]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_a_vocabulary_with_weights(spark):
    """Weights add up over distinct terms; strict wins over soft; long and repeated URLs; no terms at all."""
    terms = spark.createDataFrame([("Heavy", False, 2.0), ("light", None, None), ("half", False, 0.5), ("half", False, 0.25), ("bad", False, 0.1), ("bad", True, 0.1), ("", True, 1.0), (None, True, 1.0)], "term string, strict boolean, weight double")
    words = url_filter.vocabulary_of(terms)
    assert words == {"heavy": (False, 2.0), "light": (False, 1.0), "half": (False, 0.5), "bad": (True, 0.1)}
    with pytest.raises(ValueError):
        url_filter.vocabulary_of(terms, 3)
    urls = ["http://x.net/heavy", "http://x.net/light?half", "http://x.net/light/LIGHT", "http://x.net/bad", "http://x.net/badly", "http://x.net/" + "light/" * 50_000 + "half=1&heavy", None, "http://x.net/light,half;heavy"]
    rows = spark.createDataFrame([(i, u, 5.0) for i, u in enumerate(urls)] + [(0, urls[0], 5.0)], "page_id long, url string, soft_weight double")
    got = sorted((r["page_id"], r["verdict"]) for r in url_filter.filter_urls(rows, vocabulary=words).collect())
    want = ["block", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert got == sorted([*enumerate(want), (0, "block")])
    assert {r["verdict"] for r in url_filter.filter_urls(rows, vocabulary={}).collect()} == {"allow"}


def test_urls_as_sql(spark):
    import duckdb

    rows = [(i, u) for i, (u, _) in enumerate(URLS)]
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    cur = c.execute(url_filter.oracle())
    names = [x[0] for x in cur.description]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


PAGE = """<!doctype html><html><head><title>no</title><style>p</style><script>var t="</p>";</script></head><body class="menu-page"><header>site</header><nav><ul><li>menu<li>two</ul></nav>
<div class="cookie-notice">cookies</div><main><article><h1>Title &amp; more</h1><p><b>One   two<br><p>three<!-- no --></p><aside>side</aside><form><input>field</form><p hidden>no</p><ul><li>a<li>b</ul>
<table><tr><td>c<td>d</table><div class="promo">x</div></article><section id="comments"><p>reader</p></section></main><div class="adBanner">ad</div><footer>foot</footer>"""


def test_pages(spark):
    rows = [(1, "http://one.net/1", PAGE, "t"), (50, None, None, "t"), (51, "http://e.net/", "", "t"), (52, "http://e.net/", "plain <i>text", "t"), (53, "http://e.net/", "<p>" * 500 + "deep", "t")]
    rows += [(54, "http://e.net/", "<p>" + "long " * 50000, "t")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    assert got[1]["text"] == "Title & more One two three a b c d" and got[1]["n_chars"] == 34
    assert got[50]["text"] == got[51]["text"] == "" and got[52]["text"] == "plain text" and got[53]["text"] == "deep"
    assert got[54]["n_chars"] == 50000 * 5 - 1
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<main><h1>Title</h1><article><p>body</p></article></main>", "Title body"),
        ("<h1>Site</h1><main><header><h1>Title</h1></header><article><p>body</p></article></main>", "Title body"),
        ("<header><h1>Site</h1></header><article><p>body</p></article>", "body"),
        ("<h1>Site</h1><article><h1>Title</h1><p>body</p></article>", "Title body"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</p></article>", "Let x=2 be"),
        ("<article><section class='ad-hoc'><p>kept</p></section></article>", "kept"),
        ("<article><p class='notice-period'>kept</p></article>", "kept"),
        ("<article><p id='copyright'>kept</p></article>", "kept"),
        ("<article><h2 id='comments-on-law'>kept</h2></article>", "kept"),
        ("<article><div class='ad-banner-2'>x</div><div class='cookieNotice'>x</div><div id='site-footer'>x</div><div class='a sidebar'>x</div><div class='related-links'>x</div><p>kept</p></article>", "kept"),
    ],
)
def test_what_belongs_to_an_article(page, want):
    assert html_extract.join_text(*html_extract.read_page(page)) == want


def test_hostile_pages_take_linear_time():
    """Unclosed quotes, tags and scripts, ends without starts, and elements nested deep."""
    import time

    n = 30_000
    quotes = ["<a " + '"' * n, "<a " + "'\"" * n + ">x", "<a " + '="' * n, "<a " * n, "<!" * n, "<script " * n, "<script>" * n, "&" * n, "<p><button>" + "<span>" * n + "<div></div>" * n]
    deep = ["<div>" * n + "x" + "</div>" * n, "<div>" * 100 + "</b>" * n + "x", "<ul>" + "<span>" * n + "<li>" * n + "x"]
    for page in quotes + deep:
        began = time.process_time()
        text = html_extract.join_text(*html_extract.read_page(page))
        media.interleave(page)
        assert time.process_time() - began < 30, page[:40]
        assert page not in deep or text == "x"
    assert [i["caption"] for i in media.interleave("<figure><img src=sha256:aa><figcaption>" + "<b>" * n + "cap")] == ["cap"]


def main_text_plain(pages, share=0.5, least=10):
    """By the standard library's parser, for pages that close what they open: subtrees as source text, counted a host."""
    from collections import Counter
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.top = []
            self.open = [self.top]

        def handle_starttag(self, tag, attrs):
            self.open[-1].append([tag, dict(attrs).get("class", ""), []])
            self.open.append(self.open[-1][-1][2])

        def handle_endtag(self, tag):
            self.open.pop()

        def handle_data(self, data):
            self.open[-1].append(data)

    def below(items):
        for x in items:
            if not isinstance(x, str):
                yield repr(x)
                yield from below(x[2])

    def text(items, gone):
        return "".join(x if isinstance(x, str) else "" if repr(x) in gone else "\0" * (x[0] == "p") + text(x[2], gone) + "\0" * (x[0] == "p") for x in items)

    read = []
    for _, url, source in pages:
        r = Reader()
        r.feed(source)
        read.append((url.split("/")[2], r.top[0][2]))
    tidy = lambda t: " ".join(x for x in (" ".join(b.split()) for b in t.split("\0")) if x)
    distinct = {(h, tidy(text(items, ()))): set(below(items)) for h, items in read}
    hosts = Counter(h for h, _ in distinct)
    on = Counter((h, s) for (h, _), found in distinct.items() for s in found)
    gone = lambda h: {s for (g, s), n in on.items() if g == h and n >= least and n >= share * hosts[h]}
    return {i: tidy(text(items, gone(h))) for (i, _, _), (h, items) in zip(pages, read)}


def test_templates_against_a_plain_version(spark):
    """Recurring boxes and phrases, just on the share, above and below it, on hosts of several sizes."""
    import random

    rng = random.Random(5)
    pages = []
    for host, n in (("a.net", 40), ("b.net", 20), ("c.net", 9)):
        for i in range(n):
            parts = [f"<p>own {host} {i}</p>"]
            parts += [f"<p>all <b>see also</b> {rng.random()}</p>"]
            parts += ["<p>half</p>"] * (i < n // 2) + ["<p>less</p>"] * (i < n // 2 - 1) + ["<p class=box><i>box</i> of <i>the site</i></p>"] * (i % 4 > 0)
            rng.shuffle(parts)
            pages.append((len(pages), f"http://{host}/{i}", f"<article>{''.join(parts)}</article>"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == main_text_plain(pages)
    assert sum("half" in t for t in got.values()) == 4 and sum("less" in t for t in got.values()) == 19 + 9 + 3


def test_words_of_classes(spark):
    page = '<article><p class="popular">A <span class="related">b</span></p><div class="related">no</div><h2 class="skip">C</h2><p class="notice">no</p><ul class="share"><li>no</ul></article>'
    assert html_extract.join_text(*html_extract.read_page(page)) == "A b C"


def test_media_and_pages_without_rows(spark, make_docs):
    store = media.store_payloads(make_docs([]))
    assert media.resolve(media.sequences(store, "doc_id"), media.store_features(store)).count() == 0
    assert packing.pack(make_docs([])).count() == 0 and bpe.round_trip(make_docs([])).count() == 0


def test_repeated_rows_have_a_row_each(make_docs):
    docs = make_docs([(7, "same id and text")] * 3 + [(7, "same id")])
    store = media.store_payloads(docs)
    found = media.resolve(media.sequences(store, "doc_id"), media.store_features(store)).where("kind = 'media'").collect()
    assert len(found) == 4 and len({(r["payload_sha256"], r["feature"], r["caption"]) for r in found}) == 2
    assert packing.pack(docs).count() == 4 and bpe.round_trip(docs).count() == 4


def test_site_template_goes(spark):
    box = "<div class=box><p>Our site</p><p>since 1999</p></div>"
    rows = [(i, f"http://Host.net/{i}", f"<article><h1>t {i}</h1>{box if i < 11 else ''}<p>own {i}</p></article>") for i in range(12)]
    rows += [(100 + i, f"http://other.net/{i}", f"<article><p>o {i}</p>{box}</article>") for i in range(5)]  # too few pages to tell
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"t {i} own {i}" for i in range(12))
    assert all(got[100 + i] == f"o {i} Our site since 1999" for i in range(5))


def test_template_needs_many_pages(spark):
    pages = spark.createDataFrame([(i, "http://h.net/", f"<article><p>same</p><p>own {i}</p></article>") for i in range(9)], "page_id long, url string, html string")
    assert all(r["text"].startswith("same own") for r in html_extract.extract_main_text(pages).collect())


def test_copies_of_a_page_are_no_template(spark):
    """30 copies of one page on a host of 40, with another menu each; what all distinct pages bear still goes."""
    box = "<div class=box><p>Our site</p></div>"
    rows = [(i, f"http://h.net/{i}", f"<nav>{i}</nav><article><h1>hot</h1>{box}<p>first of the copies</p><p>second</p></article>") for i in range(30)]
    rows += [(100 + i, f"http://h.net/own/{i}", f"<article><h1>t {i}</h1>{box}<p>own {i}</p></article>") for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "hot first of the copies second" for i in range(30))
    assert all(got[100 + i] == f"t {i} own {i}" for i in range(10))


def test_full_sequences_are_in_no_group(make_docs):
    """A few long documents: a whole sequence stands alone, and groups hold rests only."""
    docs = make_docs([(i, "word " * (20 * packing.SEQUENCE + 5)) for i in range(4)] + [(9, "short")])
    rows = packing.pack(docs).collect()
    full = [r for r in rows if r["length"] == packing.SEQUENCE]
    rests = [r for r in rows if r["length"] < packing.SEQUENCE]
    assert len(full) == 80 and len(rests) == 5 and {r["offset"] for r in full} == {0}
    assert len({r["sequence_id"] for r in full}) == 80
    assert not {r["sequence_id"] >> 32 for r in full} & {r["sequence_id"] >> 32 for r in rests}

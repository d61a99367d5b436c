"""Divergence of sources: how a source's terms differ from its language's, and from other sources'.

Terms are runs of letters and of all beyond ASCII, A-Z lower-cased. A language
keeps the terms that ``min_docs`` of its documents hold, V of them. A group, a
source within a language, gives a kept term with ``count`` occurrences among the
N of all kept terms the share p = 1 + floor(10^9 (count + 5) / (N + 5 V)); so
does the language, q, with its own counts.

Counts are summed within tasks before they shuffle, once, by language and term:
a source's count, the language's, and whether enough documents hold the term all
come out of that one exchange.

* ``term``: the terms that a group has too often, by f = p - q. Within a batch of
  a group's terms all with the same count have the same p, so the least share q
  among them bounds f for the bucket. Buckets are opened best first until the
  bound of what is unseen lies strictly below the k-th best f; the k best of a
  group stay from batch to batch. No group is gathered: a window ranks k rows
  for each group and task.
* ``pair``: the sum of |p - p'| over all kept terms, between all sources of a
  language. Postings (source, count) of a term are put into tiles of terms and
  of sources, of bounded size. A tile compares its sources where one of them
  has the term; terms that neither has are a number times |p0 - p0'|. A row for each
  pair and tile is summed.

All arithmetic is exact, up to 10^15 occurrences in a language.

Defined results: null text, language or source = the empty one, which is a
language or source like any; every row is a document, so repeated rows count
each; a group without kept terms has no ``term`` rows, and with V = 0 all its
pairs have value 0; a language's only source has no pairs; equal values rank by
the item's bytes; an empty table gives an empty result; extra columns, whatever
their names, are left aside. Texts are taken whole, at any length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MIN_DOCS = 30
#: Entries that a task sums before it sends them.
HELD_TERMS = 400_000
#: Terms (as expected of their hash) and sources of a tile.
TILE_TERMS, TILE_SOURCES = 512, 64
#: Groups whose best terms a task holds at a time.
HELD_GROUPS = 20_000
#: Rows that are looked at together when terms are searched.
SEARCH_ROWS = 200_000
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def share(count, n: int, v: int):
    """1 + floor(10^9 (count + 5) / (n + 5 v)), by long division, three digits at a time."""
    whole = n + 5 * v
    out, rest = 0, count + 5
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + q
    return out + 1


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    return docs.select(*named, F.col(text_col).cast("string").cast("binary").alias("text"))


def partial_counts(texts: DataFrame, held: int = HELD_TERMS) -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents, summed over what a task held at a time."""

    def rows(counts: dict, holding: dict) -> pa.RecordBatch:
        lang, source, term, c, d = [], [], [], [], []
        for (x, y), found in counts.items():
            lang += [x] * len(found)
            source += [y] * len(found)
            term += found
            c += found.values()
            d += map(holding[x, y].__getitem__, found)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "c", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holding, size = {}, {}, 0
        for batch in batches:
            for group, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2)):
                words = (text.as_py() or b"").translate(_TERM_BYTES).split()
                of = counts.setdefault(group, Counter())
                before = len(of)
                of.update(words)
                holding.setdefault(group, Counter()).update(set(words))
                size += len(of) - before
                if size >= held:
                    yield rows(counts, holding)
                    counts, holding, size = {}, {}, 0
        yield rows(counts, holding)

    return texts.mapInArrow(run, "lang string, source string, term string, c long, d long")


def kept_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, c, of_lang, lead): the counts of kept terms; ``lead`` marks one row a language and term."""
    counts = partial_counts(texts).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    lead = F.row_number().over(term.orderBy("source")) == 1
    summed = counts.withColumns({"of_lang": F.sum("c").over(term), "docs": F.sum("d").over(term), "lead": lead})
    return summed.where(F.col("docs") >= min_docs).select("lang", "source", "term", "c", "of_lang", "lead")


def group_sizes(texts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, of_lang_n): every group that occurs, with what its shares divide by."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.sum(F.col("lead").cast("long")).alias("leads"))
    of_lang = of_group.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("of_lang_n"))
    groups = texts.select("lang", "source").distinct().join(of_group.drop("leads"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    return groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "of_lang_n")])


class BestTerms:
    """The ``k`` terms of a group with the largest f, of batches of its terms."""

    def __init__(self, k: int):
        self.k, self.f, self.terms, self.opened = k, np.zeros(0, np.int64), [], 0

    def add(self, terms: list[str], c: np.ndarray, of_lang: np.ndarray, n: int, v: int, lang_n: int) -> None:
        order = np.argsort(c, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(c[order]) > 0])
        p = share(c[order[starts]], n, v)
        bounds = p - share(np.minimum.reduceat(of_lang[order], starts), lang_n, v)
        ends = np.r_[starts[1:], len(c)]
        for b in np.argsort(-bounds, kind="stable").tolist():
            kth = int(self.f[-1]) if len(self.f) >= self.k else 1
            if bounds[b] < kth:
                break
            rows = order[starts[b] : ends[b]]
            self.opened += 1
            f = p[b] - share(of_lang[rows], lang_n, v)
            rows, f = rows[f >= kth], f[f >= kth]
            both, names = np.r_[self.f, f], self.terms + [terms[i] for i in rows.tolist()]
            # In the order of UTF-8 bytes, which is that of code points.
            best = sorted(range(len(both)), key=lambda i: (-both[i], names[i]))[: self.k]
            self.f, self.terms = both[best], [names[i] for i in best]


def divergent_terms(kept: DataFrame, sizes: DataFrame, k: int = 50) -> DataFrame:
    """(lang, source, item, value): for each group at least its ``k`` best terms, a few times ``k`` at most a task."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SEARCH_ROWS:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def result(best: dict) -> pa.RecordBatch:
        rows = [(*group, t, int(f)) for group, b in best.items() for t, f in zip(b.terms, b.f)]
        cols = list(zip(*rows)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, BestTerms] = {}
        for t in gathered(batches):
            t = t.sort_by([("lang", "ascending"), ("source", "ascending")])
            lang, source, terms = (t.column(x).to_pylist() for x in ("lang", "source", "term"))
            c, of_lang, n, v, lang_n = (t.column(x).to_numpy() for x in ("c", "of_lang", "n", "v", "of_lang_n"))
            begin = 0
            while begin < len(lang):
                group, end = (lang[begin], source[begin]), begin + 1
                while end < len(lang) and (lang[end], source[end]) == group:
                    end += 1
                best.setdefault(group, BestTerms(k)).add(terms[begin:end], c[begin:end], of_lang[begin:end], int(n[begin]), int(v[begin]), int(lang_n[begin]))
                begin = end
            if len(best) > HELD_GROUPS:
                yield result(best)
                best = {}
        yield result(best)

    at = kept.join(sizes, ["lang", "source"]).select("lang", "source", "term", "c", "of_lang", "n", "v", "of_lang_n")
    return at.mapInArrow(run, "lang string, source string, item string, value long")


def pair_sums(kept: DataFrame, sizes: DataFrame, tile_terms: int = TILE_TERMS, tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, item, value): every ordered pair of a language's sources and its sum over all kept terms."""
    tiles = sizes.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile_sources).cast("int").alias("tiles"))
    at = sizes.join(tiles, "lang").select("lang", "source", "n", "v", F.greatest(F.ceil(F.col("v") / tile_terms).cast("int"), F.lit(1)).alias("blocks"), "tiles", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("own"))
    at = materialize(at, "source-tiles")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, "own").alias("a"), F.greatest(t, "own").alias("b")))).alias("tile")
    cols = ["lang", "block", F.col("tile.a").alias("a"), F.col("tile.b").alias("b"), "own", "source", "term", "c", "n", "v"]
    postings = kept.join(at, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select("*", meets).select(*cols)
    present = at.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("c")).select("*", meets).select(*cols)

    def compare(t: pa.Table) -> pa.Table:
        lang, block, a, b = (t.column(x)[0].as_py() for x in ("lang", "block", "a", "b"))
        names = t.column("term").is_null().to_numpy()
        own, source, n, v = (t.column(x) for x in ("own", "source", "n", "v"))
        row = {s: i for i, s in enumerate(source.filter(pa.array(names)).to_pylist())}
        own, n, v = own.to_numpy()[names], n.to_numpy()[names], int(v.to_numpy()[0])
        zero = share(np.zeros(len(n), np.int64), n, v) if v else np.zeros(len(n), np.int64)
        rest = pa.array(~names)
        at = np.array([row[s] for s in source.filter(rest).to_pylist()], np.int64)
        term = t.column("term").filter(rest).combine_chunks().dictionary_encode()
        term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
        p = np.repeat(zero[:, None], len(term.dictionary), axis=1)
        if len(at):
            p[at, term.indices.to_numpy()] = share(t.column("c").filter(rest).to_numpy(), n[at], v)
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        # Terms that no source here has stand the same way in all blocks: the first one counts them.
        absent = (v if block == 0 else 0) - p.shape[1]
        names, out = list(row), []
        for i in left.tolist():
            others = right[right > i] if a == b else right
            d = np.abs(p[others] - p[i]).sum(axis=1) + absent * np.abs(zero[others] - zero[i])
            for j, x in zip(others.tolist(), d.tolist()):
                out += [(names[i], names[j], x), (names[j], names[i], x)]
        s, o, x = zip(*out) if out else ([], [], [])
        return pa.table([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.string()), pa.array(o, pa.string()), pa.array(x, pa.int64())], names=["lang", "source", "item", "value"])

    found = postings.unionByName(present).groupBy("lang", "block", "a", "b").applyInArrow(compare, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, k: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts; see the module."""
    texts = _texts(docs, text_col, lang_col, source_col)
    kept = materialize(kept_terms(texts, min_docs), "kept-terms")
    sizes = materialize(group_sizes(texts, kept), "group-sizes")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = divergent_terms(kept, sizes, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    pairs = pair_sums(kept, sizes).withColumn("rank", F.row_number().over(order))
    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return cols(pairs, "pair").unionByName(cols(terms, "term"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.c), 0) AS n FROM (SELECT DISTINCT lang FROM d) d LEFT JOIN kept k ON k.lang = d.lang GROUP BY d.lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (gn.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
  FROM gn JOIN l ON l.lang = gn.lang JOIN kept k ON k.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER AS rank
  FROM p WHERE c > 0 AND p > q),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL SELECT * FROM terms WHERE rank <= 50
"""

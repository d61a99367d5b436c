"""URL filter: host and path rules, then a weighted vocabulary.

The vocabulary's terms are found by one Aho-Corasick automaton in one pass over
the URL, whatever their number. A hit counts where it stands between
boundaries, so ``casino`` is not seen in ``occasinos``. One strict term
rejects, and so do several distinct soft ones whose weights reach a limit. A
vocabulary is a table (term, strict, weight); without one there is a small list
of words, of weight 1 each.

Defined results: a null URL, or one without ``://``, has an empty host and
path and no rule; a null URL has no terms and is allowed; a term that the
vocabulary has several times is strict if one of them is, and weighs as its
heaviest; empty and null terms are none; a null weight is 1; repeated rows have
each a result; URLs of any length are read whole; an empty table gives an empty
result; extra columns, whatever their names, are left aside.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict): the rule fits its host and all subdomains; the longest wins.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

STRICT = ("adult", "bets", "betting", "casino", "escort", "gambling", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "affiliate", "bonus", "cheap", "click", "crack", "deal", "free", "jackpot", "loan", "lottery", "nude", "payday", "pills", "poker",
    "popup", "prize", "sex", "slots", "torrent", "track", "tracker", "tracking", "win", "winner",
)
#: Weight of distinct soft terms that rejects.
SOFT_LIMIT = 2
#: Terms of a vocabulary at most, since each worker holds them.
MOST_TERMS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        at, _, under = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{under}"))
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


#: Term to (whether it is strict, weight).
Vocabulary = dict[str, tuple[bool, float]]


def default_vocabulary() -> Vocabulary:
    return {t: (False, 1.0) for t in SOFT} | {t: (True, 1.0) for t in STRICT}


def vocabulary_of(terms: DataFrame, most: int = MOST_TERMS) -> Vocabulary:
    """A vocabulary from a table (term, strict, weight) of at most ``most`` terms; a larger one is an error."""
    term = F.translate(F.trim(F.col("term").cast("string")), _UPPER, _LOWER)
    rows = terms.select(term.alias("t"), F.coalesce("strict", F.lit(False)).alias("s"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("w")).where("length(t) > 0").groupBy("t").agg(F.max("s"), F.max("w")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary has {most} terms at most")
    return {r[0]: (r[1], r[2]) for r in rows}


def _automaton(vocabulary: Vocabulary):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, (strict, weight) in vocabulary.items():
        found.add_word(term, (strict, weight, term))
    if vocabulary:
        found.make_automaton()
    return found


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def count_terms(url: str | None, automaton) -> tuple[int, int, float]:
    """Distinct strict terms and distinct soft ones that stand between boundaries, and the weight of the soft ones."""
    if not url or not len(automaton):
        return 0, 0, 0.0
    url = url.translate(_TO_LOWER)
    found = {}
    for end, (strict, weight, term) in automaton.iter(url):
        begin = end - len(term)
        if (begin < 0 or not _word(url[begin])) and (end + 1 == len(url) or not _word(url[end + 1])):
            found[term] = strict, weight
    soft = sorted(w for strict, w in found.values() if not strict)
    return len(found) - len(soft), len(soft), float(sum(soft))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: Vocabulary | None = None, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, strict_terms, soft_terms."""
    sent = pages.sparkSession.sparkContext.broadcast(default_vocabulary() if vocabulary is None else vocabulary)

    def run(batches):
        automaton = _automaton(sent.value)
        for batch in batches:
            hits = [count_terms(u, automaton) for u in batch.column("url").to_pylist()]
            columns = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", "strict_terms", "soft_terms", "soft_weight"])

    need = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    hits = need.mapInArrow(run, "page_id long, url string, strict_terms long, soft_terms long, soft_weight double")
    host, path = host_and_path(F.col("url"))
    split = hits.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = F.when((F.col("strict_terms") > 0) | (F.col("soft_weight") >= soft_limit), "block").otherwise("allow")
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), "strict_terms", "soft_terms")


def oracle() -> str:
    """The same as DuckDB SQL, with a pattern for each term."""
    hit = lambda t: f"(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)'))::BIGINT"
    ordered = sorted(RULES, key=lambda r: -len(r[0]))
    fits = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r, v)}'" for r, v in ordered) + " END"
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT *, {" + ".join(map(hit, STRICT))} AS strict_terms, {" + ".join(map(hit, SOFT))} AS soft_terms FROM b)
SELECT page_id, host, path, {case(lambda r, v: r)} AS rule,
       coalesce({case(lambda r, v: v)}, CASE WHEN strict_terms > 0 OR soft_terms >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms
FROM c
"""

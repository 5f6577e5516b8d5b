"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query of the lower-case
trigrams that any match must hold (an OR of ANDs, derived from the expression's
syntax tree).  The texts are indexed for exactly these trigrams: postings
(trigram, text) are met with the rules' clauses, a clause's postings are
intersected by the bits they fill, and a text becomes a candidate of a rule when
one of its clauses is full.  Candidates are verified with the expression itself;
a rule without mandatory trigrams (bare hexadecimal runs) scans every text.

Texts are keyed by a 64-bit hash in the index, so a copied text is one entry of it;
a collision could only add a candidate, never lose or change a finding.  Texts that
hold 1/1024 or more of all rows meet their entry by a broadcast of at most 1024 rows.

Defined cases: a null text is an empty one and has no findings; texts are scanned
whole; repeated rows give repeated rows; an empty table gives none.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import hot_keys, join_hot


@dataclass(frozen=True)
class Rule:
    """pattern: read alike by Java and Python; a match stays if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The public shapes of the secrets looked for. The first three are the base kinds.
# Runs are maximal, so a least length can stand in the expression of access and hex.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!$&*-]{1,128}@"),
)

Query = frozenset[frozenset[str]]  # an OR of ANDs; a query with the empty AND says nothing
ANY: Query = frozenset([frozenset()])
MOST = 64  # strings that a stretch of an expression may spell before it is cut


def _or(*queries: Query) -> Query:
    clauses = {c for q in queries for c in q}
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _and(a: Query, b: Query) -> Query:
    return _or(frozenset(x | y for x in a for y in b))


def _spelled(strings: set[str]) -> Query:
    return _or(*(frozenset([frozenset(s[k : k + 3] for k in range(len(s) - 2))]) for s in strings)) if strings else ANY


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """(the strings it can spell, or None; the trigrams that it needs by itself)."""
    if op is C.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 16:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ANY
        return (chars if len(chars) <= 8 else None), ANY
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        query = _or(*(q if s is None else _spelled(s) for s, q in parts))
        return (set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None), query
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = arg
        strings, query = _sequence(inner)
        if strings is not None and most == 1:
            return strings | ({""} if least == 0 else set()), ANY
        if least == 0:
            return None, ANY
        return None, _spelled(strings) if strings is not None else query
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    run, query, exact = {""}, ANY, True
    for op, arg in nodes:
        strings, own = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = _and(_and(query, _spelled(run)), own if strings is None else ANY), False
        run = strings or {""}
    return (run, ANY) if exact else (None, _and(query, _spelled(run)))


def trigram_query(pattern: str) -> list[list[str]]:
    """The clauses of which a matching text's lower-case form fills one; [[]] if the expression needs no trigram."""
    strings, query = _sequence(parser.parse(pattern))
    query = _spelled(strings) if strings is not None else query
    return sorted(sorted(c) for c in query)


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules array): the rules with mandatory trigrams that a text may match; texts: key, text."""
    spark = texts.sparkSession
    clauses = [(k, n, t, 1 << i, (1 << len(c)) - 1) for k, r in enumerate(rules) for n, c in enumerate(trigram_query(r.pattern)) for i, t in enumerate(c)]
    shape = "rule int, clause int, trigram string, bit long, full long"
    needed = sorted({c[2] for c in clauses})
    if not needed:
        return spark.createDataFrame([], "key long, rules array<int>")
    low = texts.select("key", F.lower("text").alias("low"))
    postings = low.select("key", F.explode(F.filter(F.array(*map(F.lit, needed)), lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    met = postings.join(F.broadcast(spark.createDataFrame(clauses, shape)), "trigram")  # the rules' own table, of fixed size
    full = met.groupBy("key", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits")).filter("bits = full")
    return full.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, rule, end) of a rule's leftmost matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    span = "array<struct<start:int,rule:int,end:int>>"
    steps = F.arrays_zip(F.transform(found, F.length).alias("m"), F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("g"), F.transform(kept, F.length).alias("k"))
    steps = steps.cast("array<struct<m:int,g:int,k:int>>")

    def add(state, x):
        start = state["at"] + x["g"]
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), (start + x["m"]).alias("end")))
        return F.struct((start + x["m"]).alias("at"), F.when(x["k"] >= rule.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")), add, lambda s: s["out"])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """``keep`` columns with findings: array of (start, rule, end) sorted by start, then rule; rule counts within ``rules``."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    listed = candidates(own.select("key", "text"), rules).hint("shuffle_hash")
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    met = join_hot(own, listed, "key", hot_keys(own.select("key"), "key", docs.count()), left=True)
    parts = []
    for k, r in enumerate(rules):
        may = F.coalesce(F.array_contains("rules", k), F.lit(False)) if trigram_query(r.pattern) != [[]] else F.col("text").rlike(r.pattern)
        parts.append(F.when(may, _spans(F.col("text"), r, k)).otherwise(none))
    return met.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.sort_array(F.concat(*parts)).alias("findings"))


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = BASE + MORE, base: int = len(BASE)) -> DataFrame:
    """The findings as counts a base kind, a digest of the base spans and one string of all spans."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("findings", lambda s: s["rule"] == k)).cast("long")
    return found.select(
        *keep,
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])],
        F.sha2(joined(F.filter("findings", lambda s: s["rule"] < base)), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )

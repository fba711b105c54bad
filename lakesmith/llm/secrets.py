"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. Its Boolean trigram query (an OR of ANDs
of trigrams that every match must contain) is derived from the parsed
expression on the driver. The index has posting lists (trigram, block of
documents) -> documents for the trigrams that the rules ask for, taken from
lower-cased whole texts; queries intersect and unite posting lists inside a
block, so no list grows beyond its block. Candidates are verified by the
expression itself; rules without a mandatory trigram scan every document.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_DOCS = 4096
MAX_STRINGS = 64        # alternatives kept while a literal run is followed through an expression


@dataclass(frozen=True)
class Rule:
    """``group`` (0: the match) must have ``least`` characters or more.
    ``tight`` is an expression that finds just the matches that pass, if
    one exists; it saves listing those that fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    tight: str | None = None


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------- trigram queries

def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The trigrams that a match of ``pattern`` must contain, in lower case:
    one set of trigrams for each alternative (OR of ANDs). None: a match
    need not contain any, so the rule scans everything."""
    query: list[frozenset[str]] | None = None
    for run in _runs(re._parser.parse(pattern)):
        options = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() in options:
            continue        # an alternative too short for a trigram: nothing is mandatory here
        options = {o for o in options if not any(p < o for p in options)}
        query = sorted(options, key=sorted) if query is None else [a | b for a, b in product(query, options)]
    return query


def _runs(parsed) -> list[set[str]]:
    """Sets of alternative literal strings that follow each other in every
    match, with unknown text between the sets."""
    runs: list[set[str]] = []
    cur = {""}
    for op, arg in parsed:
        strings = _strings(op, arg)
        grown = strings and {a + b for a in cur for b in strings}
        if grown and len(grown) <= MAX_STRINGS:
            cur = grown
            continue
        runs.append(cur)
        cur = {""}
        if str(op) == "SUBPATTERN":
            runs += _runs(arg[3])
        elif str(op) == "MAX_REPEAT" and arg[0] >= 1:
            runs += _runs(arg[2])
    return [*runs, cur]


def _strings(op, arg) -> set[str] | None:
    """All strings that a parsed item matches, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "AT":
        return {""}
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if name == "SUBPATTERN":
        return _sequence(arg[3])
    if name == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return set().union(*parts) if all(parts) else None
    if name == "MAX_REPEAT" and arg[1] == 1:
        inner = _sequence(arg[2])
        return inner and ({""} if arg[0] == 0 else set()) | inner
    return None


def _sequence(parsed) -> set[str] | None:
    out = {""}
    for op, arg in parsed:
        s = _strings(op, arg)
        if not s:
            return None
        out = {a + b for a in out for b in s}
        if len(out) > MAX_STRINGS:
            return None
    return out


# -------------------------------------------------------------------- index

def trigram_index(docs: DataFrame, trigrams: list[str], n_blocks: int) -> DataFrame:
    """Posting lists of ``docs`` (rid, text): one row per block of
    documents, one list of rids per trigram."""
    low = F.lower("text")
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t))
    postings = (docs.select("rid", F.explode(found).alias("trigram"))
                .withColumn("block", F.pmod("rid", F.lit(n_blocks))))
    return postings.groupBy("block").agg(*[
        F.collect_set(F.when(F.col("trigram") == t, F.col("rid"))).alias(f"t{i}") for i, t in enumerate(trigrams)])


def candidates(docs: DataFrame, rules: tuple[Rule, ...], n_docs: int) -> DataFrame:
    """(rid, rules): the rules with trigrams that a document may match."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted(set().union(*[t for q in queries.values() for t in q]))
    column = {t: F.col(f"t{i}") for i, t in enumerate(trigrams)}
    index = trigram_index(docs, trigrams, max(1, math.ceil(n_docs / BLOCK_DOCS)))

    def matching(kind: str, q: list[frozenset[str]]) -> Column:
        alternatives = [reduce(F.array_intersect, [column[t] for t in sorted(ts)]) for ts in q]
        return F.transform(reduce(F.array_union, alternatives),
                           lambda r: F.struct(r.alias("rid"), F.lit(kind).alias("rule")))

    lists = [matching(kind, q) for kind, q in queries.items()]
    return (index.select(F.explode(F.concat(*lists)).alias("c")).select("c.rid", "c.rule")
            .groupBy("rid").agg(F.collect_set("rule").alias("rules")))


# ------------------------------------------------------------- verification

def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> in code points of the leftmost
    non-overlapping matches that pass. What lies between the matches gives
    their places: ``split`` and ``regexp_extract_all`` walk the same way."""
    pattern = rule.tight or rule.pattern
    empty = F.array().cast("array<struct<start:int,end:int>>")
    least = 1 if rule.tight else rule.least
    parts = F.struct(F.split(text, pattern, -1).alias("between"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)).alias("held"))

    def walk(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(p["between"], i))
            end = start + F.char_length(F.get(p["match"], i))
            one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
            good = F.char_length(F.get(p["held"], i)) >= least
            return F.struct(end.cast("int").alias("at"),
                            F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))
        n = F.size(p["match"])
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), _let(parts, walk)).otherwise(empty)


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``df`` with found: array<struct<start, rank, end, kind>>
    in order (rank: place of the kind in ``rules``).

    Null text counts as empty and, like any text without a match, has an
    empty list. Identical rows are one entry of the index and get the same
    result; null keys are ordinary values; an empty table stays empty. A
    column ``found`` of ``df`` is replaced."""
    cols = [F.col(f"`{c}`") for c in df.columns if c != "found"]
    base = df.select(F.struct(*cols).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumn("rid", F.xxhash64("row"))
    cand = candidates(base.select("rid", "text"), rules, df.count())
    indexed = {r.kind for r in rules if trigram_query(r.pattern) is not None}
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def found(rank: int, rule: Rule) -> Column:
        out = F.transform(spans_of(F.col("text"), rule), lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))
        return F.when(F.array_contains("rules", rule.kind), out).otherwise(none) if rule.kind in indexed else out

    every = F.array_sort(F.concat(*[found(i, r) for i, r in enumerate(rules)]))
    joined = base.join(cand, "rid", "left")
    return joined.select("row.*", every.alias("found"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> list[Column]:
    """Counts by base kind, the hash of the base spans, and all spans."""
    kinds = [r.kind for r in rules]
    of = F.col("found")

    def count(kind: str) -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    base = F.filter(of, lambda s: s["kind"].isin(*kinds))
    return [*counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(of).alias("spans")]


def redact(found: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``text`` of ``find_secrets`` with every span replaced by ``mark``
    (overlapping spans by one mark); other texts, null ones too, as they
    are. Drops ``found``."""
    t = F.col(f"`{text}`")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = (s["start"] >= acc["at"]) & ((s["start"] > acc["at"]) | (acc["at"] == 0))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("found", start, step, lambda acc: F.concat(
        acc["out"], F.substring(t, acc["at"] + 1, F.lit(2**31 - 1))))
    return found.withColumn(text, F.when(F.size("found") > 0, cut).otherwise(t)).drop("found")

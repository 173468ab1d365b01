"""Secrets in texts, found by rules through an inverted index of trigrams.

A rule is a regular expression.  From each a Boolean query is derived: an OR of
clauses, each a set of trigrams that a match of that alternative must hold (in lower
case).  The postings of the trigrams that any query names are joined with the
clauses and intersected: a text is a candidate of a rule where it has all trigrams
of one of its clauses.  Only candidates are searched with the expression itself.
Rules without mandatory trigrams search every text.

All of it is SQL functions and joins; the rules alone are looked at on the driver.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either(word: str) -> str:
    """A pattern of ``word`` in either case, by letters (a flag would fold others into them)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"

#: The three rules of the base.  A run of at least so many characters is what is left of
#: ``+`` after shorter matches are dropped, as a match takes its whole run.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Published formats of credentials.
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{32,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("bearer", rf"{either('bearer')}\x20+[A-Za-z0-9._~+/-]{{16,}}=*"),
    Rule("url_login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)

RULES = BASE + MORE

# -- from an expression to its trigrams ---------------------------------------------

#: Anything may stand here.
GAP = "\0"

#: Alternatives and letters of a class beyond which a part counts as a gap.
MOST, CLASS = 256, 8


def _letters(items: list) -> set[str]:
    """The characters of a class in lower case, or a gap."""
    out: set[str] = set()
    for op, arg in items:
        if op is parser.LITERAL:
            out.add(chr(arg).lower())
        elif op is parser.RANGE and arg[1] - arg[0] < 64:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return {GAP}
    return out if len(out) <= CLASS else {GAP}


def alternatives(parsed) -> set[str]:
    """What a match looks like: strings in lower case with gaps."""
    out = {""}
    for op, arg in parsed:
        if op is parser.LITERAL:
            part = {chr(arg).lower()}
        elif op is parser.IN:
            part = _letters(arg)
        elif op is parser.SUBPATTERN:
            part = alternatives(arg[-1])
        elif op is parser.BRANCH:
            part = set().union(*map(alternatives, arg[1]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            least, most, inner = arg[0], arg[1], alternatives(arg[2])
            if most == 1:
                part = inner | ({""} if least == 0 else set())
            else:
                part = {x + GAP for x in inner} if least else {GAP}
        elif op is parser.AT:
            part = {""}
        else:
            part = {GAP}
        made = {a + b for a in out for b in part}
        out = made if len(made) <= MOST else {a + GAP for a in out}
    return out


def query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of trigram sets one of which every match has; None: nothing is mandatory."""
    clauses = {frozenset(run[i : i + 3] for run in x.split(GAP) for i in range(len(run) - 2)) for x in alternatives(parser.parse(pattern))}
    if frozenset() in clauses:
        return None
    # a clause that holds another one asks for more than is needed
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


# -- the index ---------------------------------------------------------------------


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(key, gram): which of the trigrams each text holds, in either case."""
    known = F.array(*map(F.lit, grams))
    # an array of one, so that the text is lower-cased once
    held = F.get(F.transform(F.array(F.lower("text")), lambda low: F.filter(known, lambda g: F.contains(low, g))), F.lit(0))
    return docs.select("key", F.explode(held).alias("gram"))


def candidates(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, rules): the numbers of the rules whose trigram query a text fulfils; None
    if no rule has one.  Texts with the same key count as one."""
    terms = []
    for r, rule in enumerate(rules):
        for c, clause in enumerate(query(rule.pattern) or ()):
            terms += [(g, r, c, 1 << i, (1 << len(clause)) - 1) for i, g in enumerate(sorted(clause))]
    if not terms:
        return None
    wanted = spark.createDataFrame(terms, "gram string, rule int, clause int, bit long, whole long")
    met = postings(docs, sorted({t[0] for t in terms})).join(F.broadcast(wanted), "gram")  # a row per trigram of the rules
    full = met.groupBy("key", "rule", "clause", "whole").agg(F.bit_or("bit").alias("seen")).filter("seen = whole")
    return full.groupBy("key").agg(F.collect_set("rule").alias("rules"))


# -- verification ------------------------------------------------------------------


def _once(x: Column, use) -> Column:
    """use(x), with x evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running totals of an array, in about log2(n) passes."""
    passes = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)).cast("double"))).cast("int")

    def further(acc: Column, j: Column) -> Column:
        back = F.pow(F.lit(2.0), j).cast("int")
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - back), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), passes - 1), lengths, further)


def _spans(text: Column, rules: tuple[Rule, ...], r: Column) -> Column:
    """array<struct<start, rule, end>> of the matches of rule number r, in code points."""

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), r)

    pattern, group, least = of([x.pattern for x in rules]), of([x.group for x in rules]), of([x.least for x in rules])

    def placed(found: Column) -> Column:
        value = F.when(group == 0, found).otherwise(F.regexp_extract_all(text, pattern, group))
        turns = F.zip_with(F.split(text, pattern, -1), found, lambda b, m: F.array(F.length(b), F.coalesce(F.length(m), F.lit(0))))

        def kept(at: Column) -> Column:
            spans = F.transform(value, lambda v, i: F.when(F.length(v) >= least, F.struct(F.get(at, 2 * i).alias("start"), r.alias("rule"), F.get(at, 2 * i + 1).alias("end"))))
            return F.array_compact(spans)

        return _once(_once(F.flatten(turns), _running), kept)

    return _once(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def find_secrets(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans): for each row, every match of every rule: array<struct<start, rule,
    end>>, by start, then by the rule's place; code points from 0, end exclusive.

    docs: doc_id, text.  Matches of one rule do not overlap (leftmost first); those of
    different rules may.  A null text counts as empty; rows that repeat an id, or are
    equal, are searched each; null ids take part; other columns do not matter; an empty
    table gives no rows; texts are searched whole.
    """
    keyed = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    everywhere = [r for r, rule in enumerate(rules) if query(rule.pattern) is None]
    scanned = F.array_compact(F.array(*[F.when(F.col("text").rlike(rules[r].pattern), F.lit(r)) for r in everywhere])) if everywhere else F.array().cast("array<int>")
    found = candidates(spark, keyed, rules)
    if found is not None:
        # equal keys of unequal texts would only add candidates
        keyed = keyed.join(found, "key", "left")
        scanned = F.concat(F.coalesce("rules", F.array().cast("array<int>")), scanned)
    spans = F.flatten(F.transform(scanned, lambda r: _spans(F.col("text"), rules, r)))
    return keyed.select("doc_id", F.array_sort(spans).alias("spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, joined by commas."""
    kinds = F.array(*[F.lit(x.kind) for x in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

"""URL filters: site rules and pattern rules over page addresses, in DataFrame functions only.

A pattern rule is a regular expression with the literal tokens that every matching url must hold.  The rule is filed
under the literal that the fewest distinct urls hold.  A url's tokens fetch the rules filed under them, and only those
rules run their expression on that url.  Up to ``BROADCAST_RULES`` rows of rules are broadcast; more are joined by token.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from ..schema import local_frame
from .common import ascii_lower, col, unused

BROADCAST_RULES = 20_000
TOKEN = "[^0-9a-z]+"


class SiteRule(NamedTuple):
    """Fits a host and all its subdomains where the path starts with ``path`` ('/' begins every path)."""

    verdict: str
    host: str
    path: str


class PatternRule(NamedTuple):
    """A regular expression over the whole url (A-Z lower-cased) and literal tokens that each match must hold."""

    verdict: str
    name: str
    pattern: str
    literals: tuple[str, ...]


# Addresses that hold no article: gambling and adult sites, sign-in pages, paid links.
PATTERNS = [
    PatternRule("block", "casino", r"^[^:]*://[^/?#]*\bcasino\b", ("casino",)),
    PatternRule("block", "poker", r"^[^:]*://[^/?#]*\bpoker\b", ("poker",)),
    PatternRule("block", "betting", r"^[^:]*://[^/?#]*\bbetting\b", ("betting",)),
    PatternRule("block", "adult", r"^[^:]*://[^/?#]*\bxxx\b", ("xxx",)),
    PatternRule("block", "login", r"^[^:]*://[^/?#]*/login([/?#]|$)", ("login",)),
    PatternRule("block", "signin", r"^[^:]*://[^/?#]*/signin([/?#]|$)", ("signin",)),
    PatternRule("block", "paid link", r"[?&]utm_source=ads([&#]|$)", ("utm", "source", "ads")),
]


def parts(urls: DataFrame, url_col: str, host: str, path: str) -> DataFrame:
    """The table with host and path columns; both are empty for null urls and urls without '://'."""
    url = col(url_col)
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    head = F.regexp_extract(rest, "^[^/?#]*", 0)
    return urls.withColumns({host: ascii_lower(head), path: F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def _escaped(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


def _rule_rows(sites: Sequence[SiteRule], patterns: Sequence[PatternRule]) -> list[tuple]:
    """(number, is a site rule, verdict, name, expression, literal) per rule and literal.

    A site rule's expression reads host and path joined; its literals are its whole tokens (a token that the path's
    prefix may cut short is none).
    """
    rows = []
    for r in sites:
        whole = re.sub("[0-9A-Za-z]+$", "", r.path)
        literals = [t for t in re.split(TOKEN, f"{r.host}{whole}".lower()) if t]
        rows += [(len(r.host) + len(r.path), True, r.verdict, f"{r.host}{r.path}",
                  f"^([^/]*[.])?{_escaped(r.host.lower())}{_escaped(r.path)}", t) for t in literals]
    for r in patterns:
        rows += [(0, False, r.verdict, r.name, r.pattern, t) for t in r.literals]
    return rows


def judge_urls(urls: DataFrame, sites: Sequence[SiteRule] = (), patterns: Sequence[PatternRule] = PATTERNS,
               url_col: str = "url") -> DataFrame:
    """The table with ``host``, ``path``, ``rule``, ``verdict`` and ``patterns`` (names of the pattern rules that match).

    The longest site rule that fits gives rule and verdict (of equally long ones a blocking one, then the first by
    name).  Without one, ``rule`` is null and the verdict is "block" where a blocking pattern matches, else "allow".
    Patterns see the url with A-Z lower-cased.  Null urls have an empty host and path and are allowed.  Repeated rows
    are judged alike; an empty table gives no rows; columns of the same names as the added ones keep theirs.
    """
    host, path, rule, verdict, names = unused(urls, "host", "path", "rule", "verdict", "patterns")
    spark = urls.sparkSession
    distinct = urls.select(col(url_col).alias("_url")).dropna().distinct()
    seen = parts(distinct, "_url", "_host", "_path").select(
        "_url", F.concat("_host", "_path").alias("_place"), ascii_lower(F.col("_url")).alias("_low"))
    tokens = seen.withColumn("_token", F.explode(F.array_distinct(F.split(F.lower("_low"), TOKEN))))
    rows = _rule_rows(sites, patterns)
    rules = local_frame(spark, rows, "length int, site boolean, verdict string, name string, pattern string, literal string")
    sized = F.broadcast if len(rows) <= BROADCAST_RULES else (lambda df: df)
    literals = rules.select(F.col("literal").alias("_token")).distinct()
    counts = tokens.join(sized(literals), "_token").groupBy("_token").count()
    rarest = Window.partitionBy("site", "name", "pattern").orderBy(F.coalesce("count", F.lit(0)), "literal")
    filed = (rules.join(counts, F.col("literal") == F.col("_token"), "left").drop("_token")
             .withColumn("_n", F.row_number().over(rarest)).filter("_n = 1").drop("_n", "count"))
    matched = (tokens.join(sized(filed), F.col("_token") == F.col("literal"))
               .filter(F.when(F.col("site"), F.expr("_place rlike pattern")).otherwise(F.expr("_low rlike pattern"))))
    fits = F.struct("length", (F.col("verdict") == "block").alias("blocks"), "name")
    best = matched.groupBy("_url").agg(
        F.max_by(F.struct("name", "verdict"), F.when(F.col("site"), fits)).alias("_best"),
        F.max(F.when(~F.col("site"), F.col("verdict") == "block")).alias("_blocked"),
        F.array_sort(F.collect_set(F.when(~F.col("site"), F.col("name")))).alias("_names"))
    whole = parts(urls, url_col, host, path).join(best, col(url_col) == F.col("_url"), "left")
    return whole.withColumns({
        rule: F.col("_best.name"),
        verdict: F.coalesce(F.col("_best.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow")),
        names: F.coalesce("_names", F.array().cast("array<string>")),
    }).select(*map(col, urls.columns), host, path, rule, verdict, names)


def keep_allowed(urls: DataFrame, sites: Sequence[SiteRule] = (), patterns: Sequence[PatternRule] = PATTERNS,
                 url_col: str = "url") -> DataFrame:
    """The rows whose url is allowed, with the table's own columns."""
    judged = judge_urls(urls, sites, patterns, url_col)
    return judged.filter(F.col(judged.columns[-2]) == "allow").select(*map(col, urls.columns))

"""URL filter: pattern rules indexed by their rarest literal token (DataFrame operations only).

A rule is a regular expression over ``host + path`` with the literal tokens
that every match contains whole.  Each rule is stored under one of its
tokens: the one found in the fewest URLs.  A URL is cut into tokens, the
tokens fetch the rules stored under them, and only those regular
expressions run on that URL.

Edge cases: a null URL or one without ``://`` has an empty host and path,
fetches no rule and is allowed.  Rows are never merged: repeated rows and
null ids each give one row.  Of several matching site rules the longest
wins, then the smaller text; site rules come before pattern rules, and any
matching pattern blocks.  Other columns of the input are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[^a-z0-9]+"          # what separates tokens of a lower-cased URL
MAX_LITERAL_RULES = 2_000     # up to so many rules the index is a literal in the plan, beyond it a joined table


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + path; ``tokens`` are contained whole in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    site: bool = False


def site_rule(site: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix, written ``host/path``."""
    host, _, path = site.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    # the last piece of the path may go on inside the URL's token, unless a separator ends it
    pieces = [t for t in re.split(TOKEN, host.lower()) if t]
    ends = [t for t in re.split(TOKEN, path.lower()) if t]
    if ends and re.search("[A-Za-z0-9]$", path):
        ends.pop()
    return Rule(site, verdict, pattern, tuple(dict.fromkeys(pieces + ends)), True)


SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"),
              site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))

# whole tokens of host or path that mark spam, adult and gambling sites
_WORDS = (("spam", "farm"), ("cheap", "pills"), ("adult",), ("porn",), ("xxx",), ("casino",), ("viagra",),
          ("payday", "loans"), ("sex", "cams"), ("free", "slots"), ("warez",), ("torrent",))
PATTERN_RULES = tuple(
    Rule("-".join(w), "block", r"(?i)(?<![a-z0-9])" + "[-_.]?".join(w) + r"(?![a-z0-9])", w)
    for w in _WORDS if len(w) == 1) + tuple(
    Rule("-".join(w), "block", r"(?i)(?<![a-z0-9])" + "[-_.]".join(w) + r"(?![a-z0-9])", w)
    for w in _WORDS if len(w) > 1)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct tokens of a URL part, A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, TOKEN), lambda t: t != ""))


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(i, r.name, r.verdict, r.pattern, list(r.tokens), r.site, len(r.name)) for i, r in enumerate(rules)],
        "rule_id int, name string, verdict string, pattern string, tokens array<string>, site boolean, length int")


def rarest_token_index(url_tokens: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """One row per rule under the token that the fewest URLs hold (ties: the smaller token).

    The token counts come from all URLs; only tokens of rules are counted,
    with map-side partial sums, so a token in every URL costs one row a task.
    """
    terms = rules.select("rule_id", F.explode("tokens").alias("token"))
    known = terms.select("token").distinct()
    hits = url_tokens.join(F.broadcast(known) if small else known, "token", "left_semi")
    counts = hits.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = (terms.join(counts, "token", "left").fillna(0, ["n"])
              .groupBy("rule_id").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    return rules.join(ranked, "rule_id").drop("tokens")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          rules: Sequence[Rule] = SITE_RULES + PATTERN_RULES) -> DataFrame:
    """One row per input row: id, host, path, rule (the site rule that decides), pattern (the pattern
    that decides where no site rule fits), verdict (``allow`` or ``block``), n_candidates."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    tokens = tokens_of(F.concat("host", "path"))
    empty = any(not r.tokens for r in rules)
    if empty:
        raise ValueError("every rule needs a literal token")
    if not rules:
        return parts.select(F.col("_id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(None).cast("string").alias("pattern"), F.lit("allow").alias("verdict"),
                            F.lit(0).alias("n_candidates"))
    small = len(rules) <= MAX_LITERAL_RULES
    index = rarest_token_index(parts.select(F.explode(tokens).alias("token")), rule_table(spark, rules), small)
    if small:
        # one (rule, token) row per rule: bounded by the rule list, whatever the number of URLs
        under: dict[str, list[Rule]] = {}
        for r in index.select("rule_id", "token").sort("rule_id").collect():
            under.setdefault(r["token"], []).append(rules[r["rule_id"]])
        lookup = F.create_map(*[x for t, held in under.items() for x in (F.lit(t), F.array(*map(_literal, held)))])
        fetched = F.transform(tokens, lambda t: F.element_at(lookup, t))
        found = parts.withColumn("_rules", F.flatten(F.filter(fetched, lambda x: x.isNotNull())))
    else:
        each = F.struct("site", "length", "name", "verdict", "pattern")
        subjects = parts.select("host", "path").distinct()
        fetched = (subjects.withColumn("token", F.explode(tokens)).join(index, "token")
                   .groupBy("host", "path").agg(F.collect_list(each).alias("_rules")))
        found = parts.join(fetched, ["host", "path"], "left").withColumn("_rules", F.coalesce("_rules", F.expr(
            "from_json('[]', 'array<struct<site:boolean,length:int,name:string,verdict:string,pattern:string>>')")))
    return _decide(found, F.concat("host", "path"), id_col)


def _literal(r: Rule) -> Column:
    return F.struct(F.lit(r.site).alias("site"), F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"),
                    F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))


def _decide(found: DataFrame, subject: Column, id_col: str) -> DataFrame:
    fits = F.filter("_rules", lambda r: F.regexp_like(subject, r["pattern"]))
    found = found.withColumn("_fits", fits)
    # longest site rule first, then the smaller name
    site = F.array_sort(F.filter("_fits", lambda r: r["site"]),
                        lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
                        .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    pattern = F.array_sort(F.transform(F.filter("_fits", lambda r: ~r["site"]), lambda r: r["name"]))
    found = found.withColumn("_site", F.get(site, F.lit(0))).withColumn("_pattern", F.get(pattern, F.lit(0)))
    verdict = F.coalesce(F.col("_site.verdict"), F.when(F.col("_pattern").isNotNull(), "block").otherwise("allow"))
    return found.select(F.col("_id").alias(id_col), "host", "path", F.col("_site.name").alias("rule"),
                        F.when(F.col("_site").isNull(), F.col("_pattern")).alias("pattern"),
                        verdict.alias("verdict"), F.size("_rules").alias("n_candidates"))

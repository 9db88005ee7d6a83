"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a pattern over host and path. Every run of letters and digits that a matching URL must hold as a whole token is
a literal token of the rule; the rule is filed under the one that the URLs at hand hold least often. A URL's
tokens fetch its candidate rules, and only those run their regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scene_qa.llm.common import column, dealt_join, materialise, small_join


@dataclass(frozen=True)
class Rule:
    """name: what is reported; pattern: Java regular expression over host + path, found anywhere; tokens: literal
    tokens it implies (none: it is tried on every URL); action: allow or block; rank: larger wins."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    rank: int


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))


def host_rule(host: str, path: str, action: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with `path` (which ends in a slash or is a prefix)."""
    whole = _tokens(host) + _tokens(path[: path.rfind("/") + 1])  # what follows the last slash may go on in the URL
    return Rule(host + path, r"^(?:[^/]*\.)?" + re.escape(host + path), tuple(whole), action, len(host + path))


def wildcard_rule(pattern: str, action: str = "block") -> Rule:
    """A pattern over host and path: `*` is any characters, `^` a separator or either end; the rest is literal.
    A token counts as literal if separators or `^` stand on both sides of it in the pattern."""
    regex = "".join({"*": ".*", "^": r"(?:^|[^A-Za-z0-9]|$)"}.get(c) or re.escape(c) for c in pattern)
    whole = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern.lower())
    return Rule(pattern, "(?s)" + regex, tuple(whole), action, len(pattern))


#: The stated host rules.
HOST_RULES = (host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow"))
#: The patterns that judge a URL which no host rule fits.
PATTERNS = tuple(map(wildcard_rule, ("^casino-win^", "^cheap-pills^", "^spam-farm^", "^free-bets^", "^ads-track^", "^casino^*^bonus^", "^porn^", "^xxx^", "^adserver^", "^clickbait^", "^malware^", "^phishing^", "^torrent^*^crack^", "^warez^")))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(i, r.name, r.pattern, sorted(set(r.tokens)), r.action, r.rank) for i, r in enumerate(rules)], "rule_id int, name string, pattern string, tokens array<string>, action string, rank int")


def host_of(url) -> "F.Column":
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> "F.Column":
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matches(urls: DataFrame, rules: DataFrame, max_rules: int = 100_000) -> DataFrame:
    """urls(subject: distinct host + path) and rules -> (subject, best struct<rank, rule_id, name, action>): the
    rule of highest rank, then least rule_id, that each subject matches. Up to max_rules rules are sent to all
    tasks, more are joined by a shuffle on the token."""
    lowered = F.translate("subject", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_union(F.array_remove(F.array_distinct(F.split(lowered, "[^a-z0-9]+")), ""), F.array(F.lit("")))
    held = urls.select("subject", F.explode(tokens).alias("token"))
    wanted = rules.select("rule_id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    frequency = small_join(held, materialise(wanted.select("token").distinct()), ["token"], "inner", max_rules).groupBy("token").agg(F.count("*").alias("n"))
    filed = wanted.join(frequency, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = materialise(filed.join(rules.drop("tokens"), "rule_id"))
    tried = small_join(held, index, ["token"], "inner", max_rules).where(F.expr("subject rlike pattern"))
    best = F.max(F.struct("rank", (-F.col("rule_id")).alias("rule_id"), "name", "action"))
    return tried.groupBy("subject").agg(best.alias("best"))


def judge_urls(pages: DataFrame, url: str = "url", host_rules: tuple[Rule, ...] = HOST_RULES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """Distinct urls of pages -> (url, n, host, path, rule, verdict, pattern), n its rows.

    The host rule with the longest host and path decides; where none fits, a URL that a pattern matches is blocked
    and any other allowed. Each URL is judged once however many rows hold it. A null URL, and one without ://, has an
    empty host and path and is allowed; a very long URL is matched whole; an empty table gives no rows. Ties: the longer rule, then
    the first. Many rules may be filed under one token."""
    spark = pages.sparkSession
    urls = pages.select(column(url).alias("url")).groupBy("url").agg(F.count("*").alias("n")).select("url", "n", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("subject", F.concat("host", "path"))
    # a host rule outranks every pattern
    top = max([r.rank for r in patterns], default=0) + 1
    ranked = tuple(Rule(r.name, r.pattern, r.tokens, r.action, r.rank + top) for r in host_rules) + tuple(patterns)
    found = matches(urls.select("subject").distinct(), rule_table(spark, ranked))
    judged = urls.join(found, "subject", "left")
    by_host = F.col("best.rank") >= top
    return judged.select("url", "n", "host", "path", F.when(by_host, F.col("best.name")).alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"), F.when(~by_host, F.col("best.name")).alias("pattern"))


def filter_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", **rules) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row of pages, repeated rows included; other columns are not read,
    whatever they are called. See judge_urls."""
    named = lambda c: [c.isNull().alias("_none"), F.coalesce(c, F.lit("")).alias("_url")]
    judged = materialise(judge_urls(pages, url, **rules).select(*named(F.col("url")), "n", "host", "path", "rule", "verdict", "pattern"))
    rows = pages.select(column(page_id).alias("page_id"), *named(column(url)))
    return dealt_join(rows, judged, ["_none", "_url"], "n", "page_id").select("page_id", "host", "path", "rule", "verdict", "pattern")

"""URL filters: rules indexed by their rarest literal token; only the rules that a URL's tokens fetch are run."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A rule on host + path. Every match holds each of `tokens` (lower case, letters and digits) between other characters."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    #: Rules on hosts come before patterns; among them the longest decides.
    length: int = 0
    #: Whether A-Z count as a-z in the path too.
    folded: bool = False


def host_rule(verdict: str, name: str) -> Rule:
    """The rule for a host with its subdomains and a path prefix, like `example.net/en/`."""
    host, slash, path = name.partition("/")
    return Rule(name, rf"^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(t for t in re.split("[^a-z0-9]+", f"{host}/{path[: path.rfind('/') + 1]}".lower()) if t), verdict, len(name))


#: The rules on hosts and paths.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))


def word_rule(*following: str) -> Rule:
    """A rule that blocks URLs whose host or path has the words one after another, with one other character between them."""
    middle = "[^a-z0-9]".join(following)
    return Rule("-".join(following), f"(?:^|[^a-z0-9]){middle}(?:[^a-z0-9]|$)", following, "block", folded=True)


# Words that block a URL alone, and words that block it if one of the first kind stands before one of the second.
WORDS = ("casino", "porn", "xxx", "poker", "viagra", "malware", "phishing", "warez")
BEFORE = (
    "adult", "adults", "affordable", "amateur", "best", "big", "bonus", "buy", "cheap", "cheapest", "discount", "easy", "escort", "express", "fake", "fast", "free", "generic",
    "get", "hot", "instant", "live", "local", "lucky", "mature", "nude", "online", "order", "overnight", "payday", "pirate", "quick", "real", "replica", "secret", "sexy", "top",
)
AFTER = (
    "bets", "betting", "bingo", "cams", "chat", "cialis", "cracks", "credit", "dating", "diploma", "drugs", "followers", "gambling", "girls", "hookup", "jackpot", "keygen", "lender",
    "loan", "loans", "lottery", "meds", "passport", "pharmacy", "pills", "prescription", "roulette", "serials", "singles", "slots", "steroids", "streams", "torrents", "watches", "webcams",
)
RULES = (*HOST_RULES, *map(word_rule, WORDS), *(word_rule(a, b) for a in BEFORE for b in AFTER))
#: Rules that the driver and every task hold.
MOST_RULES = 200_000


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules of a table (name, pattern, tokens, verdict, length, folded) in the order of names; more than MOST_RULES are an error."""
    rows = table.select("name", "pattern", "tokens", "verdict", "length", "folded").orderBy("name").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(r.name, r.pattern, tuple(r.tokens), r.verdict, r.length, r.folded) for r in rows]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host from the first :// to / ? # or the end, A-Z in lower case; then the path to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return folded(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def folded(text: Column) -> Column:
    """The text with A-Z as a-z, and no other letter changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(site: Column) -> Column:
    return F.array_distinct(F.split(folded(site), "[^a-z0-9]+"))


def token_counts(sites: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """URLs that hold each token of the rules: one row per token comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    known = sites.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    found = sites.select(F.explode(_tokens(F.col("site"))).alias("token")).join(F.broadcast(known), "token")  # as many rows as the rules have tokens
    return dict.fromkeys(wanted, 0) | {r.token: r["count"] for r in found.groupBy("token").count().collect()}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[tuple[int, Rule]]]:
    """The rules, with their places in the order, by their rarest token, ties to the first by code point."""
    out: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules):
        if not r.tokens:
            raise ValueError(f"{r.name}: a rule needs a literal token")
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append((i, r))
    return out


def verdict_of(site: str, low: str, fetched: Iterable[tuple[int, Rule]], compiled: Callable[[str], re.Pattern]) -> tuple[str | None, str, str | None]:
    """(rule, verdict, pattern) of a URL by those of the rules that are fetched."""
    best, first = None, None
    for i, r in fetched:
        if compiled(r.pattern).search(low if r.folded else site):
            if r.length:
                best = r if best is None or r.length > best.length else best
            elif first is None or i < first[0]:
                first = i, r
    if best:
        return best.name, best.verdict, None
    return (None, first[1].verdict, first[1].name) if first else (None, "allow", None)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, pattern.

    rule: the longest host rule that fits, whose verdict counts; else null, and the first pattern
    rule that matches host and path decides (pattern: its name), and a URL that none matches is
    allowed. A URL that is null or lacks :// has an empty host and path and is allowed. Repeated
    rows give equal rows; an empty table gives an empty one; the key may be null; other columns
    are ignored, very long URLs are read whole. No row is shuffled: the rules, MOST_RULES at most, go to
    the tasks, where a URL's tokens fetch the candidates and only those run their regular
    expressions.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    host, path = split_url(F.coalesce(F.col(url), F.lit("")))
    sites = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path")).withColumn("site", F.concat("host", "path"))
    index = pages.sparkSession.sparkContext.broadcast(index_rules(rules, token_counts(sites, rules)))

    @F.pandas_udf("rule string, verdict string, pattern string")
    def verdicts(site: pd.Series, low: pd.Series) -> pd.DataFrame:
        compiled, by_token = functools.cache(re.compile), index.value
        out = []
        for s, t in zip(site, low, strict=True):
            fetched = [r for x in set(re.split("[^a-z0-9]+", t)) for r in by_token.get(x, ())]
            out.append(verdict_of(s, t, fetched, compiled))
        return pd.DataFrame(out, columns=["rule", "verdict", "pattern"])

    return sites.withColumn("v", verdicts("site", folded(F.col("site")))).select(F.col("id").alias(key), "host", "path", "v.rule", "v.verdict", "v.pattern")

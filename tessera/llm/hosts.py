"""URL filtering: curated rules, and an empirical-Bayes reputation of hosts where no rule fits.

A page that a rule judges is a labelled outcome (1: blocked). Outcomes are counted by host, and each level's rate is
shrunk to the level above by a beta-binomial prior: all pages, suffix, registered domain, host. A prior's mean is the
posterior mean above it; its strength (in pages) is fitted by the method of moments to how much the rates of siblings
differ beyond chance, and is at most their number: few siblings say little about others. Going up, a member counts for
as many pages as its outcomes say about its siblings (n (k + 1) / (n + k)), so one large host does not speak for all;
going down, the doubt about the level above is part of the doubt about each member. A host is blocked if the lower bound
of its posterior, mean - Z standard deviations, is above LIMIT and at least ENOUGH pages speak of it: its own, and what
those of its domain and suffix count for. Little evidence blocks nothing.

A suffix is a name's last label, or its last two where the last has two letters and the one before is in SECOND.
Addresses are suffixes' members of their own, under the name ADDRESS; a stop at a name's end says nothing.

DataFrame functions and SQL's arithmetic only; the driver sees three strengths and one mean, and what is joined is one
row a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Saved

Z, LIMIT, LEAST, MOST, ENOUGH = 1.64, 0.5, 0.5, 1000.0, 3.0

#: Labels under which countries register names (fixed values), and how hosts that are addresses look.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "id", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
TAIL = rf"(?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]*"
ADDRESSES, ADDRESS = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^\[", "#"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The curated rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else both empty."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (name, verdict), null if none does. Rules are a list of constants, at hand for each row."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def parts(host: Column) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host with or without user and port."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", ""), r"\.+$", "")
    address = name.rlike(ADDRESSES)
    return F.when(address, ADDRESS).otherwise(F.regexp_extract(name, rf"(?:^|\.)({TAIL})$", 1)), F.when(address, name).otherwise(F.regexp_extract(name, rf"((?:[^.]*\.)?(?:{TAIL}))$", 1))


def _pooled(members: DataFrame, above: list[str]) -> tuple[float, DataFrame]:
    """Of members (keys, n, bad): the strength of the prior that siblings share, and (above, n, bad) of the level above."""
    n, bad, total = F.col("n"), F.col("bad"), F.col("total")
    pool = members.groupBy(*above).agg(F.sum("n").alias("total"), F.sum("bad").alias("total_bad"))
    j = members.where("n > 0")
    j = j.join(pool, above) if above else j.crossJoin(F.broadcast(pool))  # without keys the pool is one row
    p = F.col("total_bad") / total
    rest = 1 - n / total  # what is not the member's own part of the pool
    fit = j.agg(F.sum(n * F.pow(bad / n - p, 2)).alias("s"), F.sum(p * (1 - p) * rest).alias("e"), F.sum(p * (1 - p) * rest * F.greatest(n - 1, F.lit(0.0))).alias("d"), F.count(F.when(rest > 0, 1)).alias("siblings")).first()
    k = MOST if fit.s is None or not fit.s > fit.e else fit.d / (fit.s - fit.e) - 1
    k = max(LEAST, min(MOST, float(fit.siblings), k))
    weight = n * (k + 1) / (n + k)
    return k, members.groupBy(*above).agg(F.sum(weight).alias("n"), F.sum(F.when(n > 0, weight * bad / n).otherwise(0.0)).alias("bad"))


def reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """host, n, bad, mean, bound, blocked out of (host, bad), bad being 1, 0 or null where an outcome is not known."""
    counts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    suffix, domain = parts(F.col("host"))
    levels = [Saved(counts.select(suffix.alias("suffix"), domain.alias("domain"), "host", "n", "bad")).df]
    keys = ["suffix", "domain", "host"]
    strengths = []
    for depth in (2, 1, 0):  # from hosts up
        k, above = _pooled(levels[0], keys[:depth])
        strengths.insert(0, k)
        levels.insert(0, Saved(above).df if depth else above)
    n, bad = levels[0].first()
    m = ((bad or 0) + 1) / ((n or 0) + 2)
    above = None
    for depth, (k, members) in enumerate(zip(strengths, levels[1:], strict=True), 1):
        g = members.join(above, keys[: depth - 1]) if above is not None else members.withColumns({"m": F.lit(m), "v": F.lit(m * (1 - m) / ((n or 0) + 3)), "seen": F.lit(0.0)})
        total = F.col("n") + k
        mean = (F.col("bad") + F.col("m") * k) / total
        g = g.withColumn("_m", mean).withColumn("_v", F.col("_m") * (1 - F.col("_m")) / (total + 1) + F.pow(k / total, 2) * F.col("v"))
        g = g.withColumn("seen", F.col("seen") + F.col("n")).drop("m", "v").withColumnsRenamed({"_m": "m", "_v": "v"})
        above = g.drop("n", "bad")
    bound = F.col("m") - F.lit(z) * F.sqrt("v")
    return g.select("host", "n", "bad", F.col("m").alias("mean"), bound.alias("bound"), ((bound > limit) & (F.col("seen") >= ENOUGH)).alias("blocked"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url): the longest fitting rule's, else the host's.

    A null url, or one without ``://``, has an empty host and path and is a page of the empty host. Rows with one page_id
    each have a row; an empty table gives an empty result.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    hosts = reputation(rows.select("host", bad.alias("bad")))
    return rows.join(hosts.select("host", "blocked", "bound"), "host").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), F.col("bound").alias("host_bound"))

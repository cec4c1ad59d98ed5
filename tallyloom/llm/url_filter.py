"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Every labelled page outcome counts for its host, the host's registered domain and
its suffix. From the top down, each level's beta prior is fitted to the spread
of its children's rates (method of moments) and centred on the parent's
posterior mean, so a host with few labels is shrunk towards its domain, that
towards its suffix, that towards all pages. A url is blocked when the lower
bound (a quantile) of its host's posterior rate of bad pages exceeds a limit: when
the beta distribution has at most ``1 - confidence`` of its mass below the limit.

Scale: one aggregation to hosts, combined before the shuffle; all later levels
work on the host table. Its reputations are written once, so the join with the
pages is broadcast where small enough and else splits hot hosts.

Nulls: a null page_id joins no label; a null url, or one without ``://``, has an empty host and path; hosts
without labels get their domain's, suffix's or the overall prior. Null labels
count for nothing. A page with several label rows counts once for each. Empty tables:
empty output, or the allowing prior for all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Holds for ``host`` and its subdomains where the path starts with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or where there is none."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null where none does."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest last, so it is tested first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


# Public suffixes of two labels that many hosts register names under; others count as one label.
SUFFIXES = tuple(f"{second}.{country}" for country, seconds in {
    "ar": "com gob net org", "au": "com edu gov id net org", "br": "com edu gov net org", "cn": "ac com edu gov net org",
    "hk": "com edu gov net org", "id": "ac co go or", "il": "ac co gov net org", "in": "ac co edu gov net org",
    "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go or", "kr": "ac co go ne or re", "mx": "com edu gob net org",
    "my": "com edu gov net org", "nz": "ac co govt net org school", "pl": "com edu gov net org", "sg": "com edu gov net org",
    "th": "ac co go in or", "tr": "com edu gov net org", "tw": "com edu gov net org", "ua": "com edu gov net org",
    "uk": "ac co gov ltd me net nhs org plc police sch", "za": "ac co gov net org"}.items() for second in seconds.split())


def name_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(host, r"^.*@|\.?(:[0-9]*)?$", "")


def is_address(name: Column) -> Column:
    """Whether the name is an IPv4 or a bracketed IPv6 address."""
    return name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")


def suffix_of(host: Column) -> Column:
    """The last label, the last two where ``SUFFIXES`` has them, or the whole of an address."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it, or the whole of an address."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*SUFFIXES), F.substring_index(name, ".", -3)).otherwise(two)


def prior_weight(level: DataFrame) -> float:
    """Weight of the beta prior over the level's rates, by the method of moments; one row comes to the driver.

    With overall rate m, rates r of units with n outcomes vary by about
    m(1-m) avg(1/n) from counting alone; what is left, v, gives m(1-m)/v - 1,
    held between 2 and 1000 (no spread left: 1000; no labels: 2).
    """
    r = F.col("bad") / F.col("n")
    got = level.where(F.col("n") > 0).agg(
        (F.sum("bad") / F.sum("n")).alias("m"), F.avg(r).alias("r"), F.avg(r * r).alias("rr"),
        F.avg(1 / F.col("n")).alias("inv")).first()
    if got["m"] is None:
        return 2.0
    m = got["m"]
    left = got["rr"] - 2 * m * got["r"] + m * m - m * (1 - m) * got["inv"]
    return min(max(m * (1 - m) / left - 1, 2.0), 1000.0) if left > 1e-12 else 1000.0


def _posterior(level: DataFrame, weight: float, centre: Column) -> list[Column]:
    return [(centre * weight + F.col("bad")).alias("alpha"),
            ((1 - centre) * weight + F.col("n") - F.col("bad")).alias("beta")]


def reputation(pages: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, n, bad, alpha, beta): each host's beta posterior of its rate of bad pages.

    ``pages``: page_id, host. ``labels``: page_id, bad (0/1). Hosts without
    labels are in it too, with their prior.
    """
    outcomes = pages.join(labels.where(F.col("bad").isNotNull()), "page_id", "left")
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = scratch.write(counts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    centre = (F.col("up_alpha") / (F.col("up_alpha") + F.col("up_beta")))
    as_up = lambda df, key: df.select(key, F.col("alpha").alias("up_alpha"), F.col("beta").alias("up_beta"))
    top = suffixes.select("suffix", *_posterior(suffixes, prior_weight(suffixes), F.lit((bad + 0.5) / (n + 1))))
    middle = domains.join(as_up(top, "suffix"), "suffix")
    middle = middle.select("domain", *_posterior(middle, prior_weight(domains), centre))
    low = hosts.join(as_up(middle, "domain"), "domain")
    return low.select("host", "n", "bad", *_posterior(low, prior_weight(hosts), centre))


STEPS, REACH = 400, 8  # points of an integral less one; deviations on either side of the mode


def bad_probability(limit: float) -> Column:
    """Posterior probability that a host's rate of bad pages exceeds ``limit``.

    On the scale s = log(t / (1 - t)) the beta density is t^a (1 - t)^b, log-concave
    with mode log(a / b) and deviation about sqrt(1/a + 1/b) for any a and b above 0,
    so the trapezoidal rule on either side of the limit gives some four digits.
    """
    a, b = F.col("alpha"), F.col("beta")
    mode, reach = F.log(a / b), REACH * F.sqrt(1 / a + 1 / b)
    softplus = lambda s: F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s)))
    height = lambda s: -a * softplus(-s) - b * softplus(s)
    low, high = mode - reach, mode + reach
    cut = F.greatest(low, F.least(high, F.lit(math.log(limit / (1 - limit)))))

    def area(start: Column, end: Column) -> Column:
        point = lambda i: F.exp(height(start + (end - start) * i / STEPS) - height(mode))
        half = lambda i: F.when((i == 0) | (i == STEPS), 0.5).otherwise(1.0)
        return (end - start) * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda sum_, i: sum_ + half(i) * point(i))

    above = area(cut, high)
    return above / (area(low, cut) + above)


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, max_bad: float = 0.25,
                confidence: float = 0.95) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_probability (of its host).

    ``pages``: page_id, url. ``labels``: page_id, bad (1: bad page). Without a
    rule a page is blocked when its host's rate of bad pages exceeds ``max_bad``
    with the posterior probability ``confidence`` or more.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = reputation(cut.select("page_id", "host"), labels.select("page_id", "bad"), scratch)
    sure = scratch.write(known.select("host", bad_probability(max_bad).alias("bad_probability")), "sure")
    judged = cut.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).join(sure, "host", "left")
    own = F.when(F.col("bad_probability") >= confidence, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.text").alias("rule"),
                         F.coalesce("fit.verdict", own).alias("verdict"), "bad_probability")

"""URL filter: explicit rules, then empirical-Bayes reputation of hosts, in DataFrame functions only.

Labelled page outcomes (bad or not) are counted for each host, registered domain and suffix. The bad
rate of a unit is shrunk by a beta-binomial prior towards that of the unit above: global, suffix, domain,
host. A level's prior strength is its moment estimate over all units of that level. A host is blocked when
the lower bound of its posterior bad rate exceeds ``LIMIT``; hosts without labelled pages get the posterior
of the nearest unit above them that has some.

Pages meet their host's row; the most frequent hosts meet it by a broadcast of fixed size, so no host
gathers its pages in one task. Rules come before reputation; the longest fitting rule wins.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and shares the
reputation of all such pages; null outcomes and outcomes of unknown pages are left out; repeated outcomes
of a page each count; without outcomes every page without a rule is allowed; IPv4 hosts are units of their
own at every level.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import ascii_lower, attach
from sqlcorpus.session import stage

#: Blocked when the posterior mean less so many standard deviations is above the limit.
LIMIT = 0.5
DEVIATIONS = 1.64
#: Least and greatest prior strength, in pages.
STRENGTH = (1.0, 1000.0)
#: FIXED VALUES: the suffixes of several labels that are told apart from domains where the caller gives no table.
TWO_LABEL_SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk me.uk net.uk com.au net.au org.au edu.au gov.au co.nz org.nz ac.nz co.jp ne.jp or.jp ac.jp go.jp "
    "com.br net.br org.br gov.br co.in net.in org.in ac.in co.kr or.kr com.cn net.cn org.cn gov.cn com.mx com.ar com.tr co.za co.il com.sg com.hk com.tw"
).split()
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule ``(verdict, host, path)``; nulls when none fits.

    A rule fits its host and the subdomains, for paths that start with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def units_of(host: Column, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host, without user and port.

    ``suffixes`` are the public ones of two labels or more; the longest that ends a host holds, else its last label.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:\d*)?\.?$", "")
    labels = F.split(bare, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    domain, suffix = two, F.element_at(labels, -1)
    by_size: dict[int, list[str]] = {}
    for s in suffixes:
        by_size.setdefault(s.count(".") + 1, []).append(s)
    for n in sorted(n for n in by_size if n > 1):
        last = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        more = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(1)), F.lit(n + 1)), ".")
        fits = last.isin(*by_size[n])
        domain, suffix = F.when(fits, more).otherwise(domain), F.when(fits, last).otherwise(suffix)
    whole = bare.rlike(r"^\d+\.\d+\.\d+\.\d+$") | (F.size(labels) < 2)
    return F.when(whole, bare).otherwise(domain), F.when(whole, bare).otherwise(suffix)


def _shrunk(units: DataFrame, key: str, prior: str) -> DataFrame:
    """``units`` with ``post``, the bad rate shrunk to ``prior``, and ``strength`` of that posterior.

    The prior strength comes from the moments of the beta-binomial: the variance of a unit's count is
    n m (1 - m) (1 + (n - 1) rho), and the strength is 1 / rho - 1.
    """
    m, n, k = F.col(prior), F.col("n"), F.col("bad")
    spread = F.sum(F.when(n > 1, (k - n * m) * (k - n * m) / n - m * (1 - m)))
    rho = spread / F.sum(F.when(n > 1, m * (1 - m) * (n - 1)))
    low, high = STRENGTH
    strength = F.least(F.greatest(F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(high)), F.lit(low)), F.lit(high))
    one = units.agg(F.coalesce(strength, F.lit(high)).alias("kappa"))
    return (
        units.withColumn("kappa", one.scalar())
        .withColumn("post", (k + F.col("kappa") * m) / (n + F.col("kappa")))
        .withColumn("strength", n + F.col("kappa"))
    )


def reputations(hosts: DataFrame, suffixes: Collection[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``(host, rate, strength)`` of every host of ``hosts(host, n, bad)``, ``n`` labelled pages of which ``bad`` are bad."""
    domain, suffix = units_of(F.col("host"), suffixes)
    hosts = stage(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("_domains"))
    everything = hosts.agg(F.coalesce((F.sum("bad") + 0.5) / (F.sum("n") + 1), F.lit(0.5)).alias("m"))
    suffixes = stage(_shrunk(suffixes.withColumn("m0", everything.scalar()), "suffix", "m0"), "suffixes")
    above = suffixes.select("suffix", F.col("post").alias("m1"), "_domains")
    domains = stage(_shrunk(attach(domains, above, ["suffix"], "_domains"), "domain", "m1"), "domains")
    own = hosts.groupBy("domain").agg(F.count(F.lit(1)).alias("_hosts"))
    above = domains.select("domain", F.col("post").alias("m2")).join(own, "domain")
    return _shrunk(attach(hosts, above, ["domain"], "_hosts"), "host", "m2").select("host", F.col("post").alias("rate"), "strength")


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url_col: str = "url",
    limit: float = LIMIT, deviations: float = DEVIATIONS, suffixes: Collection[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and the host's ``bad_rate`` and ``bound``.

    ``outcomes(page_id, bad)`` with ``bad`` 0 or 1. Urls are read once; outcomes meet them by page id.
    """
    url = F.col(url_col).cast("string")
    seen = stage(pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), "urls")
    counted = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = stage(
        seen.join(counted, "page_id", "left").groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("_pages")),
        "host-outcomes")
    known = stage(reputations(hosts, suffixes).join(hosts.select("host", "_pages"), "host"), "reputations")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("strength") + 1))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = attach(seen, known, ["host"], "_pages").withColumn("bound", F.col("rate") - deviations * deviation)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"),
        F.col("rate").alias("bad_rate"), "bound",
    )

"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled pages are outcomes of their hosts. A host's rate of bad pages has a beta prior whose mean
is the estimate of its registered domain; the domain's leans on its suffix, the suffix's on all
pages. How strongly each level leans comes from the outcomes themselves: the spread of the rates
below a common mean beyond what chance gives (beta-binomial moments). By the same spread a host
counts in its domain's estimate for no more outcomes than say something about other hosts, so one
large host doesn't speak for its domain. A host is blocked if its rate is above a limit with a given
posterior probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewright.llm.shared import bring, settle

#: A host is blocked if its rate of bad pages exceeds LIMIT with a probability of CONFIDENCE.
LIMIT = 0.5
CONFIDENCE = 0.9
#: Pseudo-pages that a level takes from the one above, whatever the outcomes' spread says.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: Up to so many outcomes and pseudo-pages the tail is summed up; beyond, the beta law is a normal one to 0.001.
EXACT_UP_TO = 20_000
_TERMS = 200

#: Labels that, before a country's two letters, are part of a public suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "nom", "or", "org")


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the pages of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _name(host: Column) -> Column:
    """The host without user, port and closing dot."""
    return F.regexp_extract(host, r"^(?:.*@)?(.*?)\.?(?::[0-9]*)?$", 1)


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where a second-level label stands before a country's."""
    return F.regexp_extract(_name(host), rf"(?:^|\.)((?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]*))$", 1)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; numeric addresses and bare suffixes are their own."""
    name = _name(host)
    own = F.regexp_extract(name, rf"([^.]+\.(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]|[^.]+))$", 1)
    return F.when(name.rlike(r"^[0-9.]+$") | (own == ""), name).otherwise(own)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as struct (text, verdict), or null; of equal lengths the longer host, then the text.

    ``rules`` are a parameter: a handful that stand in the plan, not data."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = [(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r) for r in ordered]
    return F.coalesce(*[F.when(fit, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for fit, r in fits],
                      F.lit(None).cast("struct<text:string,verdict:string>"))


def beta_tail(alpha: Column, beta: Column, x: float) -> Column:
    """P(rate > x) for a beta law with ``alpha`` + ``beta`` of up to EXACT_UP_TO: the incomplete beta function's
    continued fraction from its far end, on the side of the mean where it converges."""

    def log_gamma(z: Column) -> Column:
        # Stirling's series at z + 8
        w = z + 8
        series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (12 * w) - 1 / (360 * F.pow(w, 3)) + 1 / (1260 * F.pow(w, 5))
        product = z
        for k in range(1, 8):
            product = product * (z + k)
        return series - F.log(product)

    below = x < (alpha + 1) / (alpha + beta + 2)
    a, b = F.when(below, alpha).otherwise(beta), F.when(below, beta).otherwise(alpha)
    y = F.when(below, x).otherwise(1 - x)

    def term(m: Column) -> Column:
        k = F.floor(m / 2)
        even = k * (b - k) * y / ((a + 2 * k - 1) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * y / ((a + 2 * k) * (a + 2 * k + 1))
        return F.when(m % 2 == 0, even).otherwise(odd)

    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1)), F.lit(1.0), lambda f, m: 1 + term(m) / f)
    head = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(y) + b * F.log(1 - y)) / a
    return F.when(below, 1 - head / fraction).otherwise(head / fraction)


def exceeds(alpha: Column, beta: Column, limit: float, confidence: float) -> Column:
    """Is the rate above ``limit`` with a probability of ``confidence`` or more?"""
    n = alpha + beta
    z = (alpha / n - limit) / F.sqrt(alpha * beta / (n * n * (n + 1)))
    return F.when(n <= EXACT_UP_TO, beta_tail(alpha, beta, limit) >= confidence).otherwise(z >= NormalDist().inv_cdf(confidence))


def reputation(pages: DataFrame, outcomes: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE) -> DataFrame:
    """host, pages, n, bad, rate and blocked for every host of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad) are labelled pages; bad is 0 or 1, null ids and labels say nothing. A page with several
    labels, or that stands in several rows, counts as often. Outcomes are summed up per id, pages per id and host,
    before they meet, so no page is a hot key. ``n`` outcomes of the host, ``bad`` of them bad; ``rate`` is the
    posterior mean. Rows whose url has no host are the host ''.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"))
    said = (outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("bad").cast("long")).alias("_bad")))
    labelled = (own.where("page_id IS NOT NULL").groupBy("page_id", "host").agg(F.count(F.lit(1)).alias("_rows")).join(said, "page_id")
                .groupBy("host").agg(F.sum(F.col("_rows") * F.col("_n")).alias("n"), F.sum(F.col("_rows") * F.col("_bad")).alias("bad")))
    hosts = (own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(labelled, "host", "left")
             .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "pages",
                     F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")))
    hosts = settle(hosts, "host-outcomes")
    s_host = strength(hosts, "domain")
    domains = settle(effective(hosts, s_host, "suffix", "domain"), "domain-outcomes")
    s_domain = strength(domains, "suffix")
    suffixes = settle(effective(domains, s_domain, "suffix"), "suffix-outcomes")
    s_suffix = strength(suffixes)
    n, bad = effective(suffixes, s_suffix).select("n", "bad").first()

    def shrunk(s: float, above: Column) -> Column:
        return (F.col("bad") + F.lit(s) * above) / (F.col("n") + F.lit(s))

    mean = F.lit((bad + 0.5) / (n + 1.0))
    suffixes = suffixes.select("suffix", "below", shrunk(s_suffix, mean).alias("above"))
    domains = bring(domains.withColumnRenamed("below", "hosts"), ["suffix"], suffixes, "below", ["above"])
    domains = domains.select("domain", "hosts", shrunk(s_domain, F.col("above")).alias("above"))
    hosts = bring(hosts, ["domain"], domains, "hosts", ["above"])
    alpha = F.col("bad") + F.lit(s_host) * F.col("above")
    beta = F.col("n") - F.col("bad") + F.lit(s_host) * (1 - F.col("above"))
    return hosts.select("host", "pages", "n", "bad", shrunk(s_host, F.col("above")).alias("rate"),
                        exceeds(alpha, beta, limit, confidence).alias("blocked"))


def strength(rows: DataFrame, *parent: str) -> float:
    """Pseudo-pages of the prior that the ``rows`` (n, bad) of a parent share: moments of the beta-binomial law, added
    up over all parents. A parent with one row says nothing."""
    sums = (rows.where("n > 0").groupBy(*parent)
            .agg(F.sum("n").alias("n"), F.sum("bad").alias("k"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.col("n")).alias("n2"),
                 F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("r2")).where("n > 0"))
    by_chance = F.col("k") / F.col("n") * (1 - F.col("k") / F.col("n"))
    excess = F.col("r2") - F.col("k") * F.col("k") / F.col("n") - by_chance * (F.col("m") - 1)
    room = by_chance * (F.col("n") - F.col("n2") / F.col("n") - (F.col("m") - 1))
    over, most = sums.agg(F.sum(excess), F.sum(room)).first()
    if not most or over <= 0:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, most / over - 1))


def effective(rows: DataFrame, s: float, *parent: str) -> DataFrame:
    """n and bad of each parent, and the number of rows ``below``. Of n outcomes with one common rate, as many count as
    would say as much about the parent if each had a rate of its own: n (s + 1) / (n + s)."""
    weight = F.lit(s + 1.0) / (F.col("n") + F.lit(s))
    return rows.groupBy(*parent).agg(F.coalesce(F.sum(F.col("n") * weight), F.lit(0.0)).alias("n"),
                                     F.coalesce(F.sum(F.col("bad") * weight), F.lit(0.0)).alias("bad"), F.count(F.lit(1)).alias("below"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = LIMIT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url; other columns are left aside).

    The longest rule that fits decides; without one, pages of hosts that ``reputation`` blocks are blocked, and all
    others allowed, so also those of hosts without outcomes whose domain and suffix have a good record. Null urls and
    urls without ``://`` have empty host and path. Rows without page_id and repeated rows are judged like others; an
    empty table gives no rows, and without outcomes nothing is blocked but by rules.
    """
    hosts = settle(reputation(pages, outcomes, limit, confidence).select("host", "pages", "blocked"), "host-verdicts")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = bring(ruled, ["host"], hosts, "pages", ["blocked"])
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"))

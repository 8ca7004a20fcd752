"""URL filtering by rules and by empirical-Bayes host reputation; DataFrame functions only.

Labelled pages give each host its bad outcomes k of n. A beta-binomial prior links the levels: the corpus mean is
the prior mean of a suffix (com), the suffix's posterior mean that of a registered domain (example.com), and the
domain's that of a host. The strength of a prior is estimated at its level from the spread of the units around
their prior means (moments of the beta-binomial). A host is blocked when the lower bound of its posterior bad
rate shows odds of more than LIFT times the corpus's: a host with few labelled pages stays near its domain and is allowed.

Defined cases: null urls and urls without :// have empty host and path; hosts without labelled pages take their
domain's mean; labels repeated for a page count once, the worst outcome holds; without any labels every host has
the mean 1/2 and none passes the bound; a bound equal to the threshold is allowed; rules always win over the
reputation, the longest first; very long urls are read whole; repeated rows are judged each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A host is blocked when the odds of a bad page exceed LIFT times those of the whole corpus with the confidence of
#: Z standard deviations of its posterior.
LIFT = 2.0
Z = 1.645
#: Second-level labels that belong to the suffix when a two-letter label follows (co.uk).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, F.lit("://")) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one. rules: a short list, a parameter."""
    found = [
        (verdict, h + p, ((host == h) | host.endswith("." + h)) & path.startswith(p))
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*[F.when(fits, F.lit(r)) for _, r, fits in found]), F.coalesce(*[F.when(fits, F.lit(v)) for v, _, fits in found])


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix and the registered domain: the suffix and one label more (the host itself if there is none)."""
    parts = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    n = F.size(parts)
    two = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, F.when(n >= 2, -2).otherwise(-1)).isin(*SECOND_LEVEL)
    k = F.when(two, 2).otherwise(1)
    last = lambda m: F.array_join(F.slice(parts, F.greatest(n - m + 1, F.lit(1)), m), ".")
    return last(k), last(k + 1)


def strength(units: DataFrame, mean: str) -> float:
    """Prior strength of a level (one row per unit: n, k and its prior mean), by the moments of the beta-binomial.

    With p = k / n, the expected sum of n (p - m)^2 / (m (1 - m)) is the number of units plus rho times the sum of
    n - 1; strength = 1 / rho - 1, rho kept within [0.001, 0.9]. One row of sums comes back, whatever the input."""
    m = F.col(mean)
    spread = F.col("n") * F.pow(F.col("k") / F.col("n") - m, 2) / (m * (1 - m))
    s = units.filter("n > 0").agg(F.sum(spread).alias("s"), F.count("*").alias("u"), F.sum(F.col("n") - 1).alias("d")).first()
    rho = (s["s"] - s["u"]) / s["d"] if s["d"] else 0.001
    return 1 / min(0.9, max(0.001, rho)) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, k, posterior_mean, lower (bound of the bad rate), corpus (the mean over all) for every host.

    pages: page_id, host. outcomes: page_id, bad (0 or 1)."""
    worst = outcomes.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(worst, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = cut(hosts.select("*", suffix.alias("suffix"), domain.alias("domain")))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    mean = (whole["k"] + 1) / (whole["n"] + 2)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(mean))

    def shrunk(units: DataFrame, name: str) -> DataFrame:
        m = strength(units, "prior")
        return units.withColumn(name, (F.col("k") + m * F.col("prior")) / (F.col("n") + m))

    suffixes = cut(shrunk(suffixes, "suffix_mean").select("suffix", "suffix_mean"))
    domains = cut(shrunk(domains.join(suffixes, "suffix").withColumnRenamed("suffix_mean", "prior"), "domain_mean").select("suffix", "domain", "domain_mean"))
    hosts = hosts.join(domains, ["suffix", "domain"]).withColumnRenamed("domain_mean", "prior")
    m = strength(hosts, "prior")
    a, b = F.col("k") + m * F.col("prior"), F.col("n") - F.col("k") + m * (1 - F.col("prior"))
    post = a / (a + b)
    return hosts.select("host", "n", "k", post.alias("posterior_mean"), F.lit(mean).alias("corpus"), (post - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, lift: float = LIFT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's lower bound, for every page."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(parsed.select("page_id", "host"), outcomes, z).select("host", "lower", "corpus")
    threshold = lift * F.col("corpus") / (1 - F.col("corpus") + lift * F.col("corpus"))
    verdict = F.coalesce(said, F.when(F.col("lower") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "lower")

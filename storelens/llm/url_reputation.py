"""URL filter by rules and by host reputation, in DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain
and suffix.  A suffix's rate is shrunk towards the rate of all pages, a
domain's towards its suffix, a host's towards its domain, each with a
beta-binomial prior whose strength is fitted over that level's groups.  A host
is blocked when the lower bound of its posterior is under the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.llm.shrinkage import moments

#: (host suffix, path prefix, verdict); the longest fitting rule wins.
DEFAULT_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of two labels, under which a registered domain has three.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")
MIN_GOOD_RATE = 0.5
#: Normal quantile of the one-sided posterior bound (95 %).
BOUND_Z = 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL, both
    empty for null or for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    host = F.translate(F.substring_index(rest, "/", 1), _UPPER, _LOWER)
    slash = F.instr(rest, "/")
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return host, path


def rule_for(host: Column, path: Column, rules=DEFAULT_RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as ``host/path``) and its verdict, null when none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = F.when(fits, F.lit(suffix + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def domain_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    two = F.substring_index(host, ".", -2)
    long_suffix = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(long_suffix, two).otherwise(F.substring_index(host, ".", -1))
    return F.when(long_suffix, F.substring_index(host, ".", -3)).otherwise(two), suffix


def host_reputation(labelled: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host``, posterior ``mean`` and lower ``bound`` of its good rate.

    ``labelled`` has ``host`` and ``good`` (1 or 0; null rows are not counted);
    ``hosts`` has every ``host`` to judge.  Host counts are partial-aggregated,
    then summed upwards, so nothing larger than one row per host is joined.
    """
    domain, suffix = domain_levels(F.col("host"))
    counts = (labelled.where(F.col("good").isNotNull()).groupBy("host")
              .agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")))
    level = (hosts.select("host").distinct().join(counts, "host", "left")
             .select("host", domain.alias("domain"), suffix.alias("suffix"),
                     F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("n", F.lit(0)).alias("n")))
    domains = level.groupBy("suffix", "domain").agg(F.sum("good").alias("d_good"), F.sum("n").alias("d_n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("d_good").alias("s_good"), F.sum("d_n").alias("s_n"))
    root, k_s = moments(suffixes, ["s_good"], "s_n")["s_good"]
    _, k_d = moments(domains, ["d_good"], "d_n")["d_good"]
    _, k_h = moments(level, ["good"], "n")["good"]
    suffixes = suffixes.select("suffix", ((F.col("s_good") + root * k_s) / (F.col("s_n") + k_s)).alias("s_rate"))
    domains = domains.join(suffixes, "suffix").select(
        "suffix", "domain", ((F.col("d_good") + F.col("s_rate") * k_d) / (F.col("d_n") + k_d)).alias("d_rate"))
    total = F.col("n") + k_h
    mean = (F.col("good") + F.col("d_rate") * k_h) / total
    return (level.join(domains, ["suffix", "domain"])
            .select("host", mean.alias("mean"), (mean - BOUND_Z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bound")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules=DEFAULT_RULES, min_good: float = MIN_GOOD_RATE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``outcomes(page_id, good)`` labels some of the pages, one row per page id.
    A rule's verdict wins over the reputation.  The join of pages to their host's
    reputation is left to AQE, which splits a hot host or broadcasts a small
    side by its measured size.
    """
    host, path = split_url(F.col("url"))
    rows = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
            .select("page_id", host.alias("host"), path.alias("path")))
    labelled = rows.join(outcomes.select(F.col("page_id").alias("o_id"), "good"), F.col("page_id") == F.col("o_id")).select("host", "good")
    fame = host_reputation(labelled, rows).select(F.col("host").alias("f_host"), "bound")
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") < min_good, "block").otherwise("allow")
    return (rows.join(fame, F.col("host") == F.col("f_host"), "left")
            .select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict")))

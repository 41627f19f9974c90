"""URL filter: explicit rules first, else empirical-Bayes reputation of the host.

Labelled page outcomes are binomial counts per host. Each level of suffix,
registered domain and host gets a beta prior whose mean is the posterior mean of
the level above and whose concentration comes from the spread of the level's own
rates (method of moments of the beta-binomial). A host is blocked when even the
upper posterior bound of its rate of good pages is below ``threshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from quaymaster.llm.common import lower_ascii

# (verdict, host, path): the rule fits the host, its subdomains and paths that start so.
Rule = tuple[str, str, str]
SECOND_LEVEL = "co|com|org|net|ac|gov|edu"  # with a two-letter country label: one public suffix
SUFFIX = rf"(?:^|\.)((?:(?:{SECOND_LEVEL})\.[a-z][a-z])|[^.]+)$"
DOMAIN = rf"(?:^|\.)([^.]+\.(?:(?:(?:{SECOND_LEVEL})\.[a-z][a-z])|[^.]+))$"
ADDRESS = r"^[0-9.]+$|^\["


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_host(host: Column) -> tuple[Column, Column, Column]:
    """Host name without user and port, its registered domain and its public suffix."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*|\.+)$", "")
    address = name.rlike(ADDRESS)
    suffix = F.when(address, name).otherwise(F.regexp_extract(name, SUFFIX, 1))
    domain = F.when(address, name).otherwise(F.coalesce(F.nullif(F.regexp_extract(name, DOMAIN, 1), F.lit("")), name))
    return name, domain, suffix


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null; of equal length the first listed."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def _level(children: DataFrame, parents: DataFrame, child: str, parent: str, least_spread: float, most_spread: float) -> DataFrame:
    """Posterior means of ``child`` groups; ``parents`` has parent, mean of the level above."""
    with_mean = children.join(parents, parent)
    m, n, k = F.col("prior_mean"), F.col("n"), F.col("k")
    excess = F.sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - F.count(F.lit(1))
    rho = F.greatest(F.lit(least_spread), F.least(F.lit(most_spread), F.coalesce(excess / F.nullif(F.sum(n - 1), F.lit(0)), F.lit(least_spread))))
    # One row for the whole level: its concentration.
    level = with_mean.filter(n > 0).agg((1 / rho - 1).alias("kappa"))
    a = F.col("kappa") * m + k
    b = F.col("kappa") * (1 - m) + n - k
    return (with_mean.join(F.broadcast(level))
            .select(child, "n", "k", a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean")))


def host_reputation(outcomes: DataFrame, least_spread: float = 0.001, most_spread: float = 0.5) -> DataFrame:
    """Beta posterior per host of ``outcomes`` (host, good boolean or null).

    Unlabelled rows (good is null) count for no group but their hosts still get the
    posterior their domain and suffix give them. Without any label every mean is 0.5.
    Returns host, domain, suffix, labelled, good, alpha, beta, mean, sd.
    """
    name, domain, suffix = split_host(F.col("host"))
    counts = (outcomes.groupBy("host").agg(F.count("good").alias("n"), F.count(F.when(F.col("good"), 1)).alias("k"))
              .withColumns({"domain": domain, "suffix": suffix}))
    hosts = counts
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(""))
    root = suffixes.groupBy("root").agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("prior_mean"))
    up = lambda df, key: df.select(key, F.col("mean").alias("prior_mean"))
    of_suffix = _level(suffixes, root, "suffix", "root", least_spread, most_spread)
    of_domain = _level(domains, up(of_suffix, "suffix"), "domain", "suffix", least_spread, most_spread)
    of_host = _level(hosts, up(of_domain, "domain"), "host", "domain", least_spread, most_spread)
    a, b = F.col("a"), F.col("b")
    return of_host.select("host", F.col("n").alias("labelled"), F.col("k").alias("good"), a.alias("alpha"),
                          b.alias("beta"), "mean", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), threshold: float = 0.5,
               z: float = 1.645, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict per page: the longest fitting rule's, else block when mean + z * sd of the host is below ``threshold``.

    ``outcomes`` has (id_col, good boolean): labelled pages, several labels of a page all
    count; labels with a null id, a null verdict or no page are ignored.
    Null urls and urls without ``://`` have an empty host and path and share one
    reputation. Repeated pages are judged each; empty tables give an empty result.
    Only id and url are read from ``pages``, so other columns cannot clash.
    Returns id_col, host, path, rule, verdict, reputation, upper_bound.
    """
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = (outcomes.filter(F.col(id_col).isNotNull() & F.col("good").isNotNull())
              .select(F.col(id_col).alias("id"), "good"))
    labelled = seen.select("id", "host").join(labels, "id", "left").select("host", "good")
    reputation = host_reputation(labelled).select("host", "mean", "sd")
    rule, decided = longest_rule(F.col("host"), F.col("path"), rules)
    upper = F.col("mean") + z * F.col("sd")
    return seen.join(reputation, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(decided, F.when(upper < threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("mean").alias("reputation"), upper.alias("upper_bound"))

"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages (1 bad, 0 good) are summed by host. Bad shares shrink through
beta-binomial priors: the whole table is the prior of each suffix, a suffix of its
registered domains, a registered domain of its hosts, each without the pages in question.
A prior's strength is that of a beta distribution with the between-group variance found by
the method of moments, and at most the pages that it rests on. A page
is blocked if the lower bound of its host's posterior, mean - z * standard deviation, is
at least the threshold, so a few bad pages condemn no host.

Only DataFrame functions; counts are pre-aggregated, so a host that owns a third of all
pages costs one row per task. Each level is written before the next, which keeps plans small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

#: Rules of the registered query: (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Public suffixes of two labels; a registered domain has one label more than its suffix.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za", "co.kr")
Z, THRESHOLD = 1.645, 0.5
#: Bounds of a prior's strength, in pages.
LEAST, MOST = 1.0, 1000.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(before, _UPPER, _LOWER), after


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    long = two.isin(*LONG_SUFFIXES)
    return F.when(long, two).otherwise(last), F.when(long, F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, by: str, parents: DataFrame) -> DataFrame:
    """(by, k): the prior strength that the spread of the groups (by, n, bad) about their parent's mean suggests."""
    # Moments: E[(bad/n - m)^2 n] = m (1 - m) (1 + (n - 1) / (k + 1)), summed over groups.
    mean = (F.col("m") * F.col("k") + F.col("bad")) / (F.col("k") + F.col("n"))
    seen = groups.where("n > 0").select(by, "n", "bad").join(parents.select(by, mean.alias("mean")), by).groupBy(by).agg(
        F.sum((F.col("bad") / F.col("n") - F.col("mean")) ** 2 * F.col("n")).alias("s"), F.count("*").alias("g"), F.sum("n").alias("n"), F.first("mean").alias("m")
    )
    spread = F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-6))
    rho = (F.col("s") / spread - F.col("g")) / F.greatest(F.col("n") - F.col("g"), F.lit(1))
    k = F.when(rho <= 1 / (MOST + 1), MOST).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), 1 / rho - 1)))
    return seen.select(by, k.alias("k"))


def _shrink(groups: DataFrame, key: str, by: str, parents: DataFrame) -> DataFrame:
    """``groups`` (key, by, n, bad) with their priors: mean m and strength k.

    A group's prior is its parent's posterior without the group's own pages, and no stronger
    than what that rests on, so that no page counts twice.
    """
    up = parents.join(_strength(groups, by, parents).withColumnRenamed("k", "spread"), by, "left")
    up = up.select(by, F.col("m").alias("pm"), F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("bad").alias("pbad"), F.coalesce("spread", F.lit(MOST)).alias("spread"))
    rest = F.col("pk") + F.col("pn") - F.col("n")
    m = (F.col("pm") * F.col("pk") + F.col("pbad") - F.col("bad")) / rest
    return groups.join(up, by).select(*groups.columns, m.alias("m"), F.least(F.col("spread"), rest).alias("k"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` (host, bad 0/1/null) -> (host, n, mean, low) for every host in it.

    A null ``bad`` is a page without a label: its host gets its prior. An empty host is a host of its own.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumn("suffix", suffix).withColumn("domain", domain).withColumn("all", F.lit(0)), "url-hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix", "all").agg(*sums)
    suffixes = domains.groupBy("suffix", "all").agg(*sums)
    whole = suffixes.groupBy("all").agg(*sums).select("all", "n", "bad", F.lit(0.5).alias("m"), F.lit(2.0).alias("k"))
    of_suffix = materialize(_shrink(suffixes, "suffix", "all", whole).drop("all"), "url-suffixes")
    of_domain = materialize(_shrink(domains.drop("all"), "domain", "suffix", of_suffix).drop("suffix"), "url-domains")
    of_host = _shrink(hosts.drop("all", "suffix"), "host", "domain", of_domain)
    size = F.col("k") + F.col("n")
    of_host = of_host.withColumn("mean", (F.col("m") * F.col("k") + F.col("bad")) / size)
    return of_host.select("host", "n", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))).alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, reputation (lower bound).

    ``labels`` (page_id, bad 0/1) are the known outcomes, which may cover any part of the
    pages. Null urls: empty host and path, judged as the host ''. A page labelled twice counts
    as bad if any label is. Null ids and repeated rows are judged each; an empty table gives no
    rows, and without labels every host has the reputation of one bad in two.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = rows.join(known, "page_id", "left").select("host", "bad")
    reputation = host_reputation(outcomes)
    judged = rows.join(reputation.select("host", F.round("low", 9).alias("reputation")), "host", "left")
    say = F.coalesce("ruled", F.when(F.col("reputation") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", say.alias("verdict"), "reputation")


def oracle_sql(rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> str:
    """``judge_urls`` over ``pages``, with the ``labels`` of the same ids, in DuckDB's SQL."""
    whens = {"rule": [], "ruled": []}
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash + rest}')"
        whens["rule"].append(f"WHEN {fits} THEN '{text}'")
        whens["ruled"].append(f"WHEN {fits} THEN '{what}'")
    long = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)

    def level(name: str, groups: str, key: str, by: str, parents: str) -> str:
        return f"""
{name}_s AS (SELECT g.{by}, sum((g.bad / g.n - p.mean) ** 2 * g.n) AS s, count(*) AS g, sum(g.n) AS n, any_value(p.mean) AS m
  FROM {groups} g JOIN (SELECT {by}, (m * k + bad) / (k + n) AS mean FROM {parents}) p USING ({by}) WHERE g.n > 0 GROUP BY g.{by}),
{name}_r AS (SELECT {by}, (s / greatest(m * (1 - m), 1e-6) - g) / greatest(n - g, 1) AS rho FROM {name}_s),
{name}_k AS (SELECT p.{by}, p.m, p.k, p.n, p.bad, coalesce(CASE WHEN rho <= 1 / ({MOST} + 1) THEN {MOST} ELSE least({MOST}, greatest({LEAST}, 1 / rho - 1)) END, {MOST})::DOUBLE AS spread
  FROM {parents} p LEFT JOIN {name}_r USING ({by})),
{name} AS (SELECT g.*, (p.m * p.k + p.bad - g.bad) / (p.k + p.n - g.n) AS m, least(p.spread, p.k + p.n - g.n) AS k FROM {groups} g JOIN {name}_k p USING ({by}))"""

    return f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (SELECT *, CASE {" ".join(whens["rule"])} END AS rule, CASE {" ".join(whens["ruled"])} END AS ruled FROM split),
known AS (SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
by_host AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM judged LEFT JOIN known USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS p FROM by_host),
hosts AS (SELECT host, n, bad, 0 AS al, CASE WHEN array_to_string(p[-2:], '.') IN ({long}) THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
  CASE WHEN array_to_string(p[-2:], '.') IN ({long}) THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM parts),
domains AS (SELECT domain, suffix, al, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, al, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
whole AS (SELECT al, sum(n) AS n, sum(bad) AS bad, 0.5::DOUBLE AS m, 2.0::DOUBLE AS k FROM suffixes GROUP BY al),{level("of_suffix", "suffixes", "suffix", "al", "whole")},{level("of_domain", "domains", "domain", "suffix", "of_suffix")},{level("of_host", "hosts", "host", "domain", "of_domain")},
post AS (SELECT host, (m * k + bad) / (k + n) AS mean, k + n AS size FROM of_host),
low AS (SELECT host, round(mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)), 9) AS reputation FROM post)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN reputation >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, reputation
FROM judged LEFT JOIN low USING (host)"""

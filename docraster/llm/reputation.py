"""URL filters: rules first, then an empirical-Bayes reputation of hosts.

Labelled outcomes of pages (bad or not) are counted per host, registered domain and suffix. Each level's rates are
shrunk to the level above by a beta-binomial prior whose strength comes from the spread of the rates at that level
(method of moments): suffixes to all pages, domains to their suffix, hosts to their domain. A host is blocked if the
lower bound of its posterior rate of bad pages (mean minus z standard deviations) lies above ``lift`` times the rate
of all labelled pages: it is surely that much worse than pages are. Hosts without labelled pages have their domain's
rate.

Suffixes under which names are registered come from a table (column suffix) of the caller's; the short list below is
for want of one. A host's suffix is the longest of that table, or else its last label.

Counting is one grouped sum per level, each over the level below; frequent hosts' verdicts reach their pages by a
broadcast of at most 10,000 hosts, all others by a join.

Nulls: a url that is null or has no ``://`` has an empty host and path, and an empty host is judged as a host of its
own. A null outcome or page_id counts for nothing. Repeated pages count as often as they occur, as do repeated
outcomes. Without any outcome everything that no rule names is allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import hub_join, kept

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LIFT = 1.645, 1.5
#: Some suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. rules: (host/path, verdict), a list short enough to stand in the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(set(rules), key=lambda r: (len(r[0]), r)):  # the longest is tested first
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds domain (registered domain) and suffix to each host."""
    if suffixes is None:
        suffixes = hosts.sparkSession.createDataFrame([(x,) for x in TWO_LABEL_SUFFIXES], "suffix string")
    known = suffixes.select(F.trim(F.translate("suffix", _UPPER, _LOWER)).alias("tail")).where("tail <> ''").distinct()
    labels = F.split(F.regexp_replace("host", r":\d*$", ""), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("labels", -k, k), ".").alias("tail")))
    hosts = hosts.withColumn("labels", labels)
    found = hosts.select("host", F.explode(tails).alias("s")).select("host", "s.*").join(known, "tail").groupBy("host").agg(F.max("k").alias("k"))
    out = hosts.join(found, "host", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    last = lambda k: F.array_join(F.slice("labels", -F.least(k, F.size("labels")), F.least(k, F.size("labels"))), ".")
    return out.withColumns({"domain": last(F.col("k") + 1), "suffix": last(F.col("k"))}).drop("labels", "k")


def strength(groups: DataFrame, least: float = 1.0, most: float = 10_000.0) -> float:
    """Weight of the prior, in pages, from the spread of the groups' rates about their common rate."""
    s = groups.where("n > 0").agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b")).first()
    if not s["n"] or s["g"] < 2 or s["bad"] in (0, s["n"]):
        return most
    p = s["bad"] / s["n"]
    spread = s["b"] - s["n"] * p * p  # sum of n * (rate - p)^2
    room = p * (1 - p) * (s["n"] - s["nn"] / s["n"] - (s["g"] - 1))
    rho = (spread - p * (1 - p) * (s["g"] - 1)) / room if room > 0 else 0.0
    return most if rho <= 1 / (1 + most) else max(least, 1 / rho - 1)


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None, z: float = Z, lift: float = LIFT) -> DataFrame:
    """host, pages, n and bad (of the labelled ones), rate and bound (of the posterior), verdict of each host.

    pages: page_id, host; outcomes: page_id, bad (0 or 1).
    """
    labelled = pages.join(outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()), "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("*").alias("pages"))
    hosts = kept(with_levels(hosts, suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = ends.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return hosts.select("host", "pages", "n", "bad", F.lit(0.0).alias("rate"), F.lit(0.0).alias("bound"), F.lit("allow").alias("verdict"))
    k_suffix, k_domain, k_host = strength(ends), strength(domains), strength(hosts)
    shrunk = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    ends = ends.select("suffix", shrunk(F.lit(total["bad"] / total["n"]), k_suffix).alias("prior"))
    domains = domains.join(ends, "suffix").select("domain", "suffix", shrunk(F.col("prior"), k_domain).alias("prior"))
    hosts = hosts.join(domains, ["domain", "suffix"]).withColumn("rate", shrunk(F.col("prior"), k_host))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + k_host + 1))
    return hosts.select("host", "pages", "n", "bad", "rate", bound.alias("bound"), F.when(bound > lift * total["bad"] / total["n"], "block").otherwise("allow").alias("verdict"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), suffixes: DataFrame | None = None, z: float = Z, lift: float = LIFT) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    by_host = kept(reputations(p, outcomes, suffixes, z, lift).select("host", "pages", F.col("verdict").alias("own")), "verdicts")
    p = p.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    return hub_join(p, by_host, "host", count="pages").select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "own").alias("verdict"))

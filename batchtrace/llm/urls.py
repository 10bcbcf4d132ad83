"""URL filter: rules by host and path first, host reputation for the rest, in DataFrame operations only.

A host's share of bad pages is estimated by empirical Bayes: the counts of labelled pages update a
beta prior whose mean is the posterior mean of the host's registered domain, which has the prior of
its suffix, which has that of all pages. A posterior that serves as a prior leaves out the counts of the
very host (or domain, or suffix) it is the prior of, so no outcome counts twice. How strongly a level's prior counts is fitted from that
level's own spread (beta-binomial, by moments). A page without a rule is blocked if the lower posterior
bound of its host's bad share is above a limit: few bad pages are not enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.llm.shared import LOWER, UPPER, store

#: Bad share above which a host is blocked, deviations below the posterior mean at which it is measured.
MAX_BAD, DEVIATIONS = 0.3, 1.645
#: Bounds of a prior's strength, in pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: Rules are part of the plan; more belong in a table.
MAX_RULES = 1000
#: Suffixes of more than one label, below which names are registered. Any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")

Rule = tuple[str, str]


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """Behind the host, up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffix(name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The listed suffix that a host without port stands under, else its last label."""
    listed = [F.when(name.endswith("." + s), F.lit(s)) for s in sorted(suffixes, key=lambda s: (-len(s), s))]
    return F.coalesce(*listed, F.substring_index(name, ".", -1))


def registered(name: Column, under: Column) -> Column:
    """The suffix and the label before it; numeric addresses and bare names as they are."""
    front = F.substring(name, F.lit(1), F.length(name) - F.length(under) - 1)
    return F.when((F.length(name) <= F.length(under) + 1) | name.rlike(r"^[0-9.]+$|^\["), name).otherwise(
        F.concat(F.substring_index(front, ".", -1), F.lit("."), under))


def rule_for(host_: Column, path_: Column, rules: list[tuple[str, Rule]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the path's start."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, (h, p) in sorted(rules, key=lambda r: len(r[1][0] + r[1][1])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _level(rows: DataFrame) -> DataFrame:
    """``rows`` (bad, seen, prior) with alpha, beta of the posterior; the strength of the priors is fitted
    from all rows. E[seen * (bad/seen - prior)^2] = prior * (1 - prior) * (1 + (seen - 1) / (strength + 1))."""
    spread = F.col("prior") * (1 - F.col("prior"))
    had = F.col("seen") > 0
    got = rows.agg(F.sum(F.when(had, F.pow(F.col("bad") - F.col("seen") * F.col("prior"), F.lit(2)) / F.col("seen") - spread)).alias("over"),
                   F.sum(F.when(had, spread * (F.col("seen") - 1))).alias("room"))
    share = F.when(F.col("room") > 0, F.col("over") / F.col("room"))
    least, most = 1 / (MAX_STRENGTH + 1), 1 / (MIN_STRENGTH + 1)
    strength = got.select((1 / F.least(F.greatest(F.coalesce(share, F.lit(least)), F.lit(least)), F.lit(most)) - 1).alias("strength"))
    # one row
    return (rows.crossJoin(F.broadcast(strength))
            .withColumn("alpha", F.col("prior") * F.col("strength") + F.col("bad"))
            .withColumn("beta", (1 - F.col("prior")) * F.col("strength") + F.col("seen") - F.col("bad")).drop("strength", "prior"))


def _without_own(rows: DataFrame) -> DataFrame:
    """prior: mean of a beta distribution with ``a`` of ``n`` bad, less the row's own counts in it."""
    return rows.withColumn("prior", (F.col("a") - F.col("bad")) / (F.col("n") - F.col("seen"))).drop("a", "n")


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, domain, suffix, seen, bad, mean and bound (lower) of every host in ``outcomes`` (host, bad:
    0, 1 or null for a page without a label). Hosts without a labelled page have their domain's mean."""
    name = F.rtrim(F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("seen"), F.sum(F.coalesce(F.col("bad"), F.lit(0)).cast("long")).alias("bad"))
    hosts = hosts.withColumn("_name", name).withColumn("suffix", suffix(F.col("_name"), suffixes))
    hosts = store(hosts.withColumn("domain", registered(F.col("_name"), F.col("suffix"))).drop("_name"), "url-hosts")
    sums = [F.sum("seen").alias("seen"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    tops = domains.groupBy("suffix").agg(*sums)
    every = tops.agg(*sums).select((F.coalesce("bad", F.lit(0)) + 0.5).alias("a"), (F.coalesce("seen", F.lit(0)) + 1).alias("n"))

    def under(rows: DataFrame, of: DataFrame, name_: str) -> DataFrame:
        above = of.select(name_, F.col("alpha").alias("a"), (F.col("alpha") + F.col("beta")).alias("n"))
        return _level(_without_own(rows.join(above, name_)))

    tops = _level(_without_own(tops.crossJoin(F.broadcast(every))))  # one row
    domains = store(under(domains, tops, "suffix"), "url-domains")
    out = under(hosts, domains, "domain")
    size = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / size
    return out.withColumn("mean", mean).withColumn("bound", mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (size + 1))).drop("alpha", "beta")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, Rule]], carry: list[str] | None = None,
                max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``carry`` columns (default: all) plus host, path, rule, verdict, bad_share and bad_bound.

    ``outcomes`` has page_id and bad (0, 1, null: unknown); ``rules`` are (verdict, (host, path)): they
    fit the host and all subdomains where the path starts with the rule's, the longest wins (of equally
    long ones the last). Without a rule the verdict is block where the lower bound of the host's bad share
    is above ``max_bad``, else allow.

    Null urls and those without :// have an empty host and path, and share the reputation of the empty
    host. A page_id with several outcomes is bad if any of them is; null page_ids have none. Repeated
    pages count each. Empty pages: empty result; no outcome: the rules, then allow. Input columns
    with the names of result columns are replaced.
    """
    added = ["host", "path", "rule", "verdict", "bad_share", "bad_bound"]
    cols = [c for c in (pages.columns if carry is None else carry) if c not in added]
    rule, says = rule_for(F.col("_host"), F.col("_path"), rules)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("page_id").alias("_id"),
                        host(F.col("url")).alias("_host"), path(F.col("url")).alias("_path"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
    hosts = reputation(rows.select("_id", F.col("_host").alias("host")).join(known, "_id", "left"), suffixes)
    out = rows.join(hosts.select(F.col("host").alias("_host"), "mean", "bound"), "_host", "left")
    own = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"),
                      F.coalesce(says, own).alias("verdict"), F.col("mean").alias("bad_share"), F.col("bound").alias("bad_bound"))

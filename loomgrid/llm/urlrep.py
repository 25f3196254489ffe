"""URL filters by empirical-Bayes host reputation, in DataFrame operations alone.

Labelled page outcomes (bad or not) are counted by host.  A suffix's rate is shrunk towards the rate of all pages, a
registered domain's towards its suffix's, a host's towards its domain's: each level is a beta-binomial posterior whose prior
has the parent's mean and a strength estimated from how much the children's rates differ (method of moments).  A host is
blocked if a lower bound of its bad rate (mean less ``z`` standard deviations) exceeds the limit.  Rules come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm import common

#: (verdict, host and path) as a rule is written.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Public suffixes of two labels that the registered domain counts as one.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.za", "co.kr"]
LIMIT = 0.5
Z = 1.6448536269514722
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
_PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more, as far as the host has them."""
    return F.when(F.substring_index(host, ".", -2).isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null without one.  A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _strength(rates: DataFrame, by: list[str], prior: str) -> DataFrame:
    """Prior strength for each value of ``by`` from children with columns n, bad and the parent's mean ``prior``.

    With p the prior mean and v the children's variance beyond binomial noise, p(1-p)/v - 1, within bounds; the sums are over
    children's counts, so each group is one row and partial sums do the work.
    """
    p = F.col(prior)
    spread = F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) * (F.col("bad") / F.col("n") - p))
    sums = rates.groupBy(*by).agg(spread.alias("_ss"), F.count("*").alias("_k"), F.sum("n").alias("_n"), F.max(p).alias("_p"))
    noise = F.col("_p") * (1 - F.col("_p"))
    v = (F.col("_ss") - F.col("_k") * noise) / F.greatest(F.col("_n") - F.col("_k"), F.lit(1))
    strength = F.when((v <= 0) | (noise <= 0), MAX_STRENGTH).otherwise(F.least(F.greatest(noise / v - 1, F.lit(MIN_STRENGTH)), F.lit(MAX_STRENGTH)))
    return sums.select(*by, strength.alias("strength"))


def reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hosts, domains, suffixes, all): each with its key, counts n and bad, and posterior alpha and beta.

    Rows with a null or empty host or a null outcome are not used.  Outcomes are read once: the counts of hosts, and the posteriors of
    suffixes and domains, are written to the shared folder, so that each level is computed once from those above.
    """
    seen = outcomes.where(F.col(host).isNotNull() & (F.col(host) != "") & F.col(bad).isNotNull())
    hosts = seen.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(bad).cast("long")).alias("bad"))
    hosts = common.scratch(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}))
    domains = common.scratch(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = common.scratch(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    top = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumns({"alpha": F.col("bad") + 0.5, "beta": F.col("n") - F.col("bad") + 0.5})
    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("prior")

    def level(children: DataFrame, parents: DataFrame, by: list[str]) -> DataFrame:
        """Posteriors of the children under their parents' means."""
        with_prior = children.join(parents.select(*by, mean), by) if by else children.join(F.broadcast(parents.select(mean)))  # one row
        strengths = _strength(with_prior, by, "prior")
        strong = with_prior.join(strengths, by) if by else with_prior.join(F.broadcast(strengths))  # one row
        return strong.withColumns({"alpha": F.col("prior") * F.col("strength") + F.col("bad"), "beta": (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")}).select(*children.columns, "alpha", "beta", "strength")

    s = common.scratch(level(suffixes, top, []))
    d = common.scratch(level(domains, s, ["suffix"]))
    h = level(hosts, d, ["suffix", "domain"])
    return h, d, s, top


def lower_bound(alpha: Column, beta: Column, z: float = Z) -> Column:
    """The posterior's mean less z standard deviations."""
    total = alpha + beta
    return alpha / total - z * F.sqrt(alpha * beta / (total * total * (total + 1)))


def filter_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """``pages`` with host, path, rule, bound and verdict.

    ``outcomes`` has host and bad (0 or 1) of labelled pages.  Only hosts whose posterior was learned are joined, one row each; a host
    with most of the pages is split where Spark splits skewed joins, its pages need not meet.  A page without a fitting rule is blocked if its host's lower
    bound exceeds the limit; a host without outcomes has no evidence against it and is allowed.  Columns of those names are
    replaced; null urls have empty host and path and are allowed; repeated rows stay.
    """
    rules = RULES if rules is None else rules
    hosts = reputation(outcomes)[0].select(F.col("host"), lower_bound(F.col("alpha"), F.col("beta"), z).alias("bound"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "bound", "verdict")]
    parts = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, by_rule = rule_for(F.col("host"), F.col("path"), rules)
    rated = parts.join(hosts, "host", "left")
    return rated.select(*kept, "host", "path", rule.alias("rule"), "bound", F.coalesce(by_rule, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """(host, bad) of the pages whose path names a labelled document, ``/language/number``; bad: low quality or toxic.

    A document labelled more than once takes its worst label; null labels count as good; such a page counts as often as it occurs.
    """
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    named = pages.select(host_of(F.col(url)).alias("host"), F.regexp_extract(path_of(F.col(url)), "^/[a-z]+/([0-9]{1,18})", 1).alias("number")).where("number <> ''")
    return named.select("host", F.col("number").cast("long").alias("doc_id")).join(worst, "doc_id").select("host", "bad")

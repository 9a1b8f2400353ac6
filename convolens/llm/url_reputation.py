"""URL filtering by rules and empirical-Bayes host reputation.

Rules judge a url by host (and subdomains) and path prefix; the longest rule
that fits wins, of equally long ones the blocking one, then the greatest by
host and path.  Urls no rule fits are judged by the reputation of their host,
learned from labelled page outcomes (1 bad, 0 good, null unlabelled):

* counts of bad among labelled pages per host, registered domain and public
  suffix;
* at each level a beta prior centred on the posterior mean of the level above
  (suffix under all pages, domain under suffix, host under domain), with one
  strength per level from the moment estimate of the beta-binomial
  over-dispersion across that level's units;
* a url is blocked if the lower bound of its host's posterior bad rate, mean
  minus ``z`` standard deviations, is above ``limit``.

Everything is DataFrame functions.  Pages are first reduced to host counts
(map-side partial aggregation, so a hot host is one row per task); all levels
are computed from that table; the host's verdict is joined back, where the
adaptive skew join splits a hot host.  The driver reads one row of sums per
level.

Defined cases: a null url or one without ``://`` has empty host and path and
is judged by the prior of all pages; no labelled page at all gives a bad rate
of one half everywhere, which the bound does not block; repeated page ids give
repeated rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Some public suffixes of two labels, for where no list is given: pass the
#: whole public list, one rule a row, as ``suffixes``.
SOME_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.ar", "com.au", "com.br", "com.mx", "gov.uk", "org.uk")
_IP = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$"
MOST_RULES = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def _fits(rule: tuple[str, str, str]) -> Column:
    _, host, path = rule
    on_host = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
    return on_host & F.startswith(F.col("path"), F.lit(path))


def _pick(rules: list[tuple[str, str, str]], value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        out = F.when(_fits(rule), F.lit(value(rule))).otherwise(out)
    return out


def judged_by_rules(
    pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id, host, path, rule, rule_verdict``; rules are (verdict, host, path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    parsed = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    return parsed.select(
        "*",
        _pick(rules, lambda r: r[1] + r[2]).alias("rule"),
        _pick(rules, lambda r: r[0]).alias("rule_verdict"),
    )


def suffix_rules(spark: SparkSession, rules: Iterable[str]) -> DataFrame:
    """A rule table from suffixes in the public list's notation: ``co.uk``,
    ``*.ck`` (any one label), ``!www.ck`` (an exception to that)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in rules]).cast("array<string>")).alias("suffix"))


def with_levels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``hosts`` with their registered domain and public suffix, by joining the
    ends of each host with the rules.  The rule with most labels decides, an
    exception before any; without one the last label is the suffix.  The domain
    is the suffix and one label more; a suffix is its own domain, and so is an
    IP address, under the suffix ``ip``.  User and port are no part of it."""
    bare = F.regexp_replace("host", r"^.*@|:[0-9]*$", "")
    rows = hosts.withColumn("__bare", bare).withColumn("__labels", F.split("__bare", r"\."))
    size = F.size("__labels")
    tail = lambda n: F.array_join(F.slice("__labels", F.greatest(size - n + 1, F.lit(1)), n), ".")
    ends = rows.select("host", "__labels", F.explode(F.sequence(F.lit(1), size)).alias("n"))
    way = lambda rule, exception, n: F.struct(rule.alias("rule"), F.lit(exception).alias("exception"), n.alias("labels"))
    n = F.col("n")
    ways = F.array(
        way(tail(n), False, n), way(F.concat(F.lit("*."), tail(n - 1)), False, n), way(F.concat(F.lit("!"), tail(n)), True, n - 1)
    )
    listed = suffixes.select(F.lower(F.trim("suffix")).alias("rule")).distinct()
    met = ends.select("host", F.inline(ways)).join(listed, "rule")
    best = met.groupBy("host").agg(F.max(F.struct("exception", "labels"))["labels"].alias("__n"))
    known = rows.join(best.withColumnRenamed("host", "__host"), rows["host"] == F.col("__host"), "left").drop("__host")
    of = F.coalesce("__n", F.lit(1))
    ip = F.col("__bare").rlike(_IP)
    return known.select(
        *hosts.columns,
        F.when(ip, F.col("__bare")).otherwise(tail(of + 1)).alias("domain"),
        F.when(ip, F.lit("ip")).otherwise(tail(of)).alias("suffix"),
    )


def _shrunk(units: DataFrame, prior: Column, name: str) -> DataFrame:
    """Posterior ``a_<name>, b_<name>`` of units with ``n`` labelled, ``bad`` of
    them, under beta priors with mean ``prior`` and one common strength."""
    spread = prior * (1 - prior)
    sums = units.select(
        F.sum(F.pow(F.col("bad") - F.col("n") * prior, 2)).alias("seen"),
        F.sum(F.col("n") * spread).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs"),
    ).first()
    rho = (sums.seen - sums.binomial) / sums.pairs if sums.pairs else 0.5
    strength = 1 / min(max(rho, 0.001), 0.999) - 1
    return units.select(
        "*",
        (prior * strength + F.col("bad")).alias(f"a_{name}"),
        ((1 - prior) * strength + F.col("n") - F.col("bad")).alias(f"b_{name}"),
    )


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``host, labelled, bad, rate, deviation`` from ``host, outcome`` rows;
    ``suffixes`` has the public suffix list in a column ``suffix``."""
    suffixes = suffixes if suffixes is not None else suffix_rules(outcomes.sparkSession, SOME_SUFFIXES)
    counted = outcomes.groupBy("host").agg(
        F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).cast("long").alias("bad")
    )
    hosts = staged(with_levels(counted, suffixes), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*counts).first()
    base = ((total.bad or 0) + 0.5) / ((total.n or 0) + 1.0)

    def mean(name: str) -> Column:
        return F.col(f"a_{name}") / (F.col(f"a_{name}") + F.col(f"b_{name}"))

    suffix = _shrunk(hosts.groupBy("suffix").agg(*counts), F.lit(base), "suffix").select("suffix", mean("suffix").alias("prior"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffix, "suffix")
    domain = _shrunk(domains, F.col("prior"), "domain").select("domain", "suffix", mean("domain").alias("prior"))
    host = _shrunk(hosts.join(domain, ["domain", "suffix"]), F.col("prior"), "host")
    a, b = F.col("a_host"), F.col("b_host")
    return host.select(
        "host",
        F.col("n").alias("labelled"),
        "bad",
        (a / (a + b)).alias("rate"),
        F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    z: float = 1.64,
    limit: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, labelled, bad`` per page; the pages
    a rule judges are the labelled ones."""
    judged = judged_by_rules(pages, rules, id_col, url_col)
    outcomes = judged.select(
        "host", F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0).alias("outcome")
    )
    blocked = F.col("rate") - z * F.col("deviation") > limit
    host = reputations(outcomes, suffixes).select(
        "host", "labelled", "bad", F.when(blocked, "block").otherwise("allow").alias("host_verdict")
    )
    return judged.join(host, "host").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", "host_verdict").alias("verdict"),
        "labelled",
        "bad",
    )

"""URL filter by empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes (good or bad) are counted per host. Beta-binomial priors shrink them down a
hierarchy: all pages -> suffix -> registered domain -> host. The strength of the prior at each
level is estimated from the spread of the groups of that level (method of moments). A host is
blocked where the lower posterior bound of its rate of bad pages passes a threshold. Fixed rules
on host and path go before the reputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (action, host/path) of the query's contract.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labels that, before a country's two letters, make a suffix under which hosts are registered.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "go", "gov", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or a text without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action, null where none fits. ``rules`` is a configured, short list."""
    rule = action = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def registered(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds suffix and domain (the suffix and one label more) to hosts (host).

    User info and port do not count; an address in numbers or brackets is its own domain and suffix. A
    suffix is the last label, or the last two where SECOND_LEVELS stands before a country's two letters.
    ``suffixes``: a table (suffix) of longer ones, such as the public list, of two or three labels; the
    longest counts. Spark joins it by its size.
    """
    site = F.regexp_replace(F.regexp_replace("host", r"(?s)^.*@", ""), r":[0-9]*$", "")
    rows = hosts.withColumn("_site", site)
    two, three = (F.substring_index("_site", ".", -k) for k in (2, 3))
    labels = F.when(two.rlike(rf"^({'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$"), 2).otherwise(1)
    if suffixes is not None:
        known = suffixes.select(F.col("suffix").alias("_suffix")).where("_suffix IS NOT NULL").distinct()
        for k, tail in ((2, two), (3, three)):
            one = known.select(F.col("_suffix").alias(f"_s{k}"))
            rows = rows.join(one, tail == F.col(f"_s{k}"), "left")
        labels = F.when(F.col("_s3").isNotNull(), 3).when(F.col("_s2").isNotNull(), 2).otherwise(labels)
    rows = rows.withColumn("_labels", labels)
    address = F.col("_site").rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[")

    def tail(more: int) -> Column:
        return F.when(address, F.col("_site")).otherwise(F.expr(f"substring_index(_site, '.', -(_labels + {more}))"))

    return rows.withColumns({"suffix": tail(0), "domain": tail(1)}).select(*hosts.columns, "suffix", "domain")


def _level(groups: DataFrame) -> Column:
    """Groups, trials, bad ones and the sum of bad^2 / trials over the groups that have trials."""
    seen = F.col("n") > 0
    return F.struct(
        F.count_if(seen).alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.when(seen, F.col("k") * F.col("k") / F.col("n"))), F.lit(0.0)).alias("q"),
    )


def _strength(g: int, n: int, k: int, q: float, least: float = 1.0, most: float = 10_000.0) -> float:
    """Moment estimate of the prior's sample size; ``most`` where the groups differ no more than by chance."""
    if not n:
        return most
    p = k / n
    spread, chance = q / n - p * p, p * (1 - p) * g / n
    return most if spread <= chance else min(most, max(least, (p * (1 - p) - spread) / (spread - chance)))


def host_reputation(outcomes: DataFrame, z: float = 1.645, known_suffixes: DataFrame | None = None) -> DataFrame:
    """Posterior of each host's rate of bad pages.

    ``outcomes``: host, bad (0, 1 or null where the page has no label). Returns host, n_labelled,
    n_bad, bad_mean, bad_low (the lower bound at ``z`` posterior standard deviations). Hosts without
    labels get their domain's prior. An empty table gives an empty table. Only one row of totals per
    level (three) comes to the driver.
    """
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"))
    hosts = materialise(registered(counted, known_suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    fitted = [level.select("n", "k").agg(_level(level).alias("x")).first()["x"] for level in (suffixes, domains, hosts)]
    s_strength, d_strength, h_strength = (_strength(x["g"], x["n"], x["k"], x["q"]) for x in fitted)
    overall = fitted[2]["k"] / fitted[2]["n"] if fitted[2]["n"] else 0.0

    def shrunk(prior: Column | float, strength: float) -> Column:
        return (F.col("k") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength))

    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), s_strength).alias("s_mean"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("s_mean"), d_strength).alias("d_mean"))
    mean, size = shrunk(F.col("d_mean"), h_strength), F.col("n") + F.lit(h_strength)
    low = mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (size + 1))
    return hosts.join(domains, "domain").select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), mean.alias("bad_mean"), low.alias("bad_low"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict.

    ``pages``: page_id, url (further columns are ignored, whatever their names). ``labels``: url_key
    (string), bad (0/1); a page is labelled by the number in its path, as in ``/en/825``. Labels that
    repeat a key count once, as bad if any row says so; null labels are left out, and so are their
    further columns. ``suffixes`` as in ``registered``. Rows with a null page_id or url stay and are judged like the rest (null url: host and path empty). Repeated rows
    each get a row.

    Only pages with a number in their path meet the labels. The hot host is split over ``SALTS`` parts before it meets the blocked hosts, and they are
    broadcast only if their table's size on disk is below Spark's threshold.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.where(F.col("url_key").isNotNull() & F.col("bad").isNotNull()).groupBy("url_key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    number = F.regexp_extract("path", r"^/[^/]*/([0-9]+)", 1)
    labelled = urls.select("host", number.alias("url_key")).where("url_key <> ''").join(marks, "url_key").select("host", "bad")
    outcomes = labelled.unionByName(urls.select("host").distinct().withColumn("bad", F.lit(None).cast("int")))
    blocked = host_reputation(outcomes, z, suffixes).where(F.col("bad_low") > threshold).select("host", F.lit(True).alias("blocked"))
    blocked = materialise(blocked, "blocked-hosts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    judged = salted.join(blocked, ["host", "salt"], "left")
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

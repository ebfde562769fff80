"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled outcomes (1 bad, 0 good) are counted by host. A beta prior is shrunk down the
tree suffix -> registered domain -> host: each level's prior mean is the posterior mean
of the level above, its strength comes from the spread of the level's own rates (method
of moments over all groups with two outcomes or more), and is no more than the evidence
above. A page without a rule is blocked when
the lower bound of its host's posterior bad rate, the LOW quantile of its beta posterior, passes BLOCK_ABOVE. Hosts without
outcomes stand at their domain's posterior, unknown domains at their suffix's, and so on
to the global rate.

The outcomes here are the verdicts of the rules, the only labels that pages have, counted on the very pages
that are then judged.

In the tree, a host is without user name, port and the dot at its end; an IP address is its own domain under the
suffix ``ip``. Suffixes follow rules as public suffix lists write them (``suffixes.txt``, or any such file): the rule of most labels
counts, ``*`` stands for any label, ``!`` makes an exception, and an unlisted last label is a suffix.

Edge cases: null urls and urls without ``://`` have empty host and path and are judged by
the global prior; the host that is returned keeps port and user name; with no outcomes at all
nothing is blocked; repeated rows count as often as they occur; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import join_facts, stored

#: (host, path prefix, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: A short list of suffixes that registries and hosting services give out below; pass a full list for real use.
SUFFIXES = str(Path(__file__).with_name("suffixes.txt"))
BLOCK_ABOVE = 0.5
#: The quantile of the posterior that is its bound.
LOW = 0.05
STRENGTH = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_column(host: Column, path: Column, value) -> Column:
    """The value of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def load_suffixes(path: str = SUFFIXES) -> list[str]:
    """Rules of a public suffix file: a rule a line, comments behind //."""
    lines = [line.partition("//")[0].strip().lower() for line in Path(path).read_text(encoding="utf-8").splitlines()]
    return [line for line in lines if line]


def site_of(host: Column) -> Column:
    """The host without user name, port and last dot."""
    bare = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(bare, r"(?<=.)\.?(?::[0-9]*)?$", "")


def is_address(site: Column) -> Column:
    return site.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9a-f:.]+\])$")


def suffix_labels(site: Column, rules: list[str]) -> Column:
    """How many labels of the site are its public suffix."""
    out = F.lit(1)
    for k in sorted({r.lstrip("!").count(".") + 1 for r in rules}):
        here = [r for r in rules if r.lstrip("!").count(".") + 1 == k]
        own, rest = F.substring_index(site, ".", -k), F.substring_index(site, ".", 1 - k)
        plain, wild = ([r.removeprefix(m) for r in here if r.startswith(m) and r[:1] not in no] for m, no in (("", ("!", "*")), ("*.", ())))
        fits = (own.isin(*plain) if plain else F.lit(False)) | (rest.isin(*wild) if wild else F.lit(False))
        out = F.when(fits & (F.size(F.split(site, "[.]")) >= k), F.lit(k)).otherwise(out)
    for r in (r[1:] for r in rules if r.startswith("!")):
        out = F.when((site == r) | site.endswith("." + r), F.lit(r.count("."))).otherwise(out)
    return out


def tree_of(host: Column, rules: list[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    site = site_of(host)

    def labels(n: Column) -> Column:
        parts = F.split(site, "[.]")
        first = F.greatest(F.size(parts) - n, F.lit(0))
        return F.array_join(F.slice(parts, first + 1, F.size(parts)), ".")

    m = suffix_labels(site, rules)
    return F.when(is_address(site), site).otherwise(labels(m + 1)), F.when(is_address(site), "ip").otherwise(labels(m))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after steps up to 10."""
    x = np.asarray(x, dtype=np.float64)
    less = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        less = less + np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - less


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, dtype=np.float64) for v in (x, a, b)))
    turn = x > (a + 1) / (a + b + 2)  # there the fraction of the other tail converges faster
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 2000):
        old = h
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - old) <= 1e-14 * np.abs(h)):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    p = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.clip(np.where(turn, 1 - p, p), 0.0, 1.0)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x below which the beta distribution has p, by halving."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(52):
        mid = (low + high) / 2
        under = beta_cdf(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("alpha", "beta"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beta_quantile(LOW, a, b) if len(a) else a)], names=[*batch.schema.names, "bound"])


def _strength(groups: DataFrame) -> float:
    """Prior strength (pseudo-outcomes) by the method of moments over the groups' rates around their parents' means."""
    many = groups.filter("n >= 2")
    rate = F.col("bad") / F.col("n")
    p = F.col("mean")
    k, spread, noise, own = many.agg(F.count("*"), F.avg((rate - p) * (rate - p)), F.avg(p * (1 - p) / F.col("n")), F.avg(p * (1 - p))).first()
    if not k or not own:
        return STRENGTH[1]
    between = max(spread - noise, 1e-9)
    return min(max(own / between - 1, STRENGTH[0]), STRENGTH[1])


def reputation(outcomes: DataFrame, suffixes_file: str = SUFFIXES) -> DataFrame:
    """host, alpha, beta, pages, bound from outcomes(host, bad 0/1/null) of every page; hosts without outcomes are included."""
    seen = outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"))
    domain, suffix = tree_of(F.col("host"), load_suffixes(suffixes_file))
    hosts = stored(seen.withColumns({"domain": domain, "suffix": suffix}), "url-hosts")
    counts = [F.count("*").alias("below"), F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*counts), "url-domains")
    suffixes = stored(domains.groupBy("suffix").agg(*counts), "url-suffixes")
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    p = (float(bad or 0) + 0.5) / (float(n or 0) + 1.0)

    def posterior(groups: DataFrame) -> DataFrame:
        """A group's prior is as strong as its level's spread says, but no surer than the level above is of its mean."""
        k = F.least(F.lit(_strength(groups)), F.col("sure"))
        return groups.withColumns({"alpha": k * F.col("mean") + F.col("bad"), "beta": k * (1 - F.col("mean")) + F.col("n") - F.col("bad")})

    def mean(groups: DataFrame, key: str) -> DataFrame:
        sure = F.col("alpha") + F.col("beta")
        return stored(groups.select(key, "below", (F.col("alpha") / sure).alias("mean"), sure.alias("sure")), "url-means")

    top = posterior(suffixes.withColumns({"mean": F.lit(p), "sure": F.lit(float(n or 0) + 1.0)}))
    mid = posterior(stored(join_facts(domains, mean(top, "suffix"), ["suffix"], "below", ["domain"]), "url-mid"))
    low = posterior(stored(join_facts(hosts, mean(mid, "domain"), ["domain"], "below", ["host"]), "url-low"))
    return low.select("host", "alpha", "beta", "pages").mapInArrow(_bounds, "host string, alpha double, beta double, pages long, bound double")


def judge(pages: DataFrame, suffixes_file: str = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate, bad_bound of every page."""
    url = F.col("url").cast("string")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    parts = parts.withColumns({"rule": _rule_column(host, path, lambda r: r[0] + r[1]), "ruled": _rule_column(host, path, lambda r: r[2])})
    parts = stored(parts, "url-parts")
    bad = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    known = stored(reputation(parts.select("host", bad.alias("bad")), suffixes_file), "url-known")
    rows = join_facts(parts, known, ["host"], "pages", ["page_id", "path"])
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("bound") > BLOCK_ABOVE, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("bad_rate"), F.col("bound").alias("bad_bound"))

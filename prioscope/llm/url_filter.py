"""URL verdicts: rules first, and for the rest a logistic regression on hashed character n-grams.

Host and path give n-grams of their own; each is hashed to one of ``buckets`` weights. The model is
trained on a small table of urls with verdicts, by gradient steps that are aggregations: a step
sends the weights out as one literal and brings back one sum a bucket. Everything is DataFrame
functions; nothing leaves the JVM but those sums.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prioscope.llm.tables import drop, durable

#: The production rules, each a verdict and a host with the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlConfig:
    """``sample_rows`` bounds the labelled urls of each verdict that are used for fitting."""

    rules: tuple[tuple[str, str], ...] = RULES
    grams: tuple[int, ...] = (3, 4)
    buckets: int = 4096
    sample_rows: int = 2000
    steps: int = 30
    rate: float = 4.0
    ridge: float = 1e-4


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits host, its subdomains and the start of path."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r)):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def buckets_of(host: Column, path: Column, config: UrlConfig) -> Column:
    """The distinct buckets of the n-grams of host and of path, each with marks at both ends."""
    def grams(kind: str, text: Column, n: int) -> Column:
        def of(chars: Column) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(
                F.expr("cast(array() as array<int>)")
            )
            gram = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
            return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), gram(i)), F.lit(config.buckets)).cast("int"))

        # split once: cutting each gram out of the text would cost its distance from the start
        return F.get(F.transform(F.array(F.split(text, "")), of), 0)

    parts = [
        grams(kind, F.concat(F.lit("^"), text, F.lit("$")), n)
        for kind, text in (("host", host), ("path", path)) for n in config.grams
    ]
    return F.array_distinct(F.concat(*parts))


def _margin(buckets: Column, weights: list[float], bias: float) -> Column:
    """bias + sum of the buckets' weights over the root of their number."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double"))


@dataclass(frozen=True)
class UrlModel:
    weights: list[float]
    bias: float
    config: UrlConfig

    def blocked(self, host: Column, path: Column) -> Column:
        """The probability that a url is to be blocked."""
        return 1 / (1 + F.exp(-_margin(buckets_of(host, path, self.config), self.weights, self.bias)))


def labelled_urls(pages: DataFrame, config: UrlConfig = UrlConfig()) -> DataFrame:
    """(url, label 1 for block) of urls that a rule judges: the small table the model learns from.

    Of each verdict at most ``sample_rows`` different urls, chosen by hash.
    """
    judged = pages.select("url").filter("url is not null").withColumn(
        "verdict", rule_of(host_of(F.col("url")), path_of(F.col("url")), config.rules)["verdict"]
    )
    parts = [
        judged.filter(F.col("verdict") == verdict).select("url").distinct()
        .orderBy(F.xxhash64("url"), "url").limit(config.sample_rows)
        .withColumn("label", F.lit(float(verdict == "block")))
        for verdict in ("allow", "block")
    ]
    return parts[0].unionByName(parts[1])


def fit(labelled: DataFrame, config: UrlConfig = UrlConfig()) -> UrlModel:
    """Accelerated gradient descent over ``labelled`` (url, label 0 or 1).

    Rows have unit length, so a rate of 4 is below the bound at which steps diverge. Without
    labels every probability is 1/2 less a little: nothing is blocked.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = durable(
        labelled.filter("url is not null and label is not null")
        .select(buckets_of(host, path, config).alias("buckets"), F.col("label").cast("double").alias("label"))
        .coalesce(1)
    )
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    n, blocked = sums.n, sums.blocked or 0.0
    weights, bias = [0.0] * config.buckets, math.log((blocked + 0.5) / (n - blocked + 0.5)) if n else -1e-9
    last, momentum = weights, 1.0
    for _ in range(config.steps if 0 < blocked < n else 0):
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        pull = (momentum - 1) / after
        ahead = [w + pull * (w - o) for w, o in zip(weights, last, strict=True)]
        missed = F.col("label") - 1 / (1 + F.exp(-_margin(F.col("buckets"), ahead, bias)))
        slopes = (
            rows.select("buckets", (missed / F.sqrt(F.size("buckets").cast("double"))).alias("slope"))
            .select(F.explode("buckets").alias("bucket"), "slope")
            .groupBy("bucket").agg(F.sum("slope").alias("slope")).collect()
        )
        last, weights, momentum = weights, [w * (1 - config.rate * config.ridge) for w in ahead], after
        for r in slopes:
            weights[r.bucket] += config.rate * r.slope / n
    drop(rows)
    return UrlModel(weights, bias, config)


def url_verdicts(pages: DataFrame, labelled: DataFrame | None = None, config: UrlConfig = UrlConfig()) -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_probability of every row of ``pages`` (page_id, url).

    A null url, or one without ``://``, has an empty host and path and is left to the model. Repeated
    rows get a row each; an empty table gives no rows; other columns are not looked at. ``labelled``
    defaults to the urls that a rule judges.
    """
    model = fit(labelled_urls(pages, config) if labelled is None else labelled, config)
    url = F.col("url").cast("string")
    judged = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), config.rules))
    judged = judged.withColumn("blocked_probability", model.blocked(F.col("host"), F.col("path")))
    return judged.select(
        "page_id", "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce(
            F.col("by_rule.verdict"), F.when(F.col("blocked_probability") >= 0.5, "block").otherwise("allow")
        ).alias("verdict"),
        "blocked_probability",
    )

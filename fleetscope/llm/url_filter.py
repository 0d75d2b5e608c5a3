"""URL verdicts by rules and, where none fits, by a logistic regression on hashed character n-grams of host and path.

DataFrame functions only: n-grams are hashed, weights looked up and gradients summed by SQL expressions. The model is
trained from a small labelled URL table by full-batch gradient descent from naive Bayes weights, one aggregation a step.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlModel:
    """Weights of the hashed n-grams and the bias; a URL is blocked from ``threshold`` on."""

    weights: tuple[float, ...]
    bias: float
    threshold: float = 0.5


#: N-gram lengths, number of hashed features, and the training's steps, rate and ridge. The labelled table may hold this many rows at most.
SIZES, BUCKETS, STEPS, RATE, RIDGE, MOST_LABELLED = (3, 4, 5), 1 << 14, 10, 8.0, 1e-3, 100_000

# Words in hosts and paths by which the small labelled table marks unwanted and ordinary URLs.
UNWANTED = "adult-x adult-video ads-track ad-server ads-click casino-win casino-online free-bets bets-live cheap-pills pills-shop spam-farm spam-mail tracker-pixel xxx-cams porn-tube poker-bonus lottery-win payday-loan replica-watch viagra-store warez-crack torrent-keygen malware-kit phishing-login click-farm free-money win-prize".split()
ORDINARY = "library history garden museum weather science recipes travel university school kitchen archive journal daily-news health forum research cycling painting novels music theatre climate biology maps village harbour theology thinking there station nation other thanks season region orchard reading mother weather-map father brother northern southern eastern western thunder leather feather gather hither wither bother theory therapy thesis thermal anthem method path bath earth month north south width length truth youth growth health-care action motion lotion notion potion section mention tension pension mission session vision fusion edition tradition condition position question answer letter lettering printing planting painting-club writing making meeting morning evening building wedding running swimming sailing walking talking singing the-hand the-tree then-there this-that with-them sheriff shelter shadow shepherd nation-wide wholesome thimble thistle trouble double table cable noble able humble bundle handle candle thou-art hour-glass our-town hands lands islands brands inner thread-shop enter center winter summer".split()


def seed_urls(spark: SparkSession) -> DataFrame:
    """The small labelled URL table (url, label; 1: block) that the query trains from."""
    rows = []
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for k, word in enumerate(words):
            for j, (front, zone) in enumerate((("", "com"), ("www.", "net"), ("blog.", "org"), ("m.", "net"))):
                rows.append((f"http{'s' * (j % 2)}://{front}{word}.example.{zone}/{('en', 'de', 'fr', 'es')[(j + k) % 4]}/{1000 + 37 * k + j}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ngram_buckets(host: Column, path: Column) -> Column:
    """Hashed n-grams of host and path, apart from each other, with marks at both ends."""

    def grams_of(whole: Column, mark: str, n: int) -> Column:
        starts = F.when(F.length(whole) >= n, F.sequence(F.lit(1), F.length(whole) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(whole, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    def grams(part: Column, mark: str) -> list[Column]:
        return [grams_of(F.concat(F.lit("^"), part, F.lit("$")), mark, n) for n in SIZES]

    return F.concat(*grams(host, "host"), *grams(path, "path"))


def _literal(values: list[float] | tuple[float, ...]) -> Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def _margin(buckets: Column, weights: Column, bias: float) -> Column:
    """Bias and mean weight of a URL's n-grams, scaled by the square root of their number."""
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)))


def train(labelled: DataFrame) -> UrlModel:
    """Fits the model to (url, label). Rows with a null url or label are left out; without both labels the bias alone decides."""
    rows = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    n, positives = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n > MOST_LABELLED:
        raise ValueError(f"the labelled URL table has {n} rows; at most {MOST_LABELLED} are meant")
    weights, bias = [0.0] * BUCKETS, 0.0
    if not n or positives in (0, n):
        return UrlModel(tuple(weights), 5.0 if n and positives == n else -5.0)
    rows = rows.select("label", ngram_buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("grams")).cache()
    # Start from half the naive Bayes log odds of each n-gram, so that a few steps do; unseen n-grams weigh nothing.
    seen = rows.select("label", F.explode(F.array_distinct("grams")).alias("bucket")).groupBy("bucket").agg(F.sum("label").alias("yes"), F.count("*").alias("all"))
    for bucket, yes, every in seen.collect():
        weights[bucket] = 0.5 * (math.log((yes + 0.5) / (positives + 1)) - math.log((every - yes + 0.5) / (n - positives + 1)))
    bias = math.log(positives / (n - positives))
    for _ in range(STEPS):
        error = F.col("label") - 1 / (1 + F.exp(-_margin(F.col("grams"), _literal(weights), bias)))
        pulled = rows.select(error.alias("pull"), (error / F.sqrt(F.greatest(F.size("grams"), F.lit(1)))).alias("gram_pull"), "grams")
        # One row a bucket, BUCKETS at most, and one for the bias.
        terms = pulled.select(F.explode(F.concat(F.transform("grams", lambda b: F.struct(b.alias("bucket"), F.col("gram_pull").alias("g"))), F.array(F.struct(F.lit(-1).alias("bucket"), F.col("pull").alias("g"))))).alias("t"))
        for bucket, g in terms.groupBy("t.bucket").agg(F.sum("t.g")).collect():
            if bucket < 0:
                bias += RATE * g / n
            else:
                weights[bucket] += RATE * g / n
        weights = [w * (1 - RATE * RIDGE) for w in weights]
    rows.unpersist()
    return UrlModel(tuple(weights), bias)


@dataclass(frozen=True)
class UrlRule:
    """``zone/path`` with its verdict: fits the zone and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str


def rule_verdict(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); nulls where none does."""
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    out = nothing
    for rule in sorted(rules, key=lambda r: len(r.text)):
        zone, _, rest = rule.text.partition("/")
        fits = ((host == zone) | host.endswith("." + zone)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[UrlRule], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict (allow or block), score (the model's).

    A null url or one without ``://`` has an empty host and path and is judged like any other. Repeated rows stay; an
    empty table gives no row; urls of any length are judged whole; other columns are not read. No shuffle.
    """
    parts = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    margin = _margin(ngram_buckets(F.col("host"), F.col("path")), _literal(model.weights), model.bias)
    scored = parts.select("*", (1 / (1 + F.exp(-margin))).alias("score"), rule_verdict(F.col("host"), F.col("path"), rules).alias("fit"))
    by_model = F.when(F.col("score") >= model.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", by_model).alias("verdict"), "score")

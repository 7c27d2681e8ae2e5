"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

The classifier, intercept included, is trained on the driver from the small labelled table below (its size is the
bound) and scores every URL with built-in expressions only: the n-grams of host and path are
hashed into a fixed number of buckets and their weights are read from a literal array.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let

#: Rules as host/path: a rule fits its host and all subdomains if the path starts with its own; the longest wins.
BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")

NGRAMS = (3, 4, 5)
BUCKETS = 4096
THRESHOLD = 0.5
EPOCHS = 40
RATE = 1.0
L2 = 1e-4
#: What hosts to block and hosts to allow are made of, with what stands around such words: the makings of the labelled table.
BAD = """casino slots poker jackpot roulette betting bets wager lottery pills viagra cialis meds steroids adult xxx porn sex escort camgirls loans payday
cash crack warez keygen torrent replica fake spam phishing malware ads adserver track tracker clicks popup prize clickbait""".split()
GOOD = """garden library weather history kitchen recipes travel school science museum software university hospital music football city trains books
forum bakery photos maps cinema research cooking river mountain news radio theatre council village harbour forest teacher doctor market engine
window paper letters bridge summer winter story language dictionary climate astronomy chess cycling hiking poetry painting pottery knitting
sailing baking parents seniors county nation station action motion fashion thread thunder northern southern mother father brother health wealth
earth north month truth cloth thing nothing leather feather another english finish fishing spanish polish""".split()
_BEFORE = ["", "", "the", "my-", "best-", "online-", "our-"]
_BEHIND = ["", "", "-now", "24", "online", "-club", "hub"]
_PATHS = ["/", "/en/4071", "/fr/77.html", "/es/645/", "/de/12#top", "/en/88?ref=x", "/en/23?page=2"]
#: Paths that only one of the classes has, now and then.
_OWN_PATHS = {1: ["/bonus", "/buy/now.html", "/claim/5"], 0: ["/articles/12", "/about", "/guide/intro.html"]}
_SITES = ["", "www.", "m.", "blog.", "", "en."]
_ENDS = ["example.com", "example.org", "example.net"]


def _labelled() -> tuple[tuple[str, int], ...]:
    """The labelled table: invented hosts under reserved names, eight for every bad word and five for every good one."""
    out = []
    for label, words, copies in ((1, BAD, 8), (0, GOOD, 5)):
        for word in words:
            for j in range(copies):
                # what stands around a word says nothing of its class
                pick = lambda x, kind: x[zlib.crc32(f"{word} {j} {kind}".encode()) % len(x)]  # noqa: E731, B023
                host = pick(_SITES, "site") + pick(_BEFORE, "before") + word + pick(_BEHIND, "behind") + "." + pick(_ENDS, "end")
                out.append((pick(["http://", "https://"], "scheme") + host + pick(_PATHS * 2 + _OWN_PATHS[label], "path"), label))
    return tuple(out)


#: (url, 1 to block). Invented, under names that are reserved for examples; nothing is taken from tables that are judged.
LABELLED = _labelled()


def host_of(url: Column) -> Column:
    """From behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, _, rest = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest rule that fits, or null."""
    return F.coalesce(*[F.when(_fits(r, host, path), F.lit(r)) for r in sorted(rules, key=lambda r: (-len(r), r))], F.lit(None).cast("string"))


def _buckets(host: Column, path: Column) -> Column:
    """array<int>: bucket of every n-gram of host and path, each between its own end marks."""
    def grams(tag: str, text: Column) -> Column:
        def of(chars: Column) -> Column:
            hashed = lambda n: lambda i: F.pmod(F.xxhash64(F.lit(tag), F.array_join(F.slice(chars, i, n), "")), F.lit(BUCKETS)).cast("int")
            return F.concat(*[F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1))), hashed(n))).otherwise(
                F.array().cast("array<int>")) for n in NGRAMS])
        return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), of)
    return F.concat(grams("h", host), grams("p", path))


@lru_cache(maxsize=4)
def _weights(rows: tuple[tuple[tuple[int, ...], int], ...]) -> tuple[float, tuple[float, ...]]:
    """Intercept and bucket weights by stochastic gradient descent in a fixed order; features are counts over the root of their number."""
    w, b, order = [0.0] * BUCKETS, 0.0, list(range(len(rows)))
    rng = random.Random(7)
    feats = []
    for buckets, _ in rows:
        norm = 1 / math.sqrt(max(1, len(buckets)))
        feats.append([(k, norm) for k in buckets])
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        rate = RATE / (1 + epoch / 20)
        for i in order:
            z = b + sum(w[k] * x for k, x in feats[i])
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - rows[i][1]
            b -= rate * g
            for k, x in feats[i]:
                w[k] -= rate * (g * x + L2 * w[k])
    return b, tuple(w)


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] = LABELLED) -> tuple[float, tuple[float, ...]]:
    """Bias and weights; the n-grams come from the same expression that scores."""
    rows = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "i int, url string, y int")
    got = rows.select("i", "y", _buckets(host_of(F.col("url")), path_of(F.col("url"))).alias("b")).orderBy("i").collect()
    return _weights(tuple((tuple(r["b"]), r["y"]) for r in got))


def score(host: Column, path: Column, model: tuple[float, tuple[float, ...]]) -> Column:
    """Probability that a URL is to be blocked."""
    bias, weights = model
    table = F.lit(list(weights))

    def logit(b: Column) -> Column:
        total = F.aggregate(b, F.lit(0.0), lambda acc, k: acc + F.get(table, k))
        return total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double")) + bias

    return let(_buckets(host, path), lambda b: 1 / (1 + F.exp(-logit(b))))


def filter_urls(pages: DataFrame, block: Sequence[str] = BLOCK_RULES, allow: Sequence[str] = ALLOW_RULES,
                labelled: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, score.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is judged by
    the classifier on the empty text. Repeated rows are judged each; other columns are not read.
    """
    model = train(pages.sparkSession, labelled)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = rule_of(F.col("host"), F.col("path"), [*block, *allow])
    judged = parts.withColumn("rule", rule).withColumn("score", score(F.col("host"), F.col("path"), model))
    verdict = F.when(F.col("rule").isin(*allow), "allow").when(F.col("rule").isin(*block), "block").when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

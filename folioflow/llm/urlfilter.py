"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

Hosts and paths are cut by expressions, so the whole filter stays in the JVM.  The classifier is
trained from a small labelled table whose features are hashed by the same expressions; its weights
go back into the plan as one array of fixed size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Buckets that n-grams are hashed to, and their lengths.
BUCKETS, LENGTHS = 1 << 14, (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stems of what hosts and paths of unwanted and of ordinary pages are named with; general vocabulary.
BAD = (
    "spam casino poker slots jackpot roulette betting gamble lottery bingo wager pills viagra steroid replica counterfeit porn xxx sex adult nude "
    "erotic escort webcam fetish hookup dating payday loans debt forex crypto doubler ponzi airdrop free money giveaway prize win clickbait click "
    "popunder ads adserver tracker followers likes backlink linkfarm contentfarm trafficbot warez crack keygen torrent nulled malware phishing "
    "botnet hacked cheap discount miracle"
).split()
GOOD = (
    "library weather museum recipe science university garden travel history music theatre news school hospital council physics biology chemistry "
    "algebra poetry novel cinema sport football cycling hiking climate energy forest ocean river mountain village market bakery kitchen coffee "
    "bread farm animal bird horse train bridge castle cathedral archive gallery painting sculpture design software hardware network database "
    "compiler manual reference tutorial forum research journal letter parliament court budget election census economy insurance health nursing "
    "dentist children family language grammar dictionary atlas geology astronomy station airport harbour thesis lecture student workshop "
    "festival orchestra chess puzzle photo radio podcast"
).split()
#: Endings that both kinds get alike, so that only stems tell them apart.
ENDINGS = ("", "s", "-online", "-world", "24", "-best", "-center", "-net", "hub", "-daily")
#: Made-up names, two or three syllables each: words that mean nothing are ordinary.
SYLLABLES = "ba ce do fi gu ha je ko li mo nu pa ri so te vu wa ys en ar ol um".split()
PLACES = ("example.com", "example.org", "example.net", "test", "site.example")
FORMS = ("http://{}.{}/{}/{}", "https://www.{}.{}/{}/{}.html", "https://blog.{}.{}/{}/{}/", "http://m.{}.{}/{}/{}?page=2", "https://{}.{}/{}-{}#top")
SECTIONS = ("en", "de", "fr", "es", "articles", "index", "shop", "post", "view", "archive")
#: One of so many words is held out of training.
HOLD = 5


def labelled_urls(held_out: bool = False) -> list[tuple[str, int]]:
    """The labelled table, (url, 1 if blocked): each word (a stem with an ending, or two stems) names a host and stands in a
    path of an ordinary host.  Held-out words make no URL of the training table."""
    n, rows = len(SYLLABLES), []
    made = [SYLLABLES[i % n] + SYLLABLES[(3 * i + i // n) % n] + SYLLABLES[(7 * i + 5) % n] * (i % 2) for i in range(300)]
    named = [(stem + ENDINGS[(i + j) % len(ENDINGS)], label) for stems, label, each in ((BAD, 1, 10), (GOOD, 0, 5)) for i, stem in enumerate(stems) for j in range(each)]
    named += [(stem + "-" * (j % 2) + stems[(i + 11 * (j + 1)) % len(stems)], label) for stems, label in ((BAD, 1), (GOOD, 0)) for i, stem in enumerate(stems) for j in range(4)]
    for i, (word, label) in enumerate([*named, *((w, 0) for w in made)]):
        if ((i // 10 + i) % HOLD == 0) == held_out:
            rows.append((FORMS[i % len(FORMS)].format(word, PLACES[(i // 5) % len(PLACES)], SECTIONS[(3 * i) % len(SECTIONS)], 37 * i), label))
            if i % 2:
                rows.append((f"https://pages.{PLACES[i % len(PLACES)]}/{SECTIONS[(i // 3) % len(SECTIONS)]}/{word}/{i}", label))
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and where :// is missing."""
    at = F.locate("://", url)
    rest = F.substr(url, at + F.lit(3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, "").otherwise(F.translate(host, UPPER, LOWER)), F.when(none, "").otherwise(path)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; nulls if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _bucket(seed: int, text: Column, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substr(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int")


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets (from 0) of the n-grams of host and path, each part in its own marks and space of hashes."""
    every = []
    for seed, part in ((1, host), (2, path)):
        marked = F.concat(F.lit("^"), F.lower(part), F.lit("$"))
        for n in LENGTHS:
            last = F.greatest(F.length(marked) - n + 1, F.lit(1))
            every.append(F.transform(F.sequence(F.lit(1), last), _bucket(seed, marked, n)))
    return F.array_distinct(F.flatten(F.array(*every)))


def table_of(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    """url, label of a small list, as literals of the plan; no URL holds a line break."""
    urls, labels = ("\n".join(str(r[i]) for r in rows) for i in (0, 1))
    pairs = F.arrays_zip(F.split(F.lit(urls), "\n").alias("url"), F.split(F.lit(labels), "\n").alias("label"))
    return spark.range(1).select(F.inline(pairs)).toDF("url", "label").withColumn("label", F.col("label").cast("int"))


def train(spark: SparkSession, rows: list[tuple[str, int]] | None = None, ridge: float = 0.02, steps: int = 6) -> tuple[list[float], float]:
    """(weights by bucket, bias) of ridge logistic regression on the labelled table, by Newton steps.

    The table is small (``rows``), so its fit runs on the driver, over products of its rows with each other;
    features are hashed by the plan's expressions."""
    host, path = parts(F.col("url"))
    data = table_of(spark, rows or labelled_urls()).select(gram_buckets(host, path).alias("b"), "label").collect()
    x = np.zeros((len(data), BUCKETS + 1), np.float32)
    for i, r in enumerate(data):
        x[i, r.b] = 1 / math.sqrt(len(r.b))
    x[:, -1] = 1.0  # the bias
    y, gram, raw = np.array([float(r.label) for r in data]), (x @ x.T).astype(np.float64), np.zeros(len(data))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-5)
        dual = np.linalg.solve(gram + np.diag(ridge / h), raw + (y - p) / h)
        raw = gram @ dual
    w = dual @ x
    return [float(v) for v in w[:-1]], float(w[-1])


def judge(df: DataFrame, model: tuple[list[float], float], rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``df`` with host, path, rule, verdict and score (the method's probability of block).

    A null url or one without :// has an empty host and path, fits no rule and is judged by the
    method.  Urls of any length are read whole.  Ties between rules of one length go to the later of
    the list.  Repeated rows repeat; an empty table gives no rows; columns of these names are replaced.
    """
    weights, bias = model
    array = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    own = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    h, p = parts(F.col(url))
    cut = df.select(*own, h.alias("host"), p.alias("path"))
    b = gram_buckets(F.col("host"), F.col("path"))
    total = F.aggregate(b, F.lit(0.0), lambda acc, i: acc + F.get(array, i))
    raw = F.lit(bias) + total / F.sqrt(F.size(b))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.withColumn("score", 1 / (1 + F.exp(-raw))).withColumn("rule", rule)
    return scored.select(*own, "host", "path", "rule", F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")

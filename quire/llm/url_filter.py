"""URL filters without Python on the executors: rules first, then a logistic regression on hashed n-grams."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, own_columns, own_rows

BUCKETS, GRAMS = 1 << 14, (3, 4, 5)

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The small labelled table, from general knowledge of what block lists hold: words that make a name unwanted, words that do
# not, and words that stand beside either.  labelled() forms its URLs from them by rule.
UNWANTED = (
    "casino", "poker", "roulette", "blackjack", "jackpot", "slots", "betting", "gambling", "bingo", "lottery", "sportsbet", "wager",
    "porn", "xxx", "sex", "nude", "escort", "webcam", "erotic", "adult", "hentai", "fetish",
    "viagra", "cialis", "pills", "meds", "pharmacy", "steroids", "slimming",
    "malware", "phishing", "warez", "keygen", "cracked", "torrent", "botnet", "spyware", "trojan",
    "adserver", "adtracker", "ads", "popup", "banner", "clickbait", "tracking", "doubleclick", "affiliate",
    "spam", "linkfarm", "payday", "loans", "getrich", "prize", "winner", "bonus", "cheap", "freebie", "replica", "giveaway",
)
ORDINARY = (
    "news", "weather", "library", "museum", "kitchen", "recipes", "garden", "travel", "history", "science", "physics", "maths", "school", "university", "college",
    "council", "hospital", "dental", "wiki", "forum", "journal", "books", "music", "photo", "sports", "cycling", "railway", "maps", "jobs", "finance", "energy",
    "community", "computing", "software", "research", "archive", "theatre", "cinema", "football", "running", "climbing", "sailing", "fishing", "farming", "animals", "flowers",
    "mountain", "river", "island", "city", "village", "market", "bakery", "coffee", "restaurant", "hotel", "church", "charity", "parents", "children", "teacher",
    "engineer", "architect", "lawyer", "doctor", "nursing", "insurance", "government", "police", "station", "airport", "shipping", "furniture", "painting", "drawing",
    "writing", "language", "english", "deutsch", "francais", "espanol", "zeitung", "bibliothek", "jardin", "cuisine", "biblioteca", "escuela", "tienda", "montagne", "ciudad",
)
BESIDE = ("", "online", "shop", "club", "best", "world", "24", "my", "top", "net", "one", "info")
ENDINGS, PATHS = ("com", "net", "org", "de", "fr", "es", "co.uk", "info"), ("/", "/index.html", "/en/page/1", "/de/seite", "/fr/article-2", "/es/pagina", "/a/b?c=d#e", "")


def labelled(spark: SparkSession, unwanted: tuple[str, ...] = UNWANTED, ordinary: tuple[str, ...] = ORDINARY) -> DataFrame:
    """(url, label): 1 is unwanted.  Each word stands alone, before and behind words that either kind has beside it."""
    rows = []
    for label, names in ((1, unwanted), (0, ordinary)):
        for i, name in enumerate(names):
            for j, other in enumerate(BESIDE[i % 3 :: 3]):
                joined = name if not other else f"{name}{('-', '', '.')[j % 3]}{other}" if (i + j) % 2 else f"{other}{('-', '.', '')[j % 3]}{name}"
                rows.append({"url": f"https://{'www.' * (j % 2)}{joined}.{ENDINGS[(i + j) % len(ENDINGS)]}{PATHS[(i + 3 * j) % len(PATHS)]}", "label": label})
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,label:int>>")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; path: from there up to ``?`` or ``#``.  Else both are empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _grams(buckets: int, sizes: tuple[int, ...]) -> Column:
    """Buckets of the distinct character n-grams of host and path; a mark tells the two apart."""
    parts = []
    for mark in (1, 2):
        chars = f"q_chars{mark}"
        for n in sizes:
            gram = ", ".join(f"{chars}[i + {k}]" for k in range(n))
            parts.append(f"case when size({chars}) >= {n} then transform(sequence(0, size({chars}) - {n}), i -> cast(pmod(xxhash64({mark}, {gram}), {buckets}) as int)) else cast(array() as array<int>) end")
    return F.array_distinct(F.flatten(F.array(*map(F.expr, parts))))


def with_grams(df: DataFrame, url_col: str, buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """The rows of ``df`` as a struct ``q_own``, with ``q_host``, ``q_path`` and ``q_grams``."""
    host, path = host_and_path(F.col("q_url"))
    chars = lambda c: F.when(F.length(c) > 0, F.split(F.concat(F.lit("^"), F.col(c), F.lit("$")), "")).otherwise(F.array().cast("array<string>"))
    rows = own_rows(df, q_url=F.col(url_col)).select("q_own", host.alias("q_host"), path.alias("q_path"))
    return rows.withColumn("q_chars1", chars("q_host")).withColumn("q_chars2", chars("q_path")).withColumn("q_grams", _grams(buckets, sizes)).drop("q_chars1", "q_chars2")


@dataclass
class UrlModel:
    """Logistic regression: the weights of present n-grams, each scaled by the root of their number."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = GRAMS

    def probability(self, grams: str = "q_grams") -> Column:
        table = F.split(F.lit(",".join(map(repr, self.weights.tolist()))), ",").cast("array<double>")  # folded into one constant
        total = F.aggregate(F.transform(F.col(grams), lambda g: F.get(table, g)), F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-(F.lit(self.bias) + total / F.sqrt(F.greatest(F.size(grams), F.lit(1)).cast("double")))))


def fit(table: DataFrame, url_col: str = "url", label_col: str = "label", buckets: int = BUCKETS, sizes: tuple[int, ...] = GRAMS, rounds: int = 1500, decay: float = 1e-4, prior: float = 0.3, most: int = 20_000) -> UrlModel:
    """Fit on a small labelled table of at most ``most`` rows (the first by URL); rows without url or label don't count.

    ``prior`` is the share of unwanted URLs that is reckoned with.  Gradient steps with momentum touch only the n-grams that a row has.
    """
    small = table.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).orderBy(url_col, label_col).limit(most)
    rows = with_grams(small, url_col, buckets, sizes).select("q_grams", F.col("q_own").getField(label_col)).collect()
    rows = [r for r in rows if r[0]]
    weights, bias, step = np.zeros(buckets), 0.0, 8.0
    y = np.array([r[1] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return UrlModel(weights, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), sizes)
    counts = np.array([len(r[0]) for r in rows])
    grams, scale, starts = np.concatenate([np.array(r[0]) for r in rows]), 1 / np.sqrt(counts), np.cumsum(counts) - counts
    share = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    ahead, speed = weights, np.zeros(buckets)
    for _ in range(rounds):
        error = share * (1 / (1 + np.exp(-(np.add.reduceat(ahead[grams], starts) * scale + bias))) - y)
        slope = np.bincount(grams, np.repeat(error * scale, counts), buckets) + decay * ahead
        speed = 0.9 * speed - step * slope
        weights = weights + speed
        ahead = weights + 0.9 * speed
        bias -= step * 0.1 * error.sum()
    return UrlModel(weights.round(6), float(bias), sizes)


def ruled(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path), or null, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("q_host") == host) | F.col("q_host").endswith(f".{host}")) & F.col("q_path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: UrlModel | None = None) -> DataFrame:
    """``pages`` with ``q_host``, ``q_path``, ``q_score``, ``q_rule`` and ``q_verdict``.

    A null URL or one without ``://`` has an empty host and path, no n-grams, and the verdict of the model's bias.
    Row by row: equal rows get equal verdicts, an empty table stays empty, very long URLs are read whole.  A column
    of ``pages`` keeps its name; where one has a name of ours, ours gets an underscore behind it.
    """
    model = model or fit(labelled(pages.sparkSession))
    name, verdict = ruled(rules)
    out = with_grams(pages, url_col, len(model.weights), model.sizes).withColumn("q_score", model.probability())
    verdict = F.coalesce(verdict, F.when(F.col("q_score") >= 0.5, "block").otherwise("allow"))
    return own_columns(out, pages.columns, q_host=F.col("q_host"), q_path=F.col("q_path"), q_score=F.col("q_score"), q_rule=name, q_verdict=verdict)


def digest(pages: DataFrame) -> DataFrame:
    """Host, path, rule, verdict and score of each row's url; see ``judge`` for nulls, repeats, empty tables and long URLs."""
    out = judge(pages.select("page_id", "url"))
    return out.select("page_id", F.col("q_host").alias("host"), F.col("q_path").alias("path"), F.col("q_rule").alias("rule"), F.col("q_verdict").alias("verdict"), F.col("q_score").alias("score"))

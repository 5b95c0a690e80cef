"""URL filters: host and path rules, and logistic regression on hashed character n-grams for all other URLs.

In DataFrame expressions and pyspark.ml stages alone. The regression is trained on a small labelled URL table; the
features are the 3- and 4-grams of the host (marked at both ends) and of the path, hashed.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: verdict, and host and path that a URL must fall under; the longest rule that fits wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs that a model is fitted on at most, by order of their hash.
TRAIN_URLS = 4000
BUCKETS = 1 << 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(verdict, rule); null if none does. A rule fits its host and all subdomains."""
    fits = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        cond = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        fits = F.when(cond, one) if fits is None else fits.when(cond, one)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if fits is None else fits


def _grams(host: Column, path: Column) -> Column:
    def of(mark: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    host = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[of(mark, text, n) for mark, text in (("h", host), ("p", path)) for n in (3, 4)])


def _features(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=BUCKETS, binary=True).transform(df.withColumn("grams", _grams(F.col("host"), F.col("path")))).drop("grams")


def fit(labelled: DataFrame, most: int = TRAIN_URLS):
    """A model from labelled URLs (host, path, blocked double), or None without any. At most `most` of them are used,
    distinct ones in order of their hash."""
    distinct = labelled.groupBy("host", "path").agg(F.max("blocked").alias("blocked"))
    sample = stored(distinct.orderBy(F.xxhash64("host", "path"), "host", "path").limit(most), "url-labels")
    if not sample.limit(1).count():
        return None
    return LogisticRegression(featuresCol="features", labelCol="blocked", maxIter=25, regParam=0.001, tol=1e-6).fit(_features(sample))


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, most: int = TRAIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, score for each row of pages (page_id, url, ...).

    verdict is that of the longest rule that fits; else block where the model's score (the chance that it is to be
    blocked) is 0.5 or more, else allow. labelled holds (url, blocked 0 or 1); without it the URLs of pages that a
    rule decides are the labelled table. Without any labelled URL the score is null and the verdict allow.

    A null URL or one without :// has an empty host and path and is judged by the model. Repeated rows are judged
    alike. An empty table gives an empty result; other columns are ignored.
    """
    split = lambda df: df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    one = split(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).drop("url")
    if labelled is None:
        known = one.filter("r is not null").select("host", "path", (F.col("r.verdict") == "block").cast("double").alias("blocked"))
    else:
        known = split(labelled.filter("url is not null and blocked is not null").select("url", F.col("blocked").cast("double").alias("blocked"))).drop("url")
    model = fit(known, most)
    if model is None:
        scored = one.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(_features(one)).withColumn("score", F.element_at(vector_to_array("probability"), 2) if model.numClasses > 1 else F.lit(0.0))
    guess = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", guess).alias("verdict"), "score")

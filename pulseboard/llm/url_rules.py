"""Operator 7: URL filtering with given host and path rules and mined association rules.

Given rules decide first: a rule fits its host and all subdomains if the path
starts with the rule's, and the longest wins. For the other URLs, Spark's
FP-growth mines combinations of URL tokens from labelled pages; combinations
with enough support and confidence for a bad label become rules. They match
through an inverted index: a rule stands under its rarest token, a URL looks up
its own tokens, and the rest of the rule is compared there.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end. A null URL, or
one without ``://``, has an empty host and path, fits no given rule, and has
only the tokens of its text. A page is bad if a label of its id says so; null
labels say nothing. Without labelled pages nothing is mined and such URLs are
allowed. Repeated rows give repeated rows; extra columns are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Support as a share of labelled pages, the same as a number of pages, and confidence of mined rules.
SUPPORT, LEAST_PAGES, CONFIDENCE = 0.002, 20, 0.6
#: The item that stands for a bad label; no URL token holds a space.
BAD = "bad label"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + F.lit(3))).otherwise("")
    raw = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.coalesce(rest, F.lit("")), F.char_length(raw) + F.lit(1)), "^[^?#]*", 0)
    return pages.select("*", F.translate(raw, _UPPER, _LOWER).alias("host"), path.alias("path"))


def given_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, host/path) pairs, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, where in sorted(rules, key=lambda r: len(r[1])):
        site, slash, start = where.partition("/")
        fits = ((F.col(host) == site) | F.col(host).endswith("." + site)) & F.col(path).startswith(slash + start)
        rule, verdict = F.when(fits, where).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def tokens(url: str = "url") -> Column:
    """The distinct runs of letters, digits and hyphens of a URL, lower-cased; numbers are one token."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(url), F.lit(""))), F.lit("[a-z0-9-]+"), F.lit(0))
    return F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "^[0-9]+$", "0")))


def mine(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, key, items, confidence, support) of the mined rules; ``key`` is the rarest token of ``items``."""
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    seen = pages.select(F.col(page_id).alias("id"), tokens(url).alias("own")).join(bad.where("bad is not null"), "id")
    baskets = seen.select(F.when(F.col("bad") == 1, F.concat("own", F.array(F.lit(BAD)))).otherwise(F.col("own")).alias("items")).where(F.size("items") > 0)
    n = baskets.count()
    if n < LEAST_PAGES:
        return pages.sparkSession.createDataFrame([], "rule long, key string, items array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, LEAST_PAGES / n)), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.col("antecedent").alias("items"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    rules = found.select(F.xxhash64("items").alias("rule"), "items", "confidence", "support")
    rarest = rules.select("rule", F.explode("items").alias("token")).join(single, "token").groupBy("rule").agg(F.min(F.struct("freq", "token")).alias("rarest"))
    return rules.join(rarest, "rule").select("rule", F.col("rarest.token").alias("key"), "items", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(url, confidence): the distinct URLs that some mined rule fits, with the best one's confidence."""
    own = urls.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("own", tokens("url"))
    hits = own.withColumn("key", F.explode("own")).join(rules, "key").where(F.size(F.array_except("items", "own")) == 0)
    return hits.groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, confidence); confidence is that of a mined rule, else null."""
    mined = mine(pages, labels, page_id, url)
    parts = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    rule, verdict = given_rule(rules)
    parts = parts.withColumn("rule", rule).withColumn("given", verdict)
    hits = matched(parts.where("given is null"), mined)
    out = parts.join(hits.withColumnRenamed("url", "hit"), (F.col("url") == F.col("hit")) & F.col("given").isNull(), "left")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("given", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")

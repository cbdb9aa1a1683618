"""URL verdicts: a list of rules first, then association rules mined from labelled URLs.

Tokens of a URL are the labels of its host and the segments of its path, numbers
written as `#`. FP-growth finds the token combinations that occur often among labelled
URLs; rules with enough support, confidence and lift for the label `block` are kept if
chance does not explain them: at least `LEAST_BAD` bad rows, and more bad ones among those
that fit than the base rate gives to any of the combinations looked at. They are matched through an inverted index: a rule is listed under its rarest token,
so a URL meets only rules that share that token, and is then held against the rest of
the rule. Equal token sets are matched once.

A null URL, or one without `://`, has an empty host, an empty path and no token, and
is allowed. Without labelled rows nothing is mined. Repeated rows are judged each.
Columns other than the key, the URL and the labels play no part.
"""

from __future__ import annotations

from math import log

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partforge.llm.staging import lower_ascii, staged

BLOCK = "=block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
LEAST_BAD = 5  # labelled bad rows under a rule
CHANCE = 0.05  # of one rule or more among all combinations where the label says nothing


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest (host, path, verdict) that fits, as its text and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels as `h:..`, path segments as `p:..`, without repeats, sorted."""
    names = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(F.regexp_replace(path, r"\d+", "#"), "/"), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(names, F.transform(parts, lambda x: F.concat(F.lit("p:"), x)))))


def evidence(rows: Column, confidence: Column, base: float) -> Column:
    """The least -log of the chance of so many bad ones among `rows` rows at the base rate (Chernoff's bound)."""
    rest = 1 - confidence
    good = F.when(rest > 0, rest * (F.log(rest) - log(1 - base))).otherwise(0.0)
    return F.when(confidence > base, rows * (confidence * (F.log(confidence) - log(base)) + good)).otherwise(0.0)


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """(index_token, antecedent, confidence, support) of the rules for `block`.

    `labelled` has tokens and a boolean bad. The number of rules is bounded by the
    support asked for, not by the rows. What chance may explain is left out alike at every
    size: the bound on it counts all labelled rows and all combinations that were frequent.
    """
    spark = labelled.sparkSession
    baskets = labelled.select(
        F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")
    )
    schema = "index_token string, antecedent array<string>, confidence double, support double"
    total, bad = labelled.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if bad < LEAST_BAD or bad == total:
        return spark.createDataFrame([], schema)
    base, least = bad / total, max(min_support, (LEAST_BAD - 0.5) / total)  # so that rounding loses no count
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets)
    tried = model.freqItemsets.where(~F.array_contains("items", BLOCK)).count()
    bad_rows = F.round(F.col("support") * total)
    kept = model.associationRules.where(
        (F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= min_lift) & (F.size("antecedent") > 0)
        & (bad_rows >= LEAST_BAD)
        & (evidence(F.round(bad_rows / F.col("confidence")), F.col("confidence"), base) >= log(max(tried, 1) / CHANCE))
    ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rules = (
        kept.withColumn("token", F.explode("antecedent"))
        .join(single, "token")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.min(F.struct("freq", "token")).alias("rarest"))
        .select(F.col("rarest.token").alias("index_token"), "antecedent", "confidence", "support")
    )
    return staged(rules, "url-rules")


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct `tokens` with a rule that fits: confidence and n_rules."""
    return (
        token_sets.select("tokens")
        .distinct()
        .withColumn("token", F.explode("tokens"))
        .join(rules, F.col("token") == F.col("index_token"))
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_rules"))
    )


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]],
               min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every row of `pages` (page_id, url).

    `labels` has doc_id, quality and toxic; a page with such an id is bad if its
    quality is 0 or it is toxic, and otherwise good. Null labels say nothing.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    seen = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "listed": verdict, "tokens": url_tokens(F.col("host"), F.col("path"))})
    )
    seen = staged(seen, "url-tokens")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where(F.col("bad").isNotNull())
    found = mined_rules(seen.join(known, "page_id").select("tokens", "bad"),
                        min_support, min_confidence, min_lift)
    hits = staged(matched(seen.where(F.col("listed").isNull()), found), "url-hits")
    return seen.join(hits, "tokens", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(F.col("n_rules") > 0, "block"), F.lit("allow")).alias("verdict"),
        "confidence",
    )

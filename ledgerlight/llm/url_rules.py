"""URL filters: stated rules by host and path, and association rules mined from labelled URLs.

A URL is a set of tokens: each label of its host, each segment of its path, each name in its query. FP-growth finds the
token sets that labelled URLs share; a rule says that URLs with all its tokens are bad. Rules are pruned by support and
confidence, and a rule goes when one with fewer of its tokens says the same. Rules are found through an inverted index
on one token of each, the one fewest URLs have.

Empty cases: a null URL, or one without ``://``, has empty host and path and no tokens, and is allowed; without labels
there are no rules; a URL is judged once per row, repeated or not.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of labelled URLs that must have all tokens of a rule and be bad, and share of bad ones among those with them.
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: Bad URLs that must have all tokens of a rule, however few are labelled.
MIN_HITS = 5
#: Most tokens in a rule.
MAX_TOKENS = 3


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(verdict, host, path) of the longest rule that fits, or null. A rule fits its host and all hosts under it."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [F.when(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
                   F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))) for verdict, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` host label, ``p:`` path segment, ``q:`` query name; host and path in lower case."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(
        tagged("h:", F.split(host, r"\.")), tagged("p:", F.split(F.translate(path, UPPER, LOWER), "/")),
        tagged("q:", names))))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url``, ``tokens`` and ``bad`` (low quality or toxic) of labelled pages; a page's labels are those of its id."""
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    rows = pages.select("page_id", "url", url_tokens(F.col("url")).alias("tokens")).filter(F.size("tokens") > 0)
    return rows.join(bad, F.col("page_id") == F.col("doc_id")).select("url", "tokens", "bad")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_hits: int = MIN_HITS, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``tokens``, ``support`` and ``confidence`` of rules that call a URL bad, none implied by a shorter one.

    Sets that are frequent among bad URLs are mined from those alone; their counts among all labelled URLs give the
    confidence. The number of rules is bounded by the support, not by the rows.
    """
    total, n_bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    least = max(min_hits, math.ceil(min_support * total))
    schema = "tokens array<string>, support double, confidence double"
    if n_bad < least:
        return labelled.sparkSession.createDataFrame([], schema)
    # Tokens of a few pages, ids say, cannot be in a frequent set: they go before the trees are grown.
    numbered = labelled.filter("bad").select(F.monotonically_increasing_id().alias("row"), "tokens")
    bad = cut_lineage(numbered).select("row", F.explode("tokens").alias("token"))
    common = bad.groupBy("token").count().filter(F.col("count") >= least).select("token")
    baskets = bad.join(common, "token").groupBy("row").agg(F.collect_set("token").alias("tokens"))
    model = FPGrowth(itemsCol="tokens", minSupport=(least - 0.5) / max(baskets.count(), least), minConfidence=1.0).fit(baskets)
    sets = model.freqItemsets.filter(F.size("items") <= max_tokens).select(
        F.array_sort("items").alias("tokens"), F.col("freq").alias("hits"))
    sets = cut_lineage(sets)
    seen = matches(labelled, sets).groupBy("rule").agg(F.count("*").alias("seen"))
    rules = sets.join(seen, F.col("tokens") == F.col("rule")).select(
        "tokens", (F.col("hits") / total).alias("support"), (F.col("hits") / F.col("seen")).alias("confidence"))
    rules = cut_lineage(rules.filter(F.col("confidence") >= min_confidence))
    # What a rule's subset says already, it need not say again.
    parts = rules.select("tokens", F.explode(F.filter(_subsets("tokens"), lambda x: F.size(x) < F.size("tokens"))).alias("part"))
    implied = parts.join(rules.select(F.col("tokens").alias("part")), "part").select("tokens").distinct()
    return rules.join(implied, "tokens", "left_anti").select("tokens", "support", "confidence")


def _subsets(tokens: str) -> Column:
    """All subsets with one or more tokens, in order; for sets of a few tokens."""
    empty = F.array(F.array().cast("array<string>"))
    return F.filter(F.aggregate(tokens, empty, lambda found, x: F.concat(
        found, F.transform(found, lambda s: F.concat(s, F.array(x))))), lambda s: F.size(s) > 0)


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and ``rule`` for each row of ``urls`` and each rule all of whose tokens it has.

    The index has one entry per rule, under its token that fewest URLs have; URLs look up each of their tokens.
    """
    use = rules.select("tokens", F.explode("tokens").alias("token"))
    wanted = use.select("token").distinct()
    looked = urls.select("url", F.col("tokens").alias("own"), F.explode("tokens").alias("token"))
    common = looked.select("token").join(wanted, "token").groupBy("token").agg(F.count("*").alias("urls"))
    index = use.join(common, "token").groupBy("tokens").agg(F.min(F.struct("urls", "token")).alias("least")).select(
        F.col("tokens").alias("rule"), F.col("least.token").alias("token"))
    return looked.join(index, "token").filter(F.size(F.array_intersect("own", "rule")) == F.size("rule")).select("url", "rule")


def judge(pages: DataFrame, labels: DataFrame, stated: list[tuple[str, str, str]]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (the stated one) and ``verdict`` for every row of ``pages``."""
    rules = mine_rules(labelled_urls(pages, labels))
    rows = pages.select("page_id", "url")
    tokens = rows.select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    blocked = matches(tokens, rules).select("url").distinct().withColumn("mined", F.lit(True))
    host, path = host_and_path(F.col("url"))
    judged = rows.join(blocked, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined")
    found = stated_rule(F.col("host"), F.col("path"), stated)
    return judged.select(
        "page_id", "host", "path", found["rule"].alias("rule"),
        F.coalesce(found["verdict"], F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))

"""Operator 3: URL filters from association rules, mined by FP-growth on labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import free_name
from quillgraph.sources.staging import small_enough, stage


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL in order: scheme, parts of the host with its place from the right, path words, query and fragment.

    Letters are lower-cased; a number is the token ``path:#``, as its value
    says nothing of other pages. Null gives null, an empty URL no tokens.
    """
    u = F.lower(url)
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    scheme = F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1)
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:[0-9]*$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    anchor = F.regexp_extract(rest, r"#(.*)$", 1)

    def words(text: Column, cut: str, tag: str) -> Column:
        parts = F.filter(F.split(text, cut), lambda w: w != "")
        return F.transform(parts, lambda w: F.concat(F.lit(tag), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))

    one = F.filter(F.array(F.when(scheme != "", F.concat(F.lit("scheme:"), scheme))), lambda w: w.isNotNull())
    every = F.concat(one, words(host, r"\.", "host:"), words(path, r"[^\p{L}\p{N}]+", "path:"), words(query, r"&", "query:"), words(anchor, r"[^\p{L}\p{N}]+", "anchor:"))
    return F.when(url.isNotNull(), F.array_sort(F.array_distinct(every)))


def mine_rules(labelled: DataFrame, min_support: int = 5, min_confidence: float = 0.6, url: str = "url", bad: str = "bad", min_share: float = 0.0005, broadcast_sets: int = 100_000) -> DataFrame:
    """``(tokens, support, bad, confidence)`` of the token combinations that predict a bad URL.

    A rule holds for ``min_support`` bad URLs and the share ``min_share`` of them
    at least, so that the number of combinations doesn't grow with the labels;
    the share ``min_confidence`` of its URLs is bad. A rule is left out if a part
    of it is as confident. Combinations are mined among the bad URLs alone; how
    many other URLs have them is counted by an inverted index on their rarest
    token. Tokens that always appear together are mined as one, as every choice of
    them has the same support; a rule names them all. Rows with a null URL or
    label are left out, repeated rows count each; without enough bad URLs there
    are no rules.
    """
    rows = labelled.where(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(url_tokens(F.col(url)).alias("tokens"), F.col(bad).cast("int").alias("bad"), F.monotonically_increasing_id().alias("id"))
    rows = stage(rows)
    each = rows.select("id", F.explode("tokens").alias("token"))
    n_bad = rows.where("bad = 1").count()
    spark = labelled.sparkSession
    schema = "tokens array<string>, support long, bad long, confidence double"
    min_support = max(1, min_support, math.ceil(min_share * n_bad))
    if n_bad < min_support:
        return spark.createDataFrame([], schema)
    # Only tokens with enough bad URLs can be part of a rule.
    common = rows.where("bad = 1").select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= min_support).select("token")
    kinds = (
        each.join(common, "token")
        .groupBy("token")
        .agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("where"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("where2"))
        .groupBy("n", "where", "where2")
        .agg(F.array_sort(F.collect_list("token")).alias("members"))
        .select(F.col("members")[0].alias("item"), "members", "n")
    )
    kinds = stage(kinds)
    baskets = stage(rows.select("id", "bad").join(each.join(kinds, each.token == kinds.item).groupBy("id").agg(F.collect_list("item").alias("items")), "id"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support / n_bad * (1 - 1e-9), 1e-12), minConfidence=0.0).fit(baskets.where("bad = 1"))
    sets = stage(model.freqItemsets.select(F.array_sort("items").alias("whole"), F.col("freq").alias("bad")).where(F.col("freq") >= min_support))
    rarest = sets.select("whole", F.explode("whole").alias("item")).join(kinds.select("item", "n"), "item").groupBy("whole").agg(F.min(F.struct("n", "item"))["item"].alias("item"))
    rarest = stage(rarest)
    side = F.broadcast(rarest) if small_enough(rarest, broadcast_sets) else rarest
    # Small rows, much work each: so many tasks, however few bytes there are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = baskets.where("bad = 0").repartition(tasks, "id").select("items", F.explode("items").alias("item")).join(side, "item").where(F.size(F.array_except("whole", "items")) == 0)
    good = others.groupBy("whole").agg(F.count("*").alias("good"))
    support = F.col("bad") + F.coalesce("good", F.lit(0))
    rules = sets.join(good, "whole", "left").select(F.col("whole").alias("items"), support.alias("support"), "bad", (F.col("bad") / support).alias("confidence"))
    rules = stage(rules.where(F.col("bad") >= F.col("support") * min_confidence))
    # A part of a rule with one item less, or further down one that itself is pruned, is met by way of its items.
    a, b = rules.select(F.explode("items").alias("i"), F.col("items").alias("whole"), F.col("confidence").alias("c")), rules.select(F.col("items")[0].alias("i"), F.col("items").alias("part"), F.col("confidence").alias("pc"))
    covered = a.join(b, "i").where((F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0) & (F.col("pc") >= F.col("c"))).select(F.col("whole").alias("items")).distinct()
    kept = rules.join(covered, "items", "left_anti")
    named = kept.withColumn("item", F.explode("items")).join(kinds, "item").groupBy("items", "support", "bad", "confidence").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("tokens"))
    return named.select("tokens", "support", "bad", "confidence")


def match_rules(pages: DataFrame, rules: DataFrame, url: str = "url", max_broadcast_rules: int = 100_000) -> DataFrame:
    """``(url, rule_tokens, confidence)`` of the distinct URLs that a rule rejects, with its most confident rule.

    Rules are indexed by their rarest token. A URL's tokens look the rules up,
    and a rule matches if the URL has all its tokens. Up to
    ``max_broadcast_rules`` rules are broadcast; more are joined by shuffle.
    """
    rules = stage(rules)
    token_n = rules.select(F.explode("tokens").alias("token"), "support").groupBy("token").agg(F.sum("support").alias("n"))
    index = rules.withColumn("token", F.explode("tokens")).join(token_n, "token")
    index = index.groupBy("tokens", "confidence", "support").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    index = stage(index)
    if not index.limit(1).count():
        return pages.sparkSession.createDataFrame([], "url string, rule_tokens array<string>, confidence double")
    side = index.select("token", F.col("tokens").alias("rule_tokens"), "confidence", "support")
    side = F.broadcast(side) if small_enough(index, max_broadcast_rules) else side
    urls = pages.select(F.col(url).alias("url")).where("url is not null").withColumn("tokens", url_tokens(F.col("url")))
    met = urls.withColumn("token", F.explode("tokens")).join(side, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("rule_tokens").alias("n"), "rule_tokens"))
    return met.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule_tokens").alias("rule_tokens"), (-F.col("best.c")).alias("confidence"))


def filter_urls(pages: DataFrame, labelled: DataFrame, min_support: int = 5, min_confidence: float = 0.6, url: str = "url", rejected: str = "rejected", rule: str = "rule_tokens", confidence: str = "rule_confidence") -> DataFrame:
    """``pages`` with whether a rule rejects the URL, the rule's tokens and its confidence.

    ``labelled`` has ``url`` and ``bad`` (0 or 1). Of several rules the most
    confident is named, then the one with most URLs, then the shortest, then the
    first in the order of tokens. A null URL is never rejected, equal URLs are
    treated alike; without labels or rules nothing is rejected, and a table
    without pages stays empty. URLs of any length are read whole. Columns of the
    result's names are replaced.
    """
    hits = match_rules(pages, mine_rules(labelled, min_support, min_confidence), url)
    u, t, c = free_name(pages, "hit_url", "hit_tokens", "hit_confidence")
    named = hits.toDF(u, t, c)
    gone = {x.lower() for x in (rejected, rule, confidence)}
    out = pages.join(named, pages[url] == F.col(u), "left")
    return out.select(*[pages[x] for x in pages.columns if x.lower() not in gone], F.col(u).isNotNull().alias(rejected), F.col(t).alias(rule), F.col(c).alias(confidence))

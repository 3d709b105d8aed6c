"""URL filters by association rules (native).

URLs become sets of tokens (parts of the host by their place from the right,
path segments by their place from the left, query keys, file endings).  Spark's
FP-growth mines token combinations that go with a label; rules of enough
support and confidence stay, unless a shorter rule is at least as sure.  Tokens
that occur in exactly the same examples are mined as one and written out again
afterwards: no rule is lost, and a deep URL that many examples share doesn't
square the number of sets at every segment.  An inverted index lists every rule under its rarest token; a URL looks up its own
tokens and a rule fires when all its tokens are there.  The surest rule decides.

The list of fixed rules (host and path prefix) comes first.  It is matched by
the same kind of index: every host is looked up with all its suffixes.

Defined results: a NULL URL or one without ``://`` has an empty host and path,
no tokens and the default verdict; an empty table gives an empty result; without
labels no rule is mined; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage

#: Host and path prefix -> verdict.
LISTED: tuple[tuple[str, str], ...] = (
    ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCK, ALLOW = "block", "allow"
SALT = 16


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, at any depth: host labels by their place from the right, path segments by their place
    from the left (runs of digits count as one token), query keys and the file ending."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    keys = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    name = lambda kind: lambda x, i: F.concat(F.lit(kind), i.cast("string"), F.lit(":"), x)
    tokens = F.concat(F.transform(labels, name("h")), F.transform(segments, name("p")), keys,
                      F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.when(host == "", F.array().cast("array<string>")).otherwise(tokens))


def parsed(urls: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, then host, path, tokens."""
    out = urls.select(*keep, F.coalesce("url", F.lit("")).alias("url"))
    out = out.select(*keep, "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    return out.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url")


def listed_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = LISTED) -> Column:
    """The longest listed rule that fits, as struct(rule, verdict); NULL if none.

    The rules are indexed by host at plan time (a literal map host -> its rules), probed with the host's suffixes,
    so a URL meets only rules of its own domains.
    """
    by_host: dict[str, list] = {}
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        by_host.setdefault(h, []).append(
            F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
                     F.lit("/" + p).alias("path")))
    index = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    fits = F.filter(F.flatten(F.filter(F.transform(host_suffixes(host), lambda s: F.try_element_at(index, s)),
                                       lambda x: x.isNotNull())),
                    lambda r: path.startswith(r["path"]))
    best = F.array_max(fits)
    return F.when(F.size(fits) > 0, F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """``(items, verdict)`` -> ``(token, rep)`` of the tokens in ``least`` examples or more.

    Tokens of the same examples share their smallest token as ``rep``: they have equal numbers of examples and equal
    sums of two 64-bit hashes of them.
    """
    whole = F.array_join("items", "\u0001")
    seen = (baskets.select(F.explode("items").alias("token"), F.xxhash64(whole, "verdict").cast("decimal(38,0)").alias("a"),
                           F.xxhash64("verdict", whole, F.lit(1)).cast("decimal(38,0)").alias("b"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
            .where(F.col("n") >= least))
    # sums are exact decimals, so that examples read in another order give the same classes
    reps = seen.groupBy("n", "a", "b").agg(F.collect_list("token").alias("tokens"))
    return reps.select(F.array_min("tokens").alias("rep"), F.explode("tokens").alias("token"))


def _subsets(tokens: Column) -> Column:
    """All proper, not empty subsets of a sorted array, each in its order."""
    start = F.array(F.array().cast("array<string>"))
    every = F.aggregate(tokens, start, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    return F.filter(every, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(tokens)))


def _rule_id(tokens: Column, verdict: Column) -> Column:
    return F.xxhash64(F.array_join(tokens, "\u0001"), verdict)


def mine_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7) -> DataFrame:
    """``(tokens, verdict)`` -> rules ``(rule_id, antecedent, verdict, confidence, support)``.

    The label is an item of the basket; kept are rules whose consequent is the
    label.  A rule goes if a rule with fewer of its tokens and the same verdict
    is at least as sure.  Their number is bounded by the support, not by the input.
    """
    label = F.concat(F.lit("label="), F.col("verdict"))
    baskets = stage(labelled.where(F.size("tokens") > 0).select(F.col("tokens").alias("items"), "verdict"), "url-examples")
    classes = stage(token_classes(baskets, max(1, math.ceil(min_support * baskets.count()))), "url-tokens")
    # one item per class and basket; baskets without a frequent token still count towards the support
    spread = (baskets.withColumn("row", F.monotonically_increasing_id())
              .select("row", label.alias("label"), F.explode("items").alias("token"))
              .join(classes, "token", "left").groupBy("row", "label").agg(F.collect_set("rep").alias("reps")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(
        spread.select(F.concat("reps", F.array("label")).alias("items")))
    rules = (model.associationRules
             .where(F.col("consequent")[0].startswith("label="))
             .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
             .select(F.array_sort("antecedent").alias("reps"),
                     F.substring(F.col("consequent")[0], 7, 100).alias("verdict"),
                     F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
             .withColumn("class_rule", _rule_id(F.col("reps"), F.col("verdict"))))
    rules = stage(rules, "url-rules")
    # a rule looks its own subsets up by their ids: rules that merely share a token never meet
    longer = rules.select("class_rule", "verdict", F.col("confidence").alias("own"), F.explode(_subsets(F.col("reps"))).alias("part"))
    needless = (longer.select("class_rule", "own", _rule_id(F.col("part"), F.col("verdict")).alias("short"))
                .join(rules.select(F.col("class_rule").alias("short"), "confidence"), "short")
                .where(F.col("confidence") >= F.col("own")).select("class_rule").distinct())
    kept = rules.join(needless, "class_rule", "left_anti")
    # back to tokens: one rule for every choice of one token per class
    members = classes.groupBy("rep").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    choices = (kept.select("class_rule", F.explode("reps").alias("rep")).join(members, "rep")
               .groupBy("class_rule").agg(F.collect_list("tokens").alias("choices")))
    start = F.array(F.array().cast("array<string>"))
    product = F.aggregate("choices", start, lambda acc, one: F.flatten(
        F.transform(acc, lambda s: F.transform(one, lambda x: F.concat(s, F.array(x))))))
    written = (kept.join(choices, "class_rule")
               .select(F.explode(product).alias("antecedent"), "verdict", "confidence", "support")
               .withColumn("antecedent", F.array_sort("antecedent")))
    return written.select(_rule_id(F.col("antecedent"), F.col("verdict")).alias("rule_id"), "antecedent", "verdict",
                          "confidence", "support")


def rule_index(rules: DataFrame) -> DataFrame:
    """Postings: every rule once, under the token that the fewest rules hold (ties: the larger token)."""
    spread = rules.select("rule_id", F.explode("antecedent").alias("token"))
    uses = spread.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    key = (spread.join(uses, "token").groupBy("rule_id")
           .agg(F.max(F.struct(-F.col("uses"), F.col("token")))["token"].alias("token")))
    return rules.join(key, "rule_id")


def rule_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id-free matching: one row per distinct token set that a rule fits, with the surest rule's verdict.

    Equal token sets are judged once, so a hot site costs one row per shape of URL before any shuffle by token.
    """
    shapes = pages.where(F.size("tokens") > 0).select("tokens").distinct()
    index = stage(rule_index(rules), "url-rule-index")
    probes = shapes.select("tokens", F.explode("tokens").alias("token"))
    hits = (probes.join(index, "token")
            .where(F.size(F.array_except("antecedent", "tokens")) == 0))
    surest = F.max(F.struct("confidence", "support", F.size("antecedent"), (F.col("verdict") == BLOCK),
                            F.col("antecedent").alias("antecedent"), F.col("verdict").alias("verdict")))
    return (hits.groupBy("tokens").agg(surest.alias("best"))
            .select(F.col("tokens").alias("m_tokens"), F.col("best.verdict").alias("mined"),
                    F.array_join(F.col("best.antecedent"), " ").alias("mined_rule"),
                    F.col("best.confidence").alias("confidence")))


def url_filter(pages: DataFrame, listed: Iterable[tuple[str, str]] = LISTED, labels: DataFrame | None = None,
               default: str = ALLOW, min_support: float = 0.002, min_confidence: float = 0.7) -> DataFrame:
    """Judge every URL: page_id, host, path, rule, verdict, mined_rule, confidence.

    ``labels`` (url, verdict) are the examples to mine.  Without it, the URLs
    that the list judges are the examples: the list's verdicts, mined as token
    combinations, carry over to the URLs that it does not reach.
    """
    judged = parsed(pages, "page_id").withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    if labels is None:
        examples = judged.where(F.col("listed").isNotNull()).select("tokens", F.col("listed.verdict").alias("verdict"))
    else:
        examples = parsed(labels, "verdict")
    mined = rule_verdicts(judged.where(F.col("listed").isNull()), mine_rules(examples, min_support, min_confidence))
    # one shape of URL may hold a third of all pages: its rows are dealt over SALT parts, its verdict is in each
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    mined = mined.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (salted.join(mined, (F.col("tokens") == F.col("m_tokens")) & (F.col("salt") == F.col("m_salt"))
                        & F.col("listed").isNull(), "left")
            .select("page_id", "host", "path", F.col("listed.rule").alias("rule"),
                    F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"),
                    F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"),
                    F.when(F.col("listed").isNull(), F.col("confidence")).alias("confidence")))

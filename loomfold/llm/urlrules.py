"""URL filters by association rules, by DataFrame functions and Spark's FP-growth alone.

A rule list (host, path prefix, verdict) judges what it fits; its verdicts label those URLs.
FP-growth mines the token combinations that go with blocked ones; rules pruned by support and
confidence then judge the URLs that no listed rule fits, through an inverted index from token to rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import ascii_lower

BLOCKED = "verdict=block"


@dataclass(frozen=True)
class UrlRules:
    """``listed``: (verdict, host and path prefix); the longest that fits wins.

    ``support``: least share of the labelled URLs that hold a rule's tokens and are blocked;
    ``confidence``: least share of blocked ones among those that hold its tokens.
    ``least``: URLs a rule must block at any rate: what was seen once is no association.
    """
    listed: tuple[tuple[str, str], ...] = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
    support: float = 0.005
    confidence: float = 0.9
    least: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``, and for null."""
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, cut, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, cut, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: UrlRules) -> Column:
    """The longest listed rule that fits, as a struct of rule and verdict; null if none does."""
    found = None
    for verdict, rule in sorted(rules.listed, key=lambda r: (-len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        one = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return found if found is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def tokens(host: Column, path: Column) -> Column:
    """Distinct marked tokens: host labels, and the words of the path (a run of digits counts as one word, whatever its value)."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "0"), "[^a-z0-9]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, words), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, rules: UrlRules) -> DataFrame:
    """Rules (rule_id, rule_tokens) from ``labelled`` (tokens, blocked), pruned.

    A rule goes if another has a part of its tokens and no less confidence: what it would block,
    the other blocks too.  Tokens below the support are left out before mining, which changes no
    rule.  ``labelled`` is read more than once and should be a stored table.
    """
    total = labelled.count()
    support = max(rules.support, rules.least / max(total, 1))
    least = max(rules.least, int(rules.support * total))
    often = labelled.where("blocked").select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least).select("token")
    # at most (tokens a URL) / support of them, so they fit one row
    words = F.broadcast(often.agg(F.collect_set("token").alias("_often")))
    items = (labelled.join(words).select(F.concat(F.array_intersect("tokens", F.col("_often")),
                                                  F.when(F.col("blocked"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items"))
             .where(F.size("items") > 0))
    model = FPGrowth(minSupport=min(1.0, support * 0.999), minConfidence=rules.confidence).fit(items)
    found = (model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCKED)))
             .select(F.array_sort("antecedent").alias("rule_tokens"), "confidence"))
    found = keep(found.withColumn("rule_id", F.xxhash64(F.array_join("rule_tokens", "\x1f"))))
    parts = found.select(F.col("rule_id").alias("_id"), F.col("rule_tokens").alias("_part"), F.col("confidence").alias("_conf"), F.element_at("rule_tokens", 1).alias("_first"))
    wider = found.select("rule_id", "rule_tokens", "confidence", F.explode("rule_tokens").alias("_first"))
    covered = (wider.join(parts, "_first").where((F.size("_part") < F.size("rule_tokens")) & (F.col("_conf") >= F.col("confidence"))
                                                & (F.size(F.array_intersect("rule_tokens", "_part")) == F.size("_part"))).select("rule_id").distinct())
    return found.join(covered, "rule_id", "left_anti").select("rule_id", "rule_tokens")


def blocked_sets(sets: DataFrame, mined: DataFrame) -> DataFrame:
    """``sets`` (set_id, tokens) that hold all tokens of some rule: set_id, matched_rules."""
    index = mined.select(F.explode("rule_tokens").alias("token"), "rule_id", F.size("rule_tokens").alias("_need"))
    hits = sets.select("set_id", F.explode("tokens").alias("token")).join(index, "token")
    full = hits.groupBy("set_id", "rule_id", "_need").agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("_need"))
    return full.groupBy("set_id").agg(F.count("*").alias("matched_rules"))


def judge(pages: DataFrame, rules: UrlRules = UrlRules(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and matched_rules of every row.

    A null URL or one without ``://`` has empty host and path, fits no listed rule, holds no
    token, and is allowed.  Repeated rows are judged each; an empty table gives an empty one;
    other columns are ignored.  URLs with the same tokens are matched once, and tokens outside
    the rules are dropped before, so no token's URLs meet in one task.
    """
    host, path = host_and_path(F.col("_url"))
    cut = (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
           .withColumn("_listed", listed_rule(F.col("host"), F.col("path"), rules)))
    seen = keep(cut.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), F.col("_listed.verdict").alias("_verdict"),
                           tokens(F.col("host"), F.col("path")).alias("tokens")))
    labelled = seen.where(F.col("_verdict").isNotNull()).select("tokens", (F.col("_verdict") == "block").alias("blocked"))
    mined = keep(mine(labelled, rules))
    # at most (tokens a URL) / support tokens
    words = F.broadcast(mined.select(F.explode("rule_tokens").alias("t")).agg(F.collect_set("t").alias("_used")))
    judged = seen.join(words).withColumn("_set", F.array_sort(F.array_intersect("tokens", "_used"))).drop("tokens", "_used")
    judged = judged.withColumn("set_id", F.when(F.col("_verdict").isNull() & (F.size("_set") > 0), F.sha2(F.array_join("_set", "\x1f"), 256)))
    sets = judged.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.first("_set").alias("tokens"))
    hits = keep(blocked_sets(sets, mined))
    out = judged.join(hits, "set_id", "left")
    by_method = F.when(F.col("matched_rules") > 0, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_method).alias("verdict"), F.coalesce("matched_rules", F.lit(0)).alias("matched_rules"))

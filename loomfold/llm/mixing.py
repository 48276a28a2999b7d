"""Mixing sources to target weights, by DataFrame functions alone.

Every document gets a hash-random key.  A source's keys are cut into ranges of about equal count,
so the order within a source is a sort within ranges plus a prefix sum over the ranges' token
counts, whatever share of the rows the source holds.  The cut falls at the source's budget; a
budget beyond the source's size repeats the source in whole epochs first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomfold.lineage import keep
from loomfold.llm.common import WORD, free_name

#: Width of the keys: 15 hexadecimal digits.
KEY_SPACE = float(1 << 60)


@dataclass(frozen=True)
class MixRules:
    """``weights`` repeat over the sources in code point order, null last; ``most`` bounds a target by that many times its source's size.

    ``range_rows``: documents that one range of keys should hold.
    """
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: str = "mix-1"
    range_rows: int = 2_000


def word_count(text: Column) -> Column:
    """Words of a text, null as none: the gaps after white space is squeezed and trimmed."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(plain), F.lit(0)) == 0, 0).otherwise(F.size(F.split(plain, " +"))).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """A number below KEY_SPACE from the id and the seed alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, rules: MixRules) -> DataFrame:
    """``sources`` (source, source_size, n_rows; one row each) with ``target``.

    Shares by weight, each capped at ``most`` times its size: in order of cap per weight, the
    sources before some point are capped, and the others share what is left by weight.  The
    windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(rules.weights)
    rank = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(w) for w in rules.weights]), rank + 1)
    capped = sources.withColumn("_weight", weight.cast("long")).withColumn("_cap", rules.most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = (capped.withColumn("_left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
              .withColumn("_others", F.sum("_weight").over(after)).withColumn("_at", F.row_number().over(order)))
    first = F.min(F.when(F.col("_left") * F.col("_weight") <= F.col("_cap") * F.col("_others"), F.col("_at"))).over(everyone)
    split = placed.withColumn("_first", first)
    left = F.max(F.when(F.col("_at") == F.col("_first"), F.col("_left"))).over(everyone)
    others = F.max(F.when(F.col("_at") == F.col("_first"), F.col("_others"))).over(everyone)
    share = F.when(F.col("_at") >= F.col("_first"), F.col("_weight") * left / others).otherwise(F.col("_cap").cast("double"))
    return split.withColumn("target", F.coalesce(share, F.col("_cap").cast("double"))).select("source", "source_size", "n_rows", "target")


def plan_mix(sized: DataFrame, rules: MixRules = MixRules()) -> DataFrame:
    """``sized`` (row columns with doc_id, source and size) with source_size, target and ``copies``.

    ``copies``: how often the mix takes the document.  A document belongs to the last, partial
    epoch if its middle word lies before the cut, so a source misses its target by half a
    document at most.  Repeated rows count each; ties of the key are ordered by id and size.
    ``sized`` is read more than once and should be a stored table.
    """
    sources = keep(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), rules))
    named = sources.withColumnRenamed("source", "_source")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / rules.range_rows))
    keyed = (sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("_key", random_key(F.col("doc_id"), rules.seed))
             .withColumn("_range", F.floor(F.col("_key") / KEY_SPACE * ranges)).drop("n_rows"))
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    offsets = keep(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(
        Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum"))
    at = offsets.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before")
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    start = F.col("_before") + F.col("_inside")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    return (placed.join(at, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")
            .withColumn("copies", F.when(F.col("size") > 0, whole + F.when(start + F.col("size") / 2 < rest, 1).otherwise(0)).otherwise(0).cast("long"))
            .drop("_key", "_range", "_inside", "_before"))


def mix_plan(docs: DataFrame, rules: MixRules = MixRules(), text: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document, without the texts.

    A null or empty text has no words and is never taken; null sources are one source, the last;
    an empty table gives an empty one; columns other than doc_id, source and the text are ignored.
    """
    return plan_mix(keep(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))), rules)


def mixed(docs: DataFrame, rules: MixRules = MixRules(), text: str = "text") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken (copies of a row are equal)."""
    named = {c: free_name(docs, f"_d{i}") for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(c).alias(n) for c, n in named.items()], F.col("doc_id").alias("doc_id"), F.col("source").alias("source"),
                      word_count(F.col(text)).alias("size"))
    taken = plan_mix(keep(own), rules)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.where("copies > 0").withColumn("_copy", copies).select(*[F.col(n).alias(c) for c, n in named.items()])

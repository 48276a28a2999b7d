"""Places of rows inside groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from loomfold.functions.text import col
from loomfold.lineage import broadcast_if_small, keep


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """``rows`` with their place (from 1) in their group by ``order``; null sorts first, equal rows get consecutive places.

    Rows are dealt over tasks by range of group and order, so a group that holds a third of all
    rows spans many of them.  Each (range, group) is counted, the counts are summed over the ranges
    of a group -- as many rows as ranges, not as rows -- and added to the place inside the range.
    """
    by = [col(c).asc_nulls_first() for c in (*group, *order)]
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the id of a row breaks ties, so a run of equal rows can be dealt over ranges too
    marked = keep(rows.withColumn("_row", F.monotonically_increasing_id()))
    dealt = marked.repartitionByRange(ranges, *by, "_row").sortWithinPartitions(*by, "_row").withColumn("_at", F.monotonically_increasing_id())
    placed = keep(dealt.withColumn("_range", F.shiftright("_at", 33).cast("int")))
    named = {g: f"_g{i}" for i, g in enumerate(group)}
    pieces = placed.groupBy("_range", *[col(g).alias(n) for g, n in named.items()]).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*named.values()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("_range").alias("_in"), *named.values(), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(n)) for g, n in named.items()], F.col("_range") == F.col("_in"))
    found = placed.join(broadcast_if_small(starts, 50_000), same)             # a key is a group inside a range: no hotter than a range
    return found.select(*[col(c) for c in rows.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(out))

"""References between records: who points at nobody, and who points in a circle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomfold.functions.text import col, norm_key
from loomfold.lineage import cut, salted_lookup
from loomfold.operators.positions import positions


def reference_graph(records: DataFrame, target: str, pointer: str) -> DataFrame:
    """(node, points_to): one row per known value of ``target``; where two records
    share it the last one speaks.  Pointers leading nowhere are null."""
    return (records.withColumns({"node": norm_key(col(target)), "_to": norm_key(col(pointer))}).where("node <> ''")
            .groupBy("node").agg(F.max_by(F.struct("_to", "_rid", "key"), "_seq").alias("last"))
            .select("node", F.col("last._to").alias("points_to"), F.col("last._rid").alias("_rid"), F.col("last.key").alias("key")))


def orphan_references(records: DataFrame, target: str, pointer: str) -> DataFrame:
    """(missing, n_reports): distinct pointers are compared, not rows."""
    pointed = (records.select(norm_key(col(pointer)).alias("missing")).where("missing <> ''")
               .groupBy("missing").agg(F.count(F.lit(1)).alias("n_reports")))
    known = records.select(norm_key(col(target)).alias("missing")).where("missing <> ''").distinct()
    return pointed.join(known, "missing", "left_anti")


def orphan_refs(orphans: DataFrame, records: DataFrame, pointer: str) -> DataFrame:
    """(subject, ref): the records behind each missing value."""
    return (records.withColumn("missing", norm_key(col(pointer))).where("missing <> ''").join(orphans.select("missing"), "missing", "left_semi")
            .select(F.concat(F.lit("manager:"), "missing").alias("subject"), F.col("key").alias("ref"), "_rid"))


#: Peeling goes on while it takes at least this share of what is left: then chains of some length remain.
PEELED_SHARE = 1 / 16
#: A value that more than this share of the chains leads to is looked up in many tasks.
HOT_SHARE, HOT_MINIMUM = 1 / 200, 1_000


def peeled(step: DataFrame) -> tuple[DataFrame, int]:
    """(node, next) without what no cycle runs through, and how many rows that is.

    Round by round nodes that nothing points at and pointers that lead nowhere go.  Hierarchies
    thin out by their width each round, so a tree is gone before anything collapses on its root;
    rounds end once they take little, which leaves cycles and long thin chains.
    """
    current, n = step, step.count()
    while n:
        pointed = current.select(F.col("next").alias("node")).distinct()
        leads = current.select(F.col("node").alias("next"))
        smaller = cut(current.join(pointed, "node", "left_semi").join(leads, "next", "left_semi").select("node", "next"))
        left = smaller.count()
        gone, current, n = n - left, smaller, left
        if gone <= PEELED_SHARE * (left + gone):
            break
    return current, n


def _followed(jump: DataFrame, ahead: DataFrame, n: int) -> DataFrame:
    """``jump`` (next, ...) joined to ``ahead`` (unique on next); values that very many lead to are spread over tasks."""
    if n <= HOT_MINIMUM:
        return jump.join(ahead, "next")
    hot = jump.groupBy("next").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(HOT_MINIMUM, int(n * HOT_SHARE))).select("next")
    return salted_lookup(jump, ahead.withColumn("_known", F.lit(True)), "next", hot, "node").where("_known").drop("_known")


def reference_cycles(graph: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, cycle) for every member of a cycle longer than one.

    Trees are peeled off first; then pointers are doubled: chains that end drop out, and what the
    remaining ones lead to shrinks to the members of cycles.
    """
    step = cut(graph.where("points_to <> '' AND points_to <> node").select("node", F.col("points_to").alias("next")))
    base, alive = peeled(step)
    jump, image = base, None
    for _ in range(max_rounds):
        if alive == 0:
            break
        ahead = jump.select(F.col("node").alias("next"), F.col("next").alias("_after"))
        jump = cut(_followed(jump, ahead, alive).select("node", F.col("_after").alias("next")))
        left = jump.count()
        reached = jump.select("next").distinct().count()
        if left == alive and reached == image:
            break
        alive, image = left, reached
    members = cut(jump.select(F.col("next").alias("node")).distinct())
    ring = cut(base.join(members, "node", "left_semi").withColumn("least", F.least("node", "next")))
    for _ in range(max_rounds):
        ahead = ring.select(F.col("node").alias("next"), F.col("next").alias("_after"), F.col("least").alias("_least"))
        nxt = cut(ring.join(ahead, "next").select("node", F.col("_after").alias("next"), F.least("least", "_least").alias("least"),
                                                  (F.col("_least") < F.col("least")).alias("changed")))
        moved = nxt.where("changed").limit(1).count()
        ring = nxt.drop("changed")
        if moved == 0:
            break
    return ring.select("node", F.col("least").alias("cycle"))


def cycle_members(cycles: DataFrame, graph: DataFrame) -> DataFrame:
    """(cycle, position, key): the options of each cycle in order, as rows, however long it is."""
    return positions(cycles.join(graph.select("node", "key"), "node").select("cycle", "key"), ["cycle"], ["key"])


def cycle_subjects(cycles: DataFrame, graph: DataFrame) -> DataFrame:
    """(cycle, subject, n_members, keys): the keys in order name the question, however many."""
    keyed = cycles.join(graph.select("node", "key", "_rid"), "node")
    return (keyed.groupBy("cycle").agg(F.count(F.lit(1)).alias("n_members"), F.array_sort(F.collect_list("key")).alias("keys"))
            .withColumn("subject", F.concat(F.lit("cycle:"), F.array_join("keys", "|"))))

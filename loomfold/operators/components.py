"""Transitive grouping of rows by shared identifiers.

The graph is over distinct identifier *values*, not rows: rows carrying the same
identifiers collapse in a map-side combine before anything else happens, and an
edge says that two values occurred on one row.  Components are found by
alternating large-star and small-star steps, which halve chains instead of
walking them; each round is two windows and what drops duplicates, written out,
and the rounds end as soon as every edge leads to the centre of a star.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from loomfold.functions.text import col, norm_key
from loomfold.lineage import cut, keep, recorded, release, salted_lookup

HOT_SHARE = 1_000          # a node is hot if it holds over 1/HOT_SHARE of all edge ends
HOT_MINIMUM = 100_000


def _closer(edges: DataFrame, hot: DataFrame | None, large: bool) -> DataFrame:
    """One star step over (u, v), u > v: link neighbours to the least one they share.

    Every edge becomes one edge, so nothing grows before the round's duplicates are dropped.
    ``hot``: nodes whose edges would land on one task; there are at most HOT_SHARE of those, so
    their least neighbours are aggregated and travel by broadcast instead.
    """
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = lambda rows: rows.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    if hot is None:
        linked = least(both)
    else:
        hot = F.broadcast(hot)
        own = both.join(hot, "u").groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        linked = least(both.join(hot, "u", "left_anti")).unionByName(both.join(F.broadcast(own), "u").select("u", "v", "m"))
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the least neighbour's own edge links the node itself
    return linked.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> tuple[bool, DataFrame | None]:
    """Whether the edges are stars already (no node has two, no centre is linked on), and their hot nodes, if any.

    A star step gives no node more edges to lesser ones than it had, so they hold for the round.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("_n"), F.lit(False).alias("_c")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("_n"), F.lit(True).alias("_c")))
    per = ends.groupBy("node").agg(F.sum("_n").alias("_n"), F.max("_c").alias("_c"), F.count(F.lit(1)).alias("_deg"))
    n, loose, most = per.agg(F.sum("_n"), F.max((F.col("_n") > 1) | (F.col("_c") & (F.col("_n") > 0))), F.max("_deg")).first()
    limit = max(HOT_MINIMUM, 2 * (n or 0) // HOT_SHARE)
    hot = cut(per.where(F.col("_deg") > limit).select(F.col("node").alias("u"))) if loose and most > limit else None
    return not loose, hot


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of an undirected edge list (a, b).

    Rounds are tables, so that few tasks read a small one; each is deleted once the next is written.
    """
    spark = edges.sparkSession

    def written(df: DataFrame) -> tuple[DataFrame, list[str]]:
        with recorded() as paths:
            return keep(df), paths

    current, held = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    done, hot = _settled(current)
    for _ in range(max_rounds):
        if done:
            break
        step, paths = written(_closer(_closer(current, hot, large=True), hot, large=False).distinct())
        release(spark, held)
        current, held = step, paths
        done, hot = _settled(current)
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def identifier_node(name: str):
    """The graph node of one identifier value, null where the row has none."""
    value = norm_key(col(name))
    return F.when(value != "", F.concat(F.lit(name + "\u0001"), value))


def identifier_components(rows: DataFrame, identifiers: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct identifier tuples with their component, and the labels used.

    Returns ``tuples`` (one row per distinct combination of identifiers: the node
    columns, ``_n`` rows, ``_rid``) and ``labels`` (node, component).  Rows with
    no identifier are not in ``tuples``: each stands alone.
    """
    nodes = [identifier_node(i).alias(f"_id{k}") for k, i in enumerate(identifiers)]
    names = [f"_id{k}" for k in range(len(identifiers))]
    tuples = cut(rows.select(*nodes).where(F.coalesce(*names).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")))
    anchor = F.coalesce(*names)
    edges = None
    for name in names[1:]:
        part = tuples.where(F.col(name).isNotNull()).select(anchor.alias("a"), F.col(name).alias("b")).where("a <> b")
        edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        return tuples.withColumn("_rid", anchor), rows.sparkSession.createDataFrame([], "node string, component string")
    labels = connected_components(edges)
    placed = (tuples.withColumn("_anchor", anchor)
              .join(labels.withColumnRenamed("node", "_anchor"), "_anchor", "left")
              .withColumn("_rid", F.coalesce("component", "_anchor")).drop("component", "_anchor"))
    return placed, labels


def assign_components(rows: DataFrame, identifiers: Sequence[str], labels: DataFrame, tuples: DataFrame) -> DataFrame:
    """Rows with ``_rid``: their component, or a name of their own without identifiers.

    The lookup is unique per identifier value.  ``tuples`` already counts the rows
    behind every value, so values holding a fixed share of all rows (at most
    HOT_SHARE of them) are known beforehand and spread over many tasks.
    """
    anchored = rows.withColumn("_anchor", F.coalesce(*[identifier_node(i) for i in identifiers]))
    lookup = labels.withColumnRenamed("node", "_anchor")
    total = tuples.agg(F.coalesce(F.sum("_n"), F.lit(0))).collect()[0][0]
    if total > HOT_MINIMUM:
        weight = tuples.groupBy(F.coalesce(*[f"_id{k}" for k in range(len(identifiers))]).alias("_anchor")).agg(F.sum("_n").alias("_w"))
        hot = weight.where(F.col("_w") > max(HOT_MINIMUM, total // HOT_SHARE)).select("_anchor")
        placed = salted_lookup(anchored, lookup, "_anchor", hot, "_source")
    else:
        placed = anchored.join(lookup, "_anchor", "left")
    own = F.concat(F.lit("row\u0001"), F.col("_source"))
    return placed.withColumn("_rid", F.coalesce("component", "_anchor", own)).drop("component", "_anchor")


def shared_basis(tuples: DataFrame, identifiers: Sequence[str]) -> DataFrame:
    """Per component, the first identifier (contract order) that two of its rows share."""
    parts = None
    for k, name in enumerate(identifiers):
        shared = (tuples.where(F.col(f"_id{k}").isNotNull()).groupBy("_rid", f"_id{k}").agg(F.sum("_n").alias("_c"))
                  .where("_c > 1").select("_rid", F.lit(k).alias("_k"), F.lit(name).alias("basis")))
        parts = shared if parts is None else parts.unionByName(shared)
    return parts.groupBy("_rid").agg(F.min_by("basis", "_k").alias("basis"))

"""A Merkle manifest of a dataset, with a proof for every row by pointer jumping.

Rows are leaves, in order within their source; runs of a fixed number of nodes are hashed upwards
to a subroot for each source, and the subroots likewise to the root.  For proofs every node holds
the siblings on the way to an ancestor; joining the table with itself doubles the distance of that
ancestor and chains the siblings, until all have reached the root: the logarithm of a tree's height
in rounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomfold.lineage import broadcast_if_small, keep

#: The tree over the subroots; source trees are numbered from 0.
TOP = -1
STEPS = "array<struct<left: binary, right: binary>>"


@dataclass(frozen=True)
class TreeRules:
    """``arity``: nodes in a run.  ``lift``: levels that are built from one shuffle, so a group holds ``arity ** lift`` digests.
    ``broadcast_rows``: ancestors (with their siblings, a kilobyte at most in a tree of some billions) that may be broadcast."""
    arity: int = 3
    lift: int = 4
    broadcast_rows: int = 20_000


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (binary) of the values one after another, each as its length in bytes, a colon and itself; null is a hyphen."""
    return F.unhex(F.sha2(F.concat(*map(_framed, values)), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(digests: Column) -> Column:
    """SHA-256 (binary) of an array of digests, each written in lower-case hexadecimal."""
    return F.unhex(F.sha2(F.lower(F.array_join(F.transform(digests, F.hex), "")), 256))


def fold(leaf: Column, steps: Column) -> Column:
    """The digest that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda state, s: F.unhex(F.sha2(F.concat(_hex(s["left"]), _hex(state), _hex(s["right"])), 256)))


def numbered(leaves: DataFrame, source: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their ``_part``, and the table of pieces: a source's run of rows inside a part.

    Rows are dealt by range of (source, order), so a source of any size spreads over parts and no
    rank is counted in one task.  Pieces hold ``_source, _part, _first`` (the run's first ``_at``),
    ``_base`` (rows of the source before it), ``_tree`` (number of the source, null first, in byte
    order) and ``_n`` (rows of the source).
    """
    parts = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in (source, *order)]
    placed = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = keep(placed.withColumn("_part", F.shiftright("_at", 33).cast("int")))
    of_source = Window.partitionBy("_source")
    runs = placed.groupBy(F.col(source).alias("_source"), "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    runs = keep(runs.withColumn("_base", F.sum("_rows").over(of_source.orderBy("_part")) - F.col("_rows")).withColumn("_n", F.sum("_rows").over(of_source)))
    # a source's number: the sources that start in earlier parts (a row a part), then its place among those of its part
    starts = runs.where("_base = 0")
    earlier = (starts.groupBy("_part").agg(F.count("*").alias("_k"))
               .select("_part", (F.sum("_k").over(Window.orderBy("_part")) - F.col("_k")).alias("_before")))
    trees = (starts.join(F.broadcast(earlier), "_part")
             .select(F.col("_source").alias("_named"), (F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_first")) - 1).cast("long").alias("_tree")))
    return placed, keep(runs.join(trees, F.col("_source").eqNullSafe(F.col("_named"))).select("_source", "_part", "_first", "_base", "_tree", "_n"))


def _parents(level: Column, arity: int) -> Column:
    runs = F.ceil(F.size(level) / arity).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1), lambda i: joined_digest(F.slice(level, i * arity + 1, F.lit(arity))))


def _edges_of(level: Column, up: Column, at: int, width: int, last: Column, arity: int) -> Column:
    """A struct for every node of a block's level: its place, that of its parent and its siblings."""
    pick = lambda first, n: F.unhex(F.array_join(F.transform(F.slice(level, first + 1, n), F.hex), ""))

    def row(_: Column, i: Column) -> Column:
        first = F.floor(i / arity).cast("int") * arity
        pos = F.col("block") * width + i
        return F.struct(F.lit(at).alias("level"), pos.alias("pos"), F.when(last, F.lit(TOP).cast("long")).otherwise(F.col("tree")).alias("a_tree"),
                        F.when(last, 0).otherwise(at + 1).alias("a_level"), F.when(last, F.col("tree")).otherwise(F.floor(pos / arity)).alias("a_pos"),
                        F.array(F.struct(pick(first, i - first).alias("left"), pick(i + 1, F.lit(arity - 1) - i + first).alias("right"))).alias("steps"))

    return F.when(up.isNotNull(), F.transform(level, row))


def _edges(blocks: DataFrame, at: int, rules: TreeRules) -> DataFrame:
    """A row for every node below a parent; the root of a source's tree stands in the top tree."""
    last = lambda j: (F.col("tree") != TOP) & (F.col(f"m{j + 1}") == 1)
    found = [_edges_of(F.col(f"l{j}"), F.col(f"l{j + 1}"), at + j, rules.arity ** (rules.lift - j), last(j), rules.arity) for j in range(rules.lift)]
    return blocks.select("tree", F.inline(F.flatten(F.array_compact(F.array(*found)))))


def build(nodes: DataFrame, rules: TreeRules) -> tuple[list[DataFrame], DataFrame, int]:
    """Hash trees upwards from ``tree, pos, digest, n`` (n: leaves of the tree).

    Returns the edges by pieces of levels, the roots (``tree, level, digest``) and the greatest
    height.  A group holds ``arity ** lift`` digests of neighbours, so no tree lands in one task.
    """
    arity, lift = rules.arity, rules.lift
    most = nodes.agg(F.max("n")).first()[0] or 0
    height = _height(most, arity)
    edges, roots, at = [], [nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")], 0
    rest = nodes.where("n > 1").withColumn("m", F.col("n"))
    while at < height:
        width = arity ** lift
        grouped = (rest.groupBy("tree", "n", "m", F.floor(F.col("pos") / width).alias("block"))
                   .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"]).alias("l0")).withColumn("m0", F.col("m")))
        for j in range(lift):
            grouped = (grouped.withColumn(f"l{j + 1}", F.when(F.col(f"l{j}").isNotNull() & (F.col(f"m{j}") > 1), _parents(F.col(f"l{j}"), arity)))
                       .withColumn(f"m{j + 1}", F.ceil(F.col(f"m{j}") / arity)))
        blocks = keep(grouped)
        edges.append(_edges(blocks, at, rules))
        for j in range(1, lift + 1):
            ended = blocks.where(F.col(f"l{j}").isNotNull() & (F.col(f"m{j}") == 1))
            roots.append(ended.select("tree", F.lit(at + j).alias("level"), F.col(f"l{j}")[0].alias("digest")))
        rest = blocks.where(F.col(f"l{lift}").isNotNull() & (F.col(f"m{lift}") > 1)).select("tree", F.col("block").alias("pos"), F.col(f"l{lift}")[0].alias("digest"), "n", F.col(f"m{lift}").alias("m"))
        at += lift
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return edges, found, height


def _height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def jumped(edges: DataFrame, height: int, root_level: int, rules: TreeRules) -> DataFrame:
    """Leaves of source trees (and single rows' subroots) with all siblings up to the root, nearest first.

    Each round joins nodes to the row of the ancestor they have reached and chains both lists.
    Ancestors of a distance thin out with it: once few are left they are broadcast (their number
    is checked), before that a key stands for few nodes, and uneven ones are left to AQE's skew join.
    """
    done = (F.col("a_tree") == TOP) & (F.col("a_level") == root_level)
    table, far = keep(edges), 1
    while far < height:
        ahead = table.where((F.col("tree") == TOP) | (F.col("level") >= far)).select(
            F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("pos").alias("a_pos"), F.struct("a_tree", "a_level", "a_pos", "steps").alias("_next"))
        still = table.where((F.col("tree") == TOP) | (F.col("level") == 0) | (F.col("level") >= 2 * far))
        moved = still.where(~done).join(broadcast_if_small(ahead, rules.broadcast_rows), ["a_tree", "a_level", "a_pos"], "left").select(
            "tree", "level", "pos", F.col("_next.a_tree").alias("a_tree"), F.col("_next.a_level").alias("a_level"), F.col("_next.a_pos").alias("a_pos"),
            F.concat("steps", "_next.steps").alias("steps"))
        table, far = keep(still.where(done).unionByName(moved)), 2 * far
    return table


def manifest(leaves: DataFrame, source: str, order: list[str], digest: str = "leaf", rules: TreeRules = TreeRules()) -> DataFrame:
    """``leaves`` (a stored table with a binary ``digest``) and, for each row, ``subroot``, ``root`` (binary) and ``steps``: the
    siblings left and right of the way to the root, level by level.

    Within a source leaves stand in rising ``order`` (null first; equal ones by digest, repeated
    rows are leaves each).  A source of one row is its own subroot, a single source's subroot is
    the root, and a run of one node is hashed all the same.  An empty table gives an empty one.
    Other columns pass through, whatever their names.
    """
    names = {c: f"_c{i}" for i, c in enumerate(leaves.columns)}
    source, order, digest = names[source], [names[c] for c in order], names[digest]
    leaves = leaves.select(*[leaves[c].alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_row"))
    placed, pieces = numbered(leaves, source, [*order, digest, "_row"])
    here = (F.col("_part") == F.col("_in")) & F.col(source).eqNullSafe(F.col("_source"))
    few = broadcast_if_small(pieces.withColumnRenamed("_part", "_in"), 100_000)   # by part and source: no key is hotter than a part
    heads = keep(placed.join(few, here).withColumn("_pos", F.col("_base") + F.col("_at") - F.col("_first")).select(*names.values(), "_part", "_tree", "_pos", "_n"))
    nodes = heads.select(F.col("_tree").alias("tree"), F.col("_pos").alias("pos"), F.col(digest).alias("digest"), F.col("_n").alias("n"))
    own, roots, height = build(nodes, rules)
    roots = keep(roots)
    over = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(roots.count()).alias("n"))
    top, summit, more = build(over, rules)
    root = summit.first()
    spark, steps = leaves.sparkSession, f"tree long, level int, pos long, a_tree long, a_level int, a_pos long, steps {STEPS}"
    edges = spark.createDataFrame([], steps)
    for piece in (*own, *top):
        edges = edges.unionByName(piece)
    proofs = jumped(edges, height + more, root["level"] if root else 0, rules).where("level = 0").select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), F.col("steps").alias("_steps"))
    subroots = pieces.select("_part", "_tree").join(broadcast_if_small(roots.select(F.col("tree").alias("_tree"), F.col("digest").alias("_subroot")), 100_000), "_tree")
    lone = F.col("_n") == 1
    found = (heads.join(broadcast_if_small(subroots, 100_000), ["_part", "_tree"])
             .withColumn("_t", F.when(lone, F.lit(TOP).cast("long")).otherwise(F.col("_tree"))).withColumn("_p", F.when(lone, F.col("_tree")).otherwise(F.col("_pos")))
             .join(proofs, ["_t", "_p"], "left"))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("_subroot").alias("subroot"), F.lit(bytearray(root["digest"]) if root else None).cast("binary").alias("root"),
                        F.coalesce("_steps", F.array().cast(STEPS)).alias("steps"))


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, source``, the row's ``leaf`` and ``tampered``: the leaf that it has once some texts have lost their line breaks.

    Texts of rows whose id has an even checksum are tampered with; rows without id are not.
    """
    columns = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = docs["text"]
    changed = F.when(even & F.contains(text, F.lit("\n")), leaf_digest(*columns, F.replace(text, F.lit("\n"), F.lit(""))))
    leaf = leaf_digest(*columns, text)
    return docs.select(columns[0], columns[1], leaf.alias("leaf"), changed.alias("changed")).select(
        "doc_id", "source", "leaf", F.coalesce("changed", "leaf").alias("tampered"))

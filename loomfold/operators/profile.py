"""Column profiles from one value-frequency aggregate.

``value_frequency`` is the evidence everything about a column is decided on:
(file, column, value, n, min_pos).  Map-side combine collapses repeated values
before the shuffle, so a value holding a third of a column is one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomfold.functions.formats import TYPE_PATTERNS, TYPE_SHARES, many_digits, pii_kind, shape_shares, type_shapes
from loomfold.functions.text import col, is_null_word, redact_samples, strip_stored
from loomfold.lineage import keep
from loomfold.sources.tables import BARE, source_columns

#: Values shown to a person; nothing is decided on them.
SHOWN_SAMPLES = 5


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def melt(sources: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(file, column, column_pos, value, pos): one row per cell, values trimmed."""
    cells, places = _cells(sources, columns)
    return cells.select(F.inline(F.array(places)), "value", "pos")


def _cells(sources: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None) -> tuple[DataFrame, Column]:
    """(at, value, pos): one row per cell, and what the short text ``at`` stands for: file, column, column_pos."""
    parts, places = [], []
    for file, df in sources.items():
        wanted = source_columns(df) if columns is None else columns.get(file, [])
        if not wanted:
            continue
        index = {name: i for i, name in enumerate(source_columns(df))}
        trimmed = [col(c) if df.schema[c].metadata.get(BARE) else strip_stored(col(c)) for c in wanted]
        long = df.unpivot([F.col("_pos").alias("pos")], [c.alias(str(len(places) + i)) for i, c in enumerate(trimmed)], "at", "value")
        places += [F.struct(F.lit(file).alias("file"), F.lit(name).alias("column"), F.lit(index[name]).alias("column_pos")) for name in wanted]
        parts.append(long.select("at", "value", "pos"))
    return union_all(parts), F.element_at(F.array(*places), F.col("at").cast("int") + 1)


def value_frequency(sources: Mapping[str, DataFrame], columns: Mapping[str, list[str]] | None = None) -> DataFrame:
    """A0: each distinct value of each column, how often and where first."""
    cells, place = _cells(sources, columns)
    counted = cells.groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("min_pos"))
    return counted.select(*[place[c].alias(c) for c in ("file", "column", "column_pos")], "value", "n", "min_pos")


def first_distinct(vf: DataFrame, k: int = SHOWN_SAMPLES) -> DataFrame:
    """The first ``k`` distinct non-blank values of every column, in file order.

    Values are counted by the power of two of their position first, 64 counts a column at most, and
    only those up to the power that holds ``k`` are ranked: no column is sorted.  The rank filter is
    pushed below the shuffle (each task sends at most ``k`` rows per column).
    """
    column, power = Window.partitionBy("file", "column"), F.floor(F.log2(F.greatest(F.coalesce("min_pos", F.lit(0)), F.lit(0)) + 1.0))
    real = vf.where((F.col("value") != "") & ~is_null_word(F.col("value"))).select("file", "column", "value", "min_pos", power.alias("_p"))
    before = F.coalesce(F.sum("n").over(column.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = real.groupBy("file", "column", "_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", before).where(F.col("_before") < k)
    rank = F.row_number().over(column.orderBy("min_pos"))
    top = real.join(F.broadcast(first.select("file", "column", "_p")), ["file", "column", "_p"]).withColumn("_r", rank).where(F.col("_r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("min_pos", "value")))
    return top.groupBy("file", "column").agg(F.transform(ordered, lambda s: s["value"]).alias("raw_samples"))


def _stats(vf: DataFrame) -> DataFrame:
    value, n = F.col("value"), F.col("n")
    real = (value != "") & ~is_null_word(value)
    shares = [F.sum(F.when(real & shape, n).otherwise(0)).alias(f"_{name}") for name, shape in type_shapes(value).items()]
    return vf.groupBy("file", "column", "column_pos").agg(
        F.sum(n).alias("row_count"),
        F.sum(F.when(real, n).otherwise(0)).alias("non_null"),
        F.count(F.when(real, F.lit(1))).alias("cardinality"),
        F.coalesce(F.max(F.when(real, many_digits(value))), F.lit(False)).alias("_long"),
        shape_shares(value, F.when(real, n).otherwise(0), F.sum(F.when(real, n).otherwise(0))).alias("shares"),
        *shares)


def inferred_type():
    """A2: first type whose share of matching values is reached."""
    out = F.lit("string")
    for name, share in reversed(TYPE_SHARES):
        hit = F.col(f"_{name}") / F.col("non_null") >= share
        if name == "phone":
            hit = hit & F.col("_long")
        out = F.when((F.col("non_null") > 0) & hit, F.lit(name)).otherwise(out)
    return out


def profile_columns(sources: Mapping[str, DataFrame], vf: DataFrame | None = None) -> DataFrame:
    """A1-A3: one row per (file, column).  ``samples`` are for display, masked where personal.

    ``shares`` says which part of the filled rows has each shape.  Whether a column is personal,
    holds full names or fits a format is decided on them, so on every value of the column.  The
    frequencies are read twice (counts, samples) and differently pruned, so they are written once
    instead of being scanned and shuffled twice.
    """
    vf = keep(value_frequency(sources)) if vf is None else vf
    joined = _stats(vf).join(first_distinct(vf), ["file", "column"], "left")
    raw = F.coalesce(F.col("raw_samples"), F.array().cast("array<string>"))
    typed = joined.withColumn("inferred_type", inferred_type()).withColumn("pii_kind", pii_kind(F.col("column"), F.col("shares")))
    return typed.select(
        "file", "column", "column_pos", "row_count", "non_null", "cardinality", "inferred_type",
        redact_samples(raw, F.col("pii_kind")).alias("samples"), "shares", F.col("pii_kind").isNotNull().alias("is_pii"), "pii_kind",
        F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(1 - F.col("non_null") / F.col("row_count")).alias("null_rate"))


def profile_columns_approx(sources: Mapping[str, DataFrame], rsd: float = 0.02) -> DataFrame:
    """One pass without a value shuffle: cardinality within ``rsd``, no samples.

    For catalogs of id-like columns, where the exact distinct count is the whole
    cost of profiling.  Counts and types stay exact.
    """
    cells = melt(sources)
    value = F.col("value")
    real = (value != "") & ~is_null_word(value)
    digits = F.length(F.regexp_replace(value, r"(?U)\D", ""))
    stats = cells.groupBy("file", "column", "column_pos").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(F.when(real, F.lit(1))).alias("non_null"),
        F.approx_count_distinct(F.when(real, value), rsd).alias("cardinality"),
        F.coalesce(F.max(F.when(real, digits >= 10)), F.lit(False)).alias("_long"),
        *[F.count(F.when(real & value.rlike(p), F.lit(1))).alias(f"_{name}") for name, p in TYPE_PATTERNS.items()])
    return stats.withColumn("inferred_type", inferred_type()).select(
        "file", "column", "column_pos", "row_count", "non_null", "cardinality", "inferred_type")

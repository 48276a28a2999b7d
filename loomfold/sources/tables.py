"""Reading sources as all-text tables with row provenance.

Every source becomes text columns plus ``_file``, ``_pos`` (0-based row number in
the source) and ``_source`` (``file#line``, counting the header).  Numbering needs
no sort and no shuffle: rows are numbered inside each file split and the split
offsets, one row per split, are added back.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from loomfold.functions.text import col, text_of
from loomfold.lineage import broadcast_if_small

META = ("_file", "_pos", "_source")
BARE = "bare"
_SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
MAX_BROADCAST_SPLITS = 1_000_000


def source_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def _breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line of a CSV holds an odd number of quotes: a value then runs over its end."""
    lines = spark.read.text(path)
    return bool(lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count())


def _reader(spark: SparkSession, path: str, fmt: str, multi_line: bool | None) -> DataFrame:
    if fmt == "csv":
        multi_line = _breaks_in_quotes(spark, path) if multi_line is None else multi_line
        return spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=multi_line,
                              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if fmt == "json":
        return spark.read.json(path, primitivesAsString=True)
    return spark.read.format(fmt).load(path)


def _number_rows(raw: DataFrame, fmt: str) -> DataFrame:
    """Add ``_pos``; must see the scan before any filter."""
    if fmt == "parquet":                       # the reader knows each row's index
        placed = raw.select("*", F.col("_metadata.file_path").alias("_path"),
                            F.col("_metadata.row_index").alias("_at"))
        splits = (raw.groupBy(F.col("_metadata.file_path").alias("_path"))
                  .agg(F.max("_metadata.row_index").alias("_last"))
                  .select("_path", (F.col("_last") + 1).alias("_n")))
        order, keys = ["_path"], ["_path"]
    else:
        placed = raw.select("*", F.col("_metadata.file_path").alias("_path"),
                            F.col("_metadata.file_block_start").alias("_block"),
                            F.monotonically_increasing_id().alias("_at"))
        splits = (placed.groupBy("_path", "_block")
                  .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
        order, keys = ["_path", "_block"], ["_path", "_block"]
    # one row per split of one source: small, but its size is checked anyway
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if fmt != "parquet":
        offsets = offsets.withColumn("_offset", F.col("_offset") - F.col("_first"))
    offsets = broadcast_if_small(offsets.select(*keys, "_offset"), MAX_BROADCAST_SPLITS)
    joined = placed.join(offsets, keys, "left")
    pos = F.when(F.col("_offset").isNull(),
                 F.raise_error(F.lit("the splits of a source changed between two scans"))).otherwise(
        F.col("_at") + F.col("_offset"))
    return joined.withColumn("_pos", pos.cast("long")).drop(*keys, "_at", "_offset")


def as_text(df: DataFrame, file: str) -> DataFrame:
    """Cast every column to text (missing = '') and trim the headers.

    Columns that were numbers or dates are marked as ``BARE``: no value of theirs has blanks around it.
    """
    bare = {f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType))}
    seen: dict[str, str] = {}
    out = []
    for name in source_columns(df):
        header = name.strip()
        if header.lower() in seen:
            raise ValueError(f"{file}: headers {seen[header.lower()]!r} and {header!r} differ only by case or spaces")
        seen[header.lower()] = header
        out.append(text_of(col(name)).alias(header, metadata={BARE: name in bare}))
    return df.select(*out, F.lit(file).alias("_file"), F.col("_pos"),
                     F.concat(F.lit(f"{file}#"), (F.col("_pos") + 2).cast("string")).alias("_source"))


def load_source(spark: SparkSession, path: str, name: str | None = None, fmt: str | None = None,
                multi_line: bool | None = None) -> DataFrame:
    """One source file, or a folder of part files with one layout."""
    file = name or os.path.basename(path.rstrip("/"))
    fmt = fmt or _SUFFIXES.get(os.path.splitext(file)[1].lower())
    if fmt not in set(_SUFFIXES.values()):
        raise ValueError(f"Unsupported file type: {file}")
    return as_text(_number_rows(_reader(spark, path, fmt, multi_line), fmt), file)


def load_sources(spark: SparkSession, paths: Iterable[str], **options) -> dict[str, DataFrame]:
    """All sources of a run, keyed by file name in the order given."""
    out: dict[str, DataFrame] = {}
    for path in paths:
        file = os.path.basename(str(path).rstrip("/"))
        if file in out:
            raise ValueError(f"two sources are named {file!r}; load one under another name")
        out[file] = load_source(spark, str(path), **options)
    return out


def from_table(df: DataFrame, file: str, position: str) -> DataFrame:
    """A table that already numbers its rows (0-based ``position``) as a text source."""
    numbered = df.withColumn("_pos", col(position).cast("long"))
    return as_text(numbered, file)


def file_order(sources: Mapping[str, DataFrame]) -> dict[str, int]:
    return {name: i for i, name in enumerate(sources)}

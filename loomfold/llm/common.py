"""Shared helpers of the corpus operators: words, splits, Arrow mapping."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of characters other than these; ``bytes.split()`` splits on exactly the same ones.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int) -> Column:
    """True for the fold kept from training; a row without an id is never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def as_bytes(df: DataFrame, text: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty."""
    return F.coalesce(df[text].cast("binary"), F.lit(b""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column already (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded_batches(spark: SparkSession, rows: int) -> None:
    """Send Python at most ``rows`` rows at once, from now on in this session: bounds the buffers on both sides.  For applications, not operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and what it kept would add to the next stage's."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):                                     # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_columns(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict]], keep: list[str] = (), rows: int = 1024) -> DataFrame:
    """Kept columns plus those that ``make()(batch)`` returns, batch by batch through Arrow.

    ``make`` runs once per task; rows keep their order and number.  ``rows`` are worked on at once,
    which bounds what a task holds besides Arrow's own batch.
    """
    schema = StructType([df.schema[c] for c in keep] + StructType.fromDDL(ddl).fields)
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, step = to_arrow_schema(schema), None
        for whole in batches:
            step = step or make()
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                columns = {c: batch.column(c) for c in kept} | step(batch)
                yield pa.RecordBatch.from_arrays([_cast(columns[f.name], f.type) for f in arrow], schema=arrow)
        whole = batch = columns = step = None
        give_back()

    return df.mapInArrow(run, schema)


def map_any(df: DataFrame, ddl: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``run`` turns batches into dicts of columns, as many rows as it likes."""
    schema = StructType.fromDDL(ddl)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays([_cast(columns[f.name], f.type) for f in arrow], schema=arrow)
        columns = None
        give_back()

    return df.mapInArrow(work, schema)


def _cast(values, kind):
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def runs_of_bytes(texts: list[bytes], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about ``budget`` bytes (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > budget:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

"""Cutting lineage and looking things up without a hot key landing on one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only local mode may fall back."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise on reliable storage: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Materialise a data-sized result as a table in the checkpoint folder.

    Unlike ``cut`` it is columnar: later steps read only the columns they need, and
    the planner knows its real size.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """A list of the tables that ``keep`` writes meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [p for p in _recorders if p is not paths]


def release(spark: SparkSession, paths: list[str], *wanted: DataFrame) -> None:
    """Delete recorded tables, but for those that ``wanted`` read.

    For a step whose result has been written: what it kept on the way is not needed again, and
    would otherwise stay until the checkpoint folder is cleared.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    read = [f for df in wanted for f in df.inputFiles()]
    for path in paths:
        name = path.rsplit("/", 1)[-1]                                         # unique, however the folder is written
        if not any(f"/{name}/" in f for f in read):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later steps use as they are.

    A filter or projection above them would otherwise be rewritten in terms of their expressions,
    once for every use; a generator of one row stops that.
    """
    wide = df.select("*", F.inline(F.array(F.struct(*[c.alias(f"_once_{n}") for n, c in columns.items()]))))
    kept = [n for n in df.columns if n not in columns]
    return wide.select(*["`" + n.replace("`", "``") + "`" for n in kept], *[F.col(f"`_once_{n}`").alias(n) for n in columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all shuffle partitions of the session, for work that is heavy for its bytes: sizes would merge them into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame, limit: int) -> bool:
    """Whether a side has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """Hint a broadcast only after the size has been checked."""
    return F.broadcast(df) if small(df, limit) else df


def salted_lookup(big: DataFrame, dim: DataFrame, key: str, hot: DataFrame, spread: str, salts: int = 64) -> DataFrame:
    """``big`` left-joined to ``dim`` (unique on ``key``), hot keys spread over ``salts`` tasks.

    The salt is a hash of the ``spread`` column (a row id), so a recomputed task
    sends every row where the first attempt sent it.

    ``hot`` lists the keys known to be heavy in ``big`` (a bounded list: a key is
    only heavy if it holds a fixed share of all rows).  Their ``dim`` rows are
    replicated once per salt; every other key keeps salt 0.
    """
    mark = F.broadcast(hot.select(key).distinct().withColumn("_hot", F.lit(True)))
    left = (big.join(mark, key, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
            .drop("_hot"))
    right = (dim.join(mark, key, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                            .otherwise(F.array(F.lit(0)))))
             .drop("_hot"))
    return left.join(right, [key, "_salt"], "left").drop("_salt")

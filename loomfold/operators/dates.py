"""Date conventions: voted on per column, then applied to every row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.dates import DMY, ISO, MDY, with_readings
from loomfold.spec import DEFAULT_POLICY, Policy


def column_votes(vf: DataFrame) -> DataFrame:
    """A4 over value frequencies: each distinct text is read once and counts ``n`` times."""
    read = with_readings(vf.where(F.col("value") != ""), {"_r": F.col("value")})
    n, r = F.col("n"), F.col("_r")
    votes = read.groupBy("file", "column").agg(
        F.sum(n).alias("total"),
        *[F.sum(F.when(r["implies"] == k, n).otherwise(0)).alias(f"_{k}") for k in (DMY, MDY, ISO)],
        F.sum(F.when(r["ambiguous"], n).otherwise(0)).alias("ambiguous"),
        F.sum(F.when(r["error"].isNotNull(), n).otherwise(0)).alias("unreadable"))
    anchors = F.col(f"_{DMY}") + F.col(f"_{MDY}")
    iso_only = (anchors == 0) & (F.col(f"_{ISO}") > 0) & (F.col("ambiguous") == 0)
    return votes.select(
        "file", "column", "total", anchors.alias("anchors"),
        F.when(anchors > 0, F.greatest(f"_{DMY}", f"_{MDY}") / anchors).when(iso_only, 1.0).otherwise(0.0).alias("agreement"),
        F.when((anchors > 0) & (F.col(f"_{DMY}") >= F.col(f"_{MDY}")), DMY).when(anchors > 0, MDY)
         .when(iso_only, ISO).alias("convention"),
        "ambiguous", "unreadable")


def is_safe(anchors: Column, agreement: Column, policy: Policy = DEFAULT_POLICY) -> Column:
    return (anchors >= policy.date_min_anchors) & (agreement >= policy.date_anchor_agreement)


def decide_conventions(votes: DataFrame, policy: Policy = DEFAULT_POLICY,
                       answers: Mapping[str, str] | None = None) -> DataFrame:
    """A5: how each date column is read and why.

    ``outcome``: confirmed (a person answered), iso, inferred (enough agreeing
    anchors), settled (nothing ambiguous left to decide) or ask.
    """
    given = F.lit(None).cast("string")
    for subject, answer in (answers or {}).items():
        if subject.startswith("date:") and answer in (DMY, MDY):
            given = F.when(F.concat(F.lit("date:"), F.col("file"), F.lit(":"), F.col("column")) == subject, answer).otherwise(given)
    safe = is_safe(F.col("anchors"), F.col("agreement"), policy)
    found = F.col("convention")
    outcome = (F.when(F.col("_given").isNotNull(), "confirmed").when(found == ISO, "iso")
               .when(found.isNotNull() & safe, "inferred").when(F.col("ambiguous") == 0, "settled").otherwise("ask"))
    return (votes.withColumn("_given", given).withColumn("outcome", outcome)
            .withColumn("applied", F.when(F.col("outcome") == "confirmed", F.col("_given"))
                        .when(F.col("outcome") != "ask", found))
            .drop("_given"))

"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formspark.llm.common import materialise

FEW = 10_000


def bounded_sample(rows: DataFrame, label: str, per_label: int, *by: str | Column) -> DataFrame:
    """At most ``per_label`` rows of each non-null label: those of least hash over ``by``.

    A first count sets a hash limit for each label that lets about twice the bound through, so that
    the exact cut sorts a bounded number of rows, whatever the table holds. Limits are broadcast while
    there are at most ``FEW`` labels, so that only rows within them are moved; more labels are joined.
    """
    here = F.xxhash64(*by)
    counts = materialise(rows.where(F.col(label).isNotNull()).groupBy(label).count())
    share = F.least(F.lit(1.0), 2 * per_label / F.col("count") + 20 / F.col("count"))
    limits = counts.select(F.col(label).alias("__label"), (F.lit(-(2.0**63)) + share * 2.0**64).alias("__limit"))
    limits = F.broadcast(limits) if counts.count() <= FEW else limits
    few = rows.withColumn("__hash", here).join(limits, F.col(label) == F.col("__label")).where(F.col("__hash").cast("double") <= F.col("__limit"))
    place = F.row_number().over(Window.partitionBy(label).orderBy("__hash"))
    return few.withColumn("__place", place).where(F.col("__place") <= per_label).drop("__hash", "__label", "__limit", "__place")

"""Order-dependent helpers that never send a whole file or key through one task.

A plain window over ``(file, row order)`` sorts the whole file in one task. These helpers cut the order
into fixed-size chunks, work inside the chunks in parallel, and carry only one summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000


def previous_value(
    df: DataFrame, part: list[str], order: str, value: str, out: str, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """``lag(value)`` over (part, order); ``order`` is a non-negative integer position."""
    base = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inside = W.partitionBy(*part, "_chunk").orderBy(order)
    base = base.withColumn("_lag", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    ends = base.groupBy(*part, "_chunk").agg(F.max_by(F.col(value), F.col(order)).alias("_last"))
    carried = ends.select(
        *part, "_chunk", F.lag("_last").over(W.partitionBy(*part).orderBy("_chunk")).alias("_carry")
    )
    return (
        base.join(carried, [*part, "_chunk"], "left")
        .withColumn(out, F.when(F.col("_n") == 1, F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_chunk", "_lag", "_n", "_carry")
    )


def running_count(
    df: DataFrame, part: list[str], order: str, out: str, weight: Column | None = None, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Inclusive running sum of ``weight`` (default: 1 per row) over (part, order), chunk by chunk."""
    w = F.lit(1) if weight is None else weight
    base = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_w", w)
    inside = W.partitionBy(*part, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    base = base.withColumn("_run", F.sum("_w").over(inside))
    sums = base.groupBy(*part, "_chunk").agg(F.sum("_w").alias("_s"))
    before = W.partitionBy(*part).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*part, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    return (
        base.join(offsets, [*part, "_chunk"])
        .withColumn(out, F.col("_run") + F.col("_off"))
        .drop("_chunk", "_w", "_run", "_off")
    )


def value_changes(df: DataFrame, part: list[str], order: str, value: str, out: str, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose ``value`` differs from that of the row before over (part, order), with that value as ``out``.

    The first row of a part counts as a change. The input is read once: chunks find their inner changes, then only
    changes and the two ends of every chunk are shuffled again, the ends of a part together.
    """
    inside = W.partitionBy(*part, "_chunk").orderBy(order)
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumns({
        "_before": F.lag(value).over(inside),
        "_head": F.row_number().over(inside) == 1,
        "_tail": F.lead(order).over(inside).isNull(),
    })
    rows = rows.filter(F.col("_head") | F.col("_tail") | ~F.col("_before").eqNullSafe(F.col(value)))
    ends = W.partitionBy(*part, F.when(~F.col("_head") & ~F.col("_tail"), F.col("_chunk"))).orderBy(order)
    rows = rows.withColumns({"_end": F.lag(value).over(ends), "_start": F.row_number().over(ends) == 1})
    rows = rows.withColumn(out, F.when(F.col("_head"), F.col("_end")).otherwise(F.col("_before")))
    changed = (F.col("_head") & F.col("_start")) | ~F.col(out).eqNullSafe(F.col(value))
    return rows.filter(changed).drop("_chunk", "_before", "_head", "_tail", "_end", "_start")

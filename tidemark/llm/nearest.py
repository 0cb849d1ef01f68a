"""Nearest record in time for the same entity within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance_s: int, bucket_s: int | None = None) -> DataFrame:
    """Each left row with the nearest right row of its entity at most ``tolerance_s`` seconds away.

    Both tables are united, sorted per entity and time, the last and the next right row are carried onto each left
    row, and the nearer is chosen; of two equally near the earlier. Result: all left columns and a struct
    ``matched`` of the right row's columns, NULL without a match. Right rows at the same time: the one that sorts
    last by all its columns. Left rows with NULL entity or time have no match; right ones take no part. Columns of
    the same name on both sides don't clash, since the right ones stand in the struct.

    An entity may hold a third of all rows, so its time line is cut into buckets: left rows lie in their bucket,
    right rows also in those that begin or end within the tolerance. No match can lie outside.
    """
    if tolerance_s < 0:
        raise ValueError("tolerance must not be negative")
    tol = tolerance_s * 1_000_000
    width = (bucket_s or max(4 * tolerance_s, 86_400)) * 1_000_000
    if width <= 0:
        raise ValueError("bucket must be positive")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    usable = F.col(entity).isNotNull() & F.col(left_time).isNotNull()
    floor_div = lambda c: F.floor(c / F.lit(width)).cast("long")
    ls = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_tm_l"), *[F.when(usable, F.col(entity)).alias("_tm_e"), F.when(usable, micros(left_time)).alias("_tm_t")])
    ls = ls.withColumn("_tm_b", F.coalesce(floor_div(F.col("_tm_t")), F.pmod(F.xxhash64("_tm_l"), F.lit(1024))))
    rs = (
        right.where(F.col(entity).isNotNull() & F.col(right_time).isNotNull())
        .select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_tm_r"), F.col(entity).alias("_tm_e"), micros(right_time).alias("_tm_t"))
        .withColumn("_tm_b", F.explode(F.sequence(floor_div(F.col("_tm_t") - tol), floor_div(F.col("_tm_t") + tol))))
    )
    both = ls.select("_tm_e", "_tm_b", "_tm_t", F.lit(1).alias("_tm_side"), "_tm_l", F.lit(None).cast(rs.schema["_tm_r"].dataType).alias("_tm_r")).unionByName(
        rs.select("_tm_e", "_tm_b", "_tm_t", F.lit(0).alias("_tm_side"), F.lit(None).cast(ls.schema["_tm_l"].dataType).alias("_tm_l"), "_tm_r")
    )
    part = W.partitionBy("_tm_e", "_tm_b")
    carried = F.when(F.col("_tm_side") == 0, F.struct(F.col("_tm_t").alias("t"), F.col("_tm_r").alias("r")))
    # Two running frames: a frame that reaches to the end of the partition would be evaluated anew for every row.
    asc = part.orderBy(F.col("_tm_t"), F.col("_tm_side"), F.col("_tm_r")).rowsBetween(W.unboundedPreceding, 0)
    desc = part.orderBy(F.col("_tm_t").desc(), F.col("_tm_side"), F.col("_tm_r")).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_tm_last", F.last(carried, ignorenulls=True).over(asc)).withColumn("_tm_next", F.last(carried, ignorenulls=True).over(desc))
    rows = seen.where(F.col("_tm_side") == 1)
    back = F.col("_tm_t") - F.col("_tm_last.t")
    ahead = F.col("_tm_next.t") - F.col("_tm_t")
    chosen = F.when((back <= tol) & (ahead.isNull() | (back <= ahead)), F.col("_tm_last.r")).when(ahead <= tol, F.col("_tm_next.r"))
    return rows.select("_tm_l.*", chosen.alias("matched"))

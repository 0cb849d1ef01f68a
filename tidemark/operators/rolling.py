"""Totals over trailing periods by event-contribution deltas.

Each daily amount is added on its day and taken off again ``k`` days later, so the running sum of these deltas is
the trailing total. Totals change only on days that carry a delta; between two such days they are constant, so the
running sum works on (entity, delta day) rows and silent days are filled in afterwards from run lengths, without a
calendar join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_runs(df: DataFrame, entity: str, day: str, amount: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Runs of days with constant trailing totals.

    Result: ``entity``, ``first_day``, ``last_day`` (of the entity), ``run_from``, ``run_to`` and per period k
    ``sum_k`` and ``count_k`` (records in the period). ``df`` has one row per record; NULL and NaN amounts count as 0
    but as a record; rows with a NULL entity or day are dropped; repeated rows each count. An empty table gives none.
    A hot entity costs one row per distinct delta day: amounts are summed per (entity, day) before the shuffle.
    """
    if not periods or min(periods) < 1:
        raise ValueError("periods must be positive")
    value = F.col(amount)
    if dict(df.dtypes)[amount] in ("double", "float"):
        value = F.nanvl(value, F.lit(None))
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .select(F.col(entity).alias("_tm_e"), F.to_date(F.col(day)).alias("_tm_d"), F.coalesce(value, F.lit(0)).alias("_tm_v"))
        .groupBy("_tm_e", "_tm_d")
        .agg(F.sum("_tm_v").alias("_tm_v"), F.count(F.lit(1)).alias("_tm_n"))
    )
    whole = W.partitionBy("_tm_e")
    daily = daily.withColumn("_tm_first", F.min("_tm_d").over(whole)).withColumn("_tm_last", F.max("_tm_d").over(whole))

    def delta(shift: int, parts: dict[int, int]) -> Column:
        fields = [F.date_add("_tm_d", shift).alias("d")]
        for k in periods:
            fields += [(F.col("_tm_v") * parts.get(k, 0)).alias(f"v{k}"), (F.col("_tm_n") * parts.get(k, 0)).alias(f"n{k}")]
        return F.struct(*fields)

    steps = F.array(delta(0, dict.fromkeys(periods, 1)), *[delta(k, {k: -1}) for k in sorted(set(periods))])
    deltas = (
        daily.select("_tm_e", "_tm_first", "_tm_last", F.explode(steps).alias("s"))
        .where(F.col("s.d") <= F.col("_tm_last"))
        .groupBy("_tm_e", F.col("s.d").alias("_tm_d"))
        .agg(F.first("_tm_first").alias("first_day"), F.first("_tm_last").alias("last_day"), *[F.sum(f"s.{x}{k}").alias(f"_tm_{x}{k}") for k in periods for x in "vn"])
    )
    by_day = W.partitionBy("_tm_e").orderBy("_tm_d")
    running = by_day.rowsBetween(W.unboundedPreceding, 0)
    return deltas.select(
        F.col("_tm_e").alias(entity),
        "first_day",
        "last_day",
        F.col("_tm_d").alias("run_from"),
        F.coalesce(F.date_sub(F.lead("_tm_d").over(by_day), 1), F.col("last_day")).alias("run_to"),
        *[F.sum(f"_tm_{x}{k}").over(running).alias(f"{name}_{k}") for k in periods for x, name in (("v", "sum"), ("n", "count"))],
    )


def rolling_totals(df: DataFrame, entity: str, day: str, amount: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day from its first to its last record, silent days included.

    Columns: ``entity``, ``on_day`` (date) and per period k ``sum_k``, ``avg_k`` (sum / k) and ``count_k``. Edge cases
    as in :func:`rolling_runs`.
    """
    runs = rolling_runs(df, entity, day, amount, periods)
    days = runs.withColumn("on_day", F.explode(F.sequence("run_from", "run_to")))
    return days.select(entity, "on_day", *[c for k in periods for c in (F.col(f"sum_{k}"), (F.col(f"sum_{k}") / F.lit(float(k))).alias(f"avg_{k}"), F.col(f"count_{k}"))])


def spikes(df: DataFrame, entity: str, day: str, amount: str, short: int = 7, long: int = 30, factor: int = 3, least: int = 12) -> DataFrame:
    """Days on which the short average stands above ``factor`` times the long one, compared as exact products.

    A day counts from the ``long``-th day of the entity on and needs ``least`` records in the long period. Whole runs
    are kept or dropped first; only the days of kept runs are made. Result: ``entity``, ``on_day``.
    """
    runs = rolling_runs(df, entity, day, amount, (short, long))
    high = F.col(f"sum_{short}") * long > F.col(f"sum_{long}") * (factor * short)
    kept = runs.where(high & (F.col(f"count_{long}") >= least)).withColumn("_tm_from", F.greatest("run_from", F.date_add("first_day", long - 1)))
    return kept.where(F.col("_tm_from") <= F.col("run_to")).select(entity, F.explode(F.sequence("_tm_from", "run_to")).alias("on_day"))

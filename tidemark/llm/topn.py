"""Top N items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Subgroups per group. A group with a third of all rows is ranked by so many tasks.
SUBGROUPS = 32


def top_n(df: DataFrame, groups: list[str], score: str, tie: str, n: int, subgroups: int = SUBGROUPS, rank_column: str = "rank") -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``, equal scores by ``tie`` ascending.

    Rows are hashed by ``tie`` into subgroups; the first ``n`` of each subgroup survive and only survivors (at most
    ``n * subgroups`` a group) are ranked again. NULL and NaN scores never take part; a NULL group value is a group
    of its own; rows equal in score and tie keep an arbitrary but fixed number of places; all columns stay, and
    ``rank_column`` (1..n) is added, replacing one of that name. Empty tables give none.
    """
    if n < 1:
        raise ValueError("n must be positive")
    keys = [F.col(g) for g in groups]
    value = F.col(score)
    df = df.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    if rank_column in df.columns:
        df = df.drop(rank_column)
    order = [value.desc(), F.col(tie).asc()]
    salt = F.pmod(F.xxhash64(F.col(tie)), F.lit(subgroups))
    first = df.withColumn("_tm_salt", salt).withColumn("_tm_rn", F.row_number().over(W.partitionBy(*keys, "_tm_salt").orderBy(*order))).where(F.col("_tm_rn") <= n)
    last = first.withColumn(rank_column, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank_column) <= n)
    return last.drop("_tm_salt", "_tm_rn")

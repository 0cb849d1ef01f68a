"""Canonical forms of the keys of the discussion tables, and each record's current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import TABLES, read_table

BLANKS = " \t\n\r\f\x0b\x85\xa0\u2002\u2003\u2009\u202f\u3000"


def canonical_ticker(c: Column | str) -> Column:
    """Blanks around removed, upper case, a leading ``$`` dropped, ``-`` read as ``.``; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.regexp_replace(F.upper(F.btrim(c, F.lit(BLANKS))), r"^\$", ""), "-", ".")


def folded(c: Column | str) -> Column:
    """Lower case without blanks around; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def community_key(c: Column | str) -> Column:
    """``folded`` without a leading ``r/``."""
    return F.regexp_replace(folded(c), "^r/", "")


def current_rows(df: DataFrame, key: str, recency: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: ``columns`` of the row with the greatest ``recency`` (ties: the greatest values).

    Rows with a NULL key are dropped; a NULL recency counts as oldest.
    """
    packed = F.max(F.struct(F.col(recency).alias("_tm_at"), *[F.col(c) for c in columns])).alias("_tm_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(packed).select(key, *[F.col(f"_tm_row.{c}") for c in columns])


def table(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder: stored tables by their full schema (columns that the files lack are NULL), others by the files'."""
    return read_table(spark, sf_dir, name) if name in TABLES else spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Delimited security listings, alias lists and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_name, is_equity

# Exchange codes that are kept.
OTHER_EXCHANGES = {"N": "NYSE", "A": "NYSE American"}
LISTED = "`Symbol` string, `Security Name` string, `Market Category` string, `Test Issue` string, `Financial Status` string, `Round Lot Size` string, `ETF` string, `NextShares` string"
OTHER = "`ACT Symbol` string, `Security Name` string, `Exchange` string, `CQS Symbol` string, `ETF` string, `Round Lot Size` string, `Test Issue` string, `NASDAQ Symbol` string"
TRAILER = "File Creation Time"


def _piped(spark: SparkSession, path: str, schema: str, symbol: str) -> DataFrame:
    rows = spark.read.schema(schema).option("sep", "|").option("header", True).option("mode", "PERMISSIVE").csv(path)
    return rows.where(F.col(symbol).isNotNull() & ~F.col(symbol).startswith(TRAILER)).withColumn("symbol", F.trim(symbol)).withColumn("name", F.trim("Security Name"))


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, company_name, exchange) of the main listing file: common equity, no test issues, ETFs or NextShares.

    The trailer line and blank lines are skipped, short lines read as NULLs.
    """
    rows = _piped(spark, path, LISTED, "Symbol")
    flags = [F.coalesce(F.col(c), F.lit("N")) != "Y" for c in ("Test Issue", "ETF", "NextShares")]
    kept = rows.where(flags[0] & flags[1] & flags[2] & is_equity(F.col("symbol"), F.coalesce("name", F.lit(""))))
    return kept.select(F.col("symbol").alias("ticker"), clean_name(F.col("name")).alias("company_name"), F.lit("NASDAQ").alias("exchange"))


def read_other_listed(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_listed` for the file of other exchanges; exchanges not in ``OTHER_EXCHANGES`` are dropped."""
    rows = _piped(spark, path, OTHER, "ACT Symbol")
    names = F.create_map(*[F.lit(x) for kv in OTHER_EXCHANGES.items() for x in kv])
    kept = rows.withColumn("exchange", F.try_element_at(names, F.col("Exchange"))).where(
        F.col("exchange").isNotNull() & (F.coalesce("Test Issue", F.lit("N")) != "Y") & (F.coalesce("ETF", F.lit("N")) != "Y") & is_equity(F.col("symbol"), F.coalesce("name", F.lit("")))
    )
    return kept.select(F.col("symbol").alias("ticker"), clean_name(F.col("name")).alias("company_name"), "exchange")


def all_listings(*parts: DataFrame) -> DataFrame:
    """Union of listings; of a ticker that occurs again the first part's row stays (then the first by name)."""
    united = None
    for i, part in enumerate(parts):
        part = part.select("ticker", F.struct(F.lit(i).alias("i"), "company_name", "exchange").alias("r"))
        united = part if united is None else united.unionByName(part)
    return united.groupBy("ticker").agg(F.min("r").alias("r")).select("ticker", "r.company_name", "r.exchange")


def attach_liquidity(listings: DataFrame, dollar_volume: DataFrame, caps: DataFrame, floor: float) -> DataFrame:
    """Listings with avg_dollar_volume, and market caps only for those that reach the floor."""
    liquid = listings.join(dollar_volume.select("ticker", F.col("avg_dollar_volume").alias("avg_dollar_volume_30d")), "ticker", "left")
    wanted = caps.join(liquid.where(F.col("avg_dollar_volume_30d") >= floor).select("ticker"), "ticker", "left_semi")
    return liquid.join(wanted.select("ticker", "market_cap"), "ticker", "left")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, ticker, exact) of a CSV alias,ticker,case_sensitive."""
    rows = spark.read.schema("alias string, ticker string, case_sensitive string").option("header", True).csv(path)
    return rows.where(F.col("alias").isNotNull()).select(F.trim("alias").alias("alias"), F.upper(F.trim("ticker")).alias("ticker"), (F.trim("case_sensitive") == "1").alias("exact"))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word), upper case: white-space separated words, what follows # on a line is a comment."""
    lines = spark.read.text(path).select(F.split_part("value", F.lit("#"), F.lit(1)).alias("v"))
    return lines.select(F.explode(F.split(F.trim("v"), r"\s+")).alias("w")).where(F.col("w") != "").select(F.upper("w").alias("word")).distinct()

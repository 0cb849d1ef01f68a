"""Schemas of the stored tables. Timestamps are UTC without zone; a table read with an explicit schema gets NULL for
columns its files lack, so columns can be added without rewriting old files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES: dict[str, str] = {
    "posts": "id string, source string, community string, author_id string, author_age_days int, author_karma int, created_at timestamp_ntz, collected_at timestamp_ntz, title string, body string, url string, engagement int, content_hash string",
    "post_tickers": "post_id string, ticker string, match_type string, confidence double",
    "post_scores": "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz",
    "prices_daily": "ticker string, date date, open double, high double, low double, close double, volume bigint",
    "ticker_universe": "ticker string, company_name string, exchange string, market_cap double, avg_dollar_volume_30d double, updated_at timestamp_ntz",
    "weekly_signals": "week_start date, ticker string, mentions int, attention_z double, sentiment double, sentiment_prev double, momentum double, breadth double, composite_bull double, composite_bear double, ret_5d double, ret_30d double, rel_volume double, updown_vol_ratio double, insider_buy_flag boolean, early_chatter_flag boolean, events string, red_flag boolean",
    "insider_filings": "accession string, ticker string, filing_date date, purchase_count int, purchase_value double, fetched_at timestamp_ntz",
    "sec_filings": "accession string, ticker string, form string, cik int, filing_date date, accepted_at timestamp_ntz, items string, url string, fetched_at timestamp_ntz",
    "bulk_files": "stamp string, status string, rows int, matched int, checked_at timestamp_ntz",
}
KEYS: dict[str, list[str]] = {
    "posts": ["id"],
    "post_tickers": ["post_id", "ticker"],
    "post_scores": ["post_id", "ticker", "model"],
    "prices_daily": ["ticker", "date"],
    "ticker_universe": ["ticker"],
    "weekly_signals": ["week_start", "ticker"],
    "insider_filings": ["accession"],
    "sec_filings": ["accession"],
    "bulk_files": ["stamp"],
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its full schema; columns missing from the files are NULL."""
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}.parquet")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))

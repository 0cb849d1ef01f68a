"""Registered queries of the keyed writes, each as the state that a table of a real store is left in, and of the read API."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.keys import canonical_ticker, table
from tidemark.operators import market, read_api, signals, sinks
from tidemark.plans import queries as q
from tidemark.schemas import schema
from tidemark.sources import filings

# Parameters of the queries: fixed values.
JUNE, MONDAY, BEFORE = datetime(2025, 6, 1), date(2025, 5, 12), date(2025, 5, 5)


def _store(spark: SparkSession) -> sinks.Store:
    return sinks.Store(spark, scratch.new_path(spark, "store"), buckets=4)


def _at(t: datetime):
    return F.lit(t).cast("timestamp_ntz")


def upsert_posts_state(spark, sf_dir):
    """Rows collected before June are stored, then the later ones."""
    rows, store = table(spark, sf_dir, "posts"), _store(spark)
    store.upsert_posts(rows.where(F.col("collected_at") < _at(JUNE)))
    store.upsert_posts(rows.where(F.col("collected_at") >= _at(JUNE)))
    return store.read("posts").select("id", "engagement", F.unix_micros(F.col("collected_at").cast("timestamp")).alias("collected_us"))


def insert_absent_state(spark, sf_dir):
    """Scores of one model are stored, then those of the others under its name: pairs that have one keep it."""
    rows, store = q.scores_now(spark, sf_dir), _store(spark)
    own = F.col("model") == "lextone"
    store.insert_absent("post_scores", rows.where(own))
    store.insert_absent("post_scores", rows.where(~own).withColumn("model", F.lit("lextone")))
    return store.read("post_scores").select("post_id", "ticker", "label", F.round("score", 9).alias("score"))


def upsert_prices_state(spark, sf_dir):
    """All bars by volume, half of it to be rounded, then those from April on again, the lowest close last."""
    rows, store = table(spark, sf_dir, "prices_daily").withColumn("ticker", canonical_ticker("ticker")), _store(spark)
    store.upsert_prices(rows.withColumn("volume", F.col("volume") / 2), F.col("volume"))
    store.upsert_prices(rows.where(F.col("date") >= F.lit(date(2025, 4, 1))).withColumn("volume", F.lit(None).cast("double")), -F.col("close"))
    return store.read("prices_daily").select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "close", "volume")


def replace_tags_state(spark, sf_dir):
    """Posts of June on are tagged anew with those of their tickers that were sure, as bare; source tags stay."""
    rows, store = q.tickers_now(spark, sf_dir).select("post_id", "ticker", "match_type", "confidence"), _store(spark)
    store.insert_absent("post_tickers", rows)
    touched = q.posts_now(spark, sf_dir).where(F.col("created_at") >= _at(JUNE)).select(F.col("id").alias("post_id"))
    sure = rows.where(F.col("confidence") > 0.7).select("post_id", "ticker", F.lit("bare").alias("match_type"), F.lit(0.5).alias("confidence"))
    store.replace_post_tickers(touched, sure)
    return store.read("post_tickers")


def source_tags_state(spark, sf_dir):
    """Tags and moods of messages, made from the tickers they name and the length of their text."""
    tags = q.tickers_now(spark, sf_dir).groupBy("post_id").agg(F.collect_list("ticker").alias("source_tickers"))
    mood = F.when(F.length("body") % 3 > 0, (F.length("body") % 3 * 2 - 3).cast("int")).alias("source_sentiment")
    posts = q.posts_now(spark, sf_dir).where(F.col("source") == "stocktwits").select("id", "source", mood).join(tags, F.col("post_id") == F.col("id")).drop("post_id")
    known = table(spark, sf_dir, "ticker_universe").where(F.col("exchange") == "NYSE").select(canonical_ticker("ticker").alias("ticker"))
    store = _store(spark)
    store.add_source_tags(posts, 0.9, known, _at(JUNE))
    return store.read("post_tickers").join(store.read("post_scores").select("post_id", "ticker", "model", "label", "score"), ["post_id", "ticker"], "left")


def universe_state(spark, sf_dir):
    """Replaced twice, the second time refused since too few rows have a dollar volume."""
    rows, store = table(spark, sf_dir, "ticker_universe").withColumn("ticker", canonical_ticker("ticker")), _store(spark)
    store.replace_guarded("ticker_universe", rows, "avg_dollar_volume_30d", 0.2)
    try:
        store.replace_guarded("ticker_universe", rows.withColumn("avg_dollar_volume_30d", F.lit(None).cast("double")), "avg_dollar_volume_30d", 0.2)
    except ValueError:
        pass
    return store.read("ticker_universe").select("ticker", "company_name", "exchange", "market_cap", "avg_dollar_volume_30d")


def write_week_state(spark, sf_dir):
    """All weeks stored, one of them then written with half of the tickers of the week before."""
    rows, store = q.signals_now(spark, sf_dir), _store(spark)
    store.replace("weekly_signals", _all_columns(rows))
    store.write_week(MONDAY, rows.where((F.col("week_start") == F.lit(BEFORE)) & (F.col("composite_bull") > 0)).withColumn("events", F.lit("")))
    return store.read("weekly_signals").select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "ticker", "mentions", *q._r("composite_bull", "sentiment"), "events")


def _all_columns(rows: DataFrame) -> DataFrame:
    for f in schema("weekly_signals"):
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows.select(schema("weekly_signals").names)


def filings_state(spark, sf_dir):
    """Amended reports first, then all: those stored already stay as they are."""
    rows, store = q.filings_now(spark, sf_dir).withColumns({"cik": F.lit(None).cast("int"), "fetched_at": _at(JUNE)}), _store(spark)
    store.insert_absent("sec_filings", rows.where(F.col("form") == "8-K/A").withColumn("items", F.lit("first")))
    store.insert_absent("sec_filings", rows)
    return store.read("sec_filings").select("accession", "ticker", "form", "items")


def insider_cache_state(spark, sf_dir):
    """Reports read in two goes; a report that is stored isn't read again."""
    reports = q.filings_now(spark, sf_dir).select("accession", "ticker", "filing_date", F.col("url").alias("path")).where(F.col("path").isNotNull())
    read = lambda times: lambda paths: paths.select("path", (F.length("path") % 3).alias("purchase_count"), (F.length("path") * F.lit(float(times))).alias("purchase_value"))
    store = _store(spark)
    filings.update_insider_cache(store, reports.where(F.col("filing_date") < F.lit(MONDAY)), read(1), JUNE)
    filings.update_insider_cache(store, reports, read(2), JUNE)
    flags = market.purchases_within(store.read("insider_filings"), 30)
    return flags.select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "ticker", "insider_buy_flag")


def ledger_state(spark, sf_dir):
    """A ledger of files by hour of collection: their last status counts, later entries take the place of earlier ones."""
    hour = F.date_format(F.date_trunc("HOUR", "collected_at"), "yyyyMMddHHmmss").alias("stamp")
    rows = table(spark, sf_dir, "posts").select(hour, F.when(F.col("engagement") > 20, "done").otherwise("error").alias("status"), F.lit(1).alias("rows"), F.lit(0).alias("matched"), F.col("collected_at").alias("checked_at"), F.coalesce("engagement", F.lit(-1)).alias("e"))
    store = _store(spark)
    store.upsert("bulk_files", rows.where(F.col("e") % 2 == 0), F.struct("checked_at", "e"))
    store.upsert("bulk_files", rows.where(F.col("e") % 2 != 0), F.struct("checked_at", "e"))
    return store.read("bulk_files").select("stamp", "status")


# -- read API ------------------------------------------------------------------------------------------------------


def _best(spark, sf_dir) -> str:
    """The most mentioned ticker."""
    row = read_api.tracked_tickers(q.tickers_now(spark, sf_dir)).first()
    return row.ticker if row else ""


def available_weeks(spark, sf_dir):
    return read_api.available_weeks(q.signals_now(spark, sf_dir)).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"))


def _ranked(spark, sf_dir, side):
    return read_api.ranked_tables(q.signals_now(spark, sf_dir), table(spark, sf_dir, "ticker_universe").withColumn("ticker", canonical_ticker("ticker")), MONDAY, side, 20)


def ranked_tables(spark, sf_dir):
    numbers = ("attention_z", "sentiment", "momentum", "breadth", "ret_5d", "ret_30d", "rel_volume")
    parts = [_ranked(spark, sf_dir, side).select(F.lit(side).alias("side"), "rank", "ticker", "company_name", F.round(f"composite_{side}", 9).alias("composite"), "mentions", *q._r(*numbers), "events", "red_flag") for side in ("bull", "bear")]
    return parts[0].unionByName(parts[1])


def red_flag_panel(spark, sf_dir):
    """Of all weeks."""
    lists = [signals.ranked_list(q.signals_now(spark, sf_dir), side, 20, ["week_start"]) for side in ("bull", "bear")]
    return read_api.red_flag_panel(*lists, ["week_start"]).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "ticker", "events")


def eligible_count(spark, sf_dir):
    return read_api.eligible_count(q.signals_now(spark, sf_dir), MONDAY)


def company_name(spark, sf_dir):
    return read_api.company_name(table(spark, sf_dir, "ticker_universe").withColumn("ticker", canonical_ticker("ticker")), _best(spark, sf_dir))


def weekly_history(spark, sf_dir):
    return read_api.weekly_history(q.signals_now(spark, sf_dir), _best(spark, sf_dir)).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "mentions", *q._r("attention_z", "sentiment", "momentum", "composite_bull", "composite_bear"))


def week_tape(spark, sf_dir):
    return read_api.week_tape(q.signals_now(spark, sf_dir), MONDAY).select("ticker", *q._r("sentiment", "momentum"), "mentions")


def ticker_summary(spark, sf_dir):
    rows = read_api.ticker_summary(q._week(spark, sf_dir), q.signals_now(spark, sf_dir), MONDAY)
    return rows.select("ticker", "mentions", "posts", "authors", "pos", "neg", "neu", q._mean(), *q._r("ranked_sentiment", "momentum", "ret_5d", "ret_30d", "rel_volume", "updown_vol_ratio"), "early_chatter_flag", "insider_buy_flag", "events", "red_flag")


def top_post_kinds(spark, sf_dir):
    """The most engaged posts of the most mentioned ticker with how they matched and what the ranking makes of news."""
    rows = read_api.with_news_kind(read_api.top_posts(q._week(spark, sf_dir), _best(spark, sf_dir), 25))
    return rows.select("post_id", "match_type", "kind_label")


def daily_prices(spark, sf_dir):
    rows = read_api.daily_prices(q.bars_now(spark, sf_dir), _best(spark, sf_dir), date(2025, 5, 17), 90)
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "close", "volume")


QUERIES = {
    f.__name__: f
    for f in (
        upsert_posts_state, insert_absent_state, upsert_prices_state, replace_tags_state, source_tags_state, universe_state, write_week_state, filings_state, insider_cache_state, ledger_state,
        available_weeks, ranked_tables, red_flag_panel, eligible_count, company_name, weekly_history, week_tape, ticker_summary, top_post_kinds, daily_prices,
    )
}

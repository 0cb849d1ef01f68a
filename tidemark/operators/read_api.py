"""The read queries behind a dashboard, each a DataFrame over the stored tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import Week
from tidemark.operators.signals import distinct_counts, effective_scores


def _stamp(t: datetime):
    return F.lit(t).cast("timestamp_ntz")


def available_weeks(signals: DataFrame) -> DataFrame:
    return signals.select("week_start").distinct().orderBy(F.col("week_start").desc())


def week_for(monday: date) -> Week:
    return Week.ending(monday + timedelta(days=4))


def ranked_tables(signals: DataFrame, universe: DataFrame, monday: date, side: str, n: int) -> DataFrame:
    """The week's heating-up list with company names: rank, ticker, company_name, composite and its parts."""
    from tidemark.operators.signals import ranked_list

    week = signals.where(F.col("week_start") == F.lit(monday))
    names = universe.groupBy("ticker").agg(F.max("company_name").alias("company_name"))
    listed = ranked_list(week, side, n).join(names, "ticker", "left")
    return listed.select("rank", "ticker", "company_name", f"composite_{side}", "mentions", "attention_z", "sentiment", "momentum", "breadth", "ret_5d", "ret_30d", "rel_volume", "events", "red_flag").orderBy("rank")


def eligible_count(signals: DataFrame, monday: date) -> DataFrame:
    return signals.where(F.col("week_start") == F.lit(monday)).agg(F.count(F.lit(1)).alias("n"))


def tracked_tickers(tickers: DataFrame) -> DataFrame:
    """Tickers by number of mentions."""
    return tickers.groupBy("ticker").agg(F.count(F.lit(1)).alias("mentions")).orderBy(F.col("mentions").desc(), "ticker")


def most_mentioned(posts: DataFrame, tickers: DataFrame, since: datetime, n: int) -> DataFrame:
    recent = posts.where(F.col("created_at") >= _stamp(since)).select(F.col("id").alias("post_id"))
    return tracked_tickers(tickers.join(recent, "post_id", "left_semi")).limit(n)


def ticker_list(mentioned: DataFrame, universe: DataFrame, n: int) -> DataFrame:
    """Most mentioned tickers first, topped up with the most liquid others: (ticker, place), 1..n."""
    first = mentioned.select("ticker", F.lit(0).alias("part"), (-F.col("mentions")).cast("double").alias("key"))
    more = universe.where(F.col("avg_dollar_volume_30d").isNotNull()).select("ticker", F.lit(1).alias("part"), (-F.col("avg_dollar_volume_30d")).alias("key"))
    best = first.unionByName(more).groupBy("ticker").agg(F.min(F.struct("part", "key")).alias("k"))
    order = [F.col("k.part"), F.col("k.key"), F.col("ticker")]
    top = best.orderBy(*order).limit(n)
    return top.select("ticker", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))


def company_name(universe: DataFrame, ticker: str) -> DataFrame:
    return universe.where(F.col("ticker") == ticker).agg(F.max("company_name").alias("company_name"))


def daily_trend(posts: DataFrame, tickers: DataFrame, scores: DataFrame, bars: DataFrame, ticker: str, first: date, last: date, models: list[str]) -> DataFrame:
    """(on_day, mentions, avg_score, close) of every day from ``first`` to ``last``, days without mentions or bars included."""
    span = (F.to_date("created_at") >= F.lit(first)) & (F.to_date("created_at") <= F.lit(last))
    own = tickers.where(F.col("ticker") == ticker).select("post_id", "ticker").distinct()
    rows = posts.where(span).select(F.col("id").alias("post_id"), F.to_date("created_at").alias("on_day")).join(own, "post_id").join(effective_scores(scores.where(F.col("ticker") == ticker), models), ["post_id", "ticker"], "left")
    daily = rows.groupBy("on_day").agg(F.count(F.lit(1)).alias("mentions"), F.avg("score").alias("avg_score"))
    closes = bars.where(F.col("ticker") == ticker).groupBy(F.col("date").alias("on_day")).agg(F.max("close").alias("close"))
    days = posts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("on_day"))
    return days.join(daily, "on_day", "left").join(closes, "on_day", "left").select("on_day", F.coalesce("mentions", F.lit(0)).alias("mentions"), "avg_score", "close").orderBy("on_day")


def weekly_history(signals: DataFrame, ticker: str) -> DataFrame:
    return signals.where(F.col("ticker") == ticker).select("week_start", "mentions", "attention_z", "sentiment", "momentum", "composite_bull", "composite_bear").orderBy("week_start")


def week_mentions(posts: DataFrame, tickers: DataFrame, scores: DataFrame, week: Week, models: list[str]) -> DataFrame:
    """The week's posts with tickers and effective scores."""
    inside = posts.where((F.col("created_at") >= _stamp(week.start)) & (F.col("created_at") < _stamp(week.end))).withColumnRenamed("id", "post_id")
    return inside.join(tickers.groupBy("post_id", "ticker").agg(F.min("match_type").alias("match_type")), "post_id").join(effective_scores(scores, models), ["post_id", "ticker"], "left")


def top_posts(mentions: DataFrame, ticker: str, n: int) -> DataFrame:
    """Most engaged posts of a ticker, of reposts (same content hash) only the earliest."""
    own = mentions.where(F.col("ticker") == ticker)
    first = own.groupBy(F.coalesce("content_hash", "post_id").alias("k")).agg(F.min(F.struct("created_at", "post_id", "source", "community", F.coalesce("title", "body").alias("title"), "url", "engagement", "label", "score", "match_type")).alias("r"))
    return first.select("r.*").orderBy(F.col("engagement").desc_nulls_last(), F.col("created_at").desc(), "post_id").limit(n)


# What is said of news of a kind.
KIND_LABELS = {"price_recap": "PRICE RECAP · EXCLUDED", "promo": "PROMO / OPINION · DOWN-WEIGHTED", "press_release": "PRESS RELEASE · DOWN-WEIGHTED"}


def with_news_kind(top: DataFrame) -> DataFrame:
    """Add ``kind_label`` to rows of :func:`top_posts`: what the ranking makes of a news item, judged by the title shown."""
    from tidemark.operators.noise import headline_kind

    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv]), headline_kind(F.col("title"), F.col("community")))
    return top.withColumn("kind_label", F.when(F.col("source") == "news", label))


def red_flag_panel(bull: DataFrame, bear: DataFrame, by: list[str] = []) -> DataFrame:
    """Tickers of either list (within ``by``) with a red flag, once, the bullish list first."""
    both = bull.withColumn("_tm_side", F.lit(0)).unionByName(bear.withColumn("_tm_side", F.lit(1)), allowMissingColumns=True).where(F.coalesce("red_flag", F.lit(False)))
    first = both.groupBy(*by, "ticker").agg(F.min(F.struct("_tm_side", "rank", "events")).alias("r"))
    return first.orderBy(*by, "r._tm_side", "r.rank").select(*by, "ticker", F.col("r.events").alias("events"))


def week_tape(signals: DataFrame, monday: date) -> DataFrame:
    """Every ranked ticker of a week, most mentioned first."""
    return signals.where(F.col("week_start") == F.lit(monday)).select("ticker", "sentiment", "momentum", "mentions").orderBy(F.col("mentions").desc_nulls_last(), "ticker")


def week_summary(mentions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mentions, distinct posts and authors, labels and mean score, in all or by columns."""
    by = by or []
    label = lambda x: F.count_if(F.col("label") == x).alias(x)
    tally = mentions.groupBy(*by).agg(F.count(F.lit(1)).alias("mentions"), label("pos"), label("neg"), label("neu"), F.avg("score").alias("avg_score"))
    seen = distinct_counts(mentions, by, posts=F.col("post_id"), authors=F.col("author_id"))
    if by:
        return tally.join(seen, by, "left").na.fill(0, ["posts", "authors"])
    # Two rows of one row each.
    return tally.withColumn("_tm_one", F.lit(1)).join(seen.withColumn("_tm_one", F.lit(1)), "_tm_one").drop("_tm_one")


#: Columns of the ranked week that a week's summary shows, and the name of its sentiment there.
SUMMARY = ["momentum", "ret_5d", "ret_30d", "rel_volume", "updown_vol_ratio", "early_chatter_flag", "insider_buy_flag", "events", "red_flag"]


def ticker_summary(mentions: DataFrame, signals: DataFrame, monday: date) -> DataFrame:
    """:func:`week_summary` of every ticker of a week with what it was ranked by: ``ranked_sentiment`` and context, NULL for
    tickers that weren't ranked that week."""
    ranked = signals.where(F.col("week_start") == F.lit(monday)).select("ticker", F.col("sentiment").alias("ranked_sentiment"), *SUMMARY)
    return week_summary(mentions, ["ticker"]).join(ranked, "ticker", "left")


def community_breakdown(mentions: DataFrame) -> DataFrame:
    out = mentions.groupBy("source", "community").agg(F.count(F.lit(1)).alias("posts"), F.avg("score").alias("avg_score"))
    return out.orderBy(F.col("posts").desc(), "source", F.col("community").asc_nulls_last())


def shares(df: DataFrame, count: str, by: list[str]) -> DataFrame:
    """Add ``share_pct``: the count as a percentage of its group's total."""
    return df.withColumn("share_pct", F.round(100 * F.col(count) / F.sum(count).over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))), 1))


def daily_prices(bars: DataFrame, ticker: str, end: date, days: int) -> DataFrame:
    """Sessions of the ``days`` days before ``end``, which isn't included."""
    inside = (F.col("date") >= F.lit(end - timedelta(days=days))) & (F.col("date") < F.lit(end))
    return bars.where((F.col("ticker") == ticker) & inside).select("date", "close", "volume").orderBy("date")


def week_filings(filings: DataFrame, week: Week, forms: list[str]) -> DataFrame:
    """The week's filings with item names, newest first."""
    from tidemark.functions.text import describe_items
    from tidemark.operators.market import filings_known_in

    rows = filings_known_in(filings, forms, _stamp(week.start), _stamp(week.end))
    return rows.select("accession", "ticker", "form", "filing_date", "accepted_at", F.array_join(describe_items(F.col("items")), ", ").alias("items"), "url").orderBy(F.col("accepted_at").desc_nulls_last(), F.col("filing_date").desc(), "accession")

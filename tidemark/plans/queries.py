"""Registered queries of the core and their DuckDB SQL, both over the whole tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.calendar import Week, friday_of, quarter_hours, week_start_of
from tidemark.functions.extract import cashtags, extract_tickers
from tidemark.functions.keys import canonical_ticker, current_rows, table
from tidemark.functions.text import author_hash, clean_name, content_hash, describe_items, headline_key, name_keys, org_key, simple_sentences
from tidemark.operators import evaluate, market, noise, ranking, read_api, scoring, signals
from tidemark.operators.rolling import rolling_totals, spikes

# Parameters of the registered queries: fixed values.
WEEK = Week.ending(date(2025, 5, 16))
ALWAYS = datetime(1, 1, 1), datetime(9999, 1, 1)
FORMS = ["8-K", "8-K/A"]
MODELS = ["secondpass", "lextone"]
WEIGHTS = {"attention": 0.35, "sentiment": 0.35, "momentum": 0.15, "breadth": 0.15}
POSTS = ["source", "community", "author_id", "author_age_days", "author_karma", "created_at", "collected_at", "title", "body", "url", "engagement", "content_hash"]
SOCIAL = ["reddit", "stocktwits"]
AUTHOR_RULES = {
    "reddit": {"min_age_days": 30, "new_account_weight": 0.25, "min_karma": 100, "low_karma_weight": 0.5},
    "stocktwits": {"min_age_days": 30, "new_account_weight": 0.25, "min_karma": 5, "low_karma_weight": 0.5},
}
BOTS = {"sources": SOCIAL, "max_posts": 40, "weight": 0.1}
NEWS = {"sources": ["news"], "kind_weights": {"price_recap": 0.0, "promo": 0.3, "press_release": 0.5, "news": 1.0}, "off_topic_weight": 0.3}
FLOORS, SOURCE_WEIGHTS, AUTHOR_CAP = {"news": 10.0}, {"reddit": 1.0, "news": 1.0, "stocktwits": 1.0}, 5


# -- tables in clean form ------------------------------------------------------------------------------------------


def posts_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current rows of posts."""
    return current_rows(table(spark, sf_dir, "posts"), "id", "collected_at", POSTS)


def tickers_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per post and canonical ticker, with its highest confidence."""
    rows = table(spark, sf_dir, "post_tickers").select("post_id", canonical_ticker("ticker").alias("ticker"), "match_type", "confidence")
    best = rows.groupBy("post_id", "ticker").agg(F.max(F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), "match_type")).alias("m"))
    return best.select("post_id", "ticker", "m.match_type", F.when(F.col("m.c") >= 0, F.col("m.c")).alias("confidence"))


def scores_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "post_scores").select("post_id", canonical_ticker("ticker").alias("ticker"), "model", "label", "score", "scored_at")


def bars_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One usable bar per canonical ticker and date: of several the one with the highest close, then volume."""
    rows = table(spark, sf_dir, "prices_daily").where(F.col("close").isNotNull() & ~F.isnan("close") & (F.col("close") > 0))
    best = rows.select(canonical_ticker("ticker").alias("ticker"), "date", "close", "volume").groupBy("ticker", "date").agg(F.max(F.struct("close", F.coalesce("volume", F.lit(-1)).alias("volume"))).alias("b"))
    return best.select("ticker", "date", "b.close", F.when(F.col("b.volume") >= 0, F.col("b.volume")).alias("volume"))


def signals_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per Monday and canonical ticker: of several the one with most mentions, then the highest composites."""
    rows = table(spark, sf_dir, "weekly_signals").withColumn("week_start", F.date_sub(F.next_day("week_start", "MON"), 7)).withColumn("ticker", canonical_ticker("ticker"))
    numbers = ["attention_z", "sentiment", "momentum", "breadth", "composite_bull", "composite_bear", "rel_volume", "ret_5d", "ret_30d", "updown_vol_ratio"]
    marks = ["early_chatter_flag", "insider_buy_flag", "events", "red_flag"]
    rows = rows.select("week_start", "ticker", "mentions", *[F.nanvl(c, F.lit(None)).alias(c) for c in numbers], *marks)
    best = rows.groupBy("week_start", "ticker").agg(F.max(F.struct("mentions", "composite_bull", "composite_bear", *[c for c in numbers if not c.startswith("composite")], *marks)).alias("r"))
    return best.select("week_start", "ticker", "r.*")


def filings_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sec_filings")
    best = rows.groupBy("accession").agg(F.max(F.struct("fetched_at", "accepted_at", canonical_ticker("ticker").alias("ticker"), "form", "filing_date", "items", "url")).alias("r"))
    return best.select("accession", "r.ticker", "r.form", "r.filing_date", "r.accepted_at", "r.items", "r.url")


def mentions_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions with scores."""
    return signals.load_mentions(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), MODELS, *ALWAYS, 0.5)


def mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions, each in every week whose window it lies in, with the plain weight log(1 + engagement)."""
    weight = F.log1p(F.greatest(F.coalesce(F.col("engagement"), F.lit(0)), F.lit(0)).cast("double"))
    rows = mentions_now(spark, sf_dir).drop("title", "body", "url")
    return signals.spread_over_weeks(rows, 30).withColumn("weight", weight)


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, keys): the forms of the companies' names."""
    names = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"), name_keys(F.col("company_name"), F.array().cast("array<string>")).alias("k"))
    return names.groupBy("ticker").agg(F.array_distinct(F.flatten(F.collect_list("k"))).alias("keys"))


def filtered_mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mentions after all noise filters, with post weights and the author cap. SimHash by md5, which SQL has too."""
    rows = scratch.materialize(mentions_now(spark, sf_dir).drop("url", "collected_at", "label"), "mentions")
    return noise.filtered_mentions(rows, name_forms(spark, sf_dir), AUTHOR_RULES, BOTS, NEWS, FLOORS, SOURCE_WEIGHTS, AUTHOR_CAP, SOCIAL, algorithm="md5", spread=signals.spread_over_weeks, by=["week_start"], consume=True)


def _mean():
    """Means of a few scores of six digits meet ties at nine digits, which sums in another order break; at twelve they don't."""
    return F.round("avg_score", 12).alias("avg_score")


def _r(*names: str):
    return [F.round(c, 9).alias(c) for c in names]


# -- rolling totals ------------------------------------------------------------------------------------------------


def mention_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (post, ticker) with the post's day and its current engagement, NULL and negative as 0."""
    pairs = table(spark, sf_dir, "post_tickers").select("post_id", canonical_ticker("ticker").alias("ticker")).distinct()
    posts = current_rows(table(spark, sf_dir, "posts"), "id", "collected_at", ["created_at", "engagement"])
    amount = F.greatest(F.coalesce(F.col("engagement"), F.lit(0)), F.lit(0)).cast("long")
    return pairs.join(posts.select(F.col("id").alias("post_id"), F.to_date("created_at").alias("made_on"), amount.alias("amount")), "post_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes(mention_amounts(spark, sf_dir), "ticker", "made_on", "amount").select("ticker", F.date_format("on_day", "yyyy-MM-dd").alias("on_day"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rolling_totals(mention_amounts(spark, sf_dir), "ticker", "made_on", "amount")
    return rows.select("ticker", F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), "sum_7", F.round("avg_7", 9).alias("avg_7"), "count_7", "sum_30", F.round("avg_30", 9).alias("avg_30"), "count_30")


# -- signals -------------------------------------------------------------------------------------------------------


def mentions_effective_scores(spark, sf_dir):
    return mentions_now(spark, sf_dir).select("post_id", "ticker", "label", *_r("score"))


def _week_of():
    return F.date_format("week_start", "yyyy-MM-dd").alias("week")


def _components(rows):
    return signals.weekly_components(rows, by=["week_start"]).select(_week_of(), "ticker", "mentions", "n_authors", *_r("attention_z", "sentiment", "sentiment_prev", "momentum", "breadth"))


def attention_z(spark, sf_dir):
    return signals.attention(mention_rows(spark, sf_dir), 7, 30, 1.0, 10.0, ["week_start"]).select(_week_of(), "ticker", *_r("attention_z"))


def weekly_components(spark, sf_dir):
    return _components(mention_rows(spark, sf_dir))


def composite_scores(spark, sf_dir):
    found = signals.weekly_components(mention_rows(spark, sf_dir), by=["week_start"])
    return signals.composites(found, ["week_start"], WEIGHTS).select(_week_of(), "ticker", *_r("composite_bull", "composite_bear"))


def filtered_mentions(spark, sf_dir):
    """What is left of each week's mentions after all noise filters, and its weight."""
    return filtered_mention_rows(spark, sf_dir).select(_week_of(), "post_id", "ticker", *_r("weight"))


def filtered_components(spark, sf_dir):
    return _components(scratch.materialize(filtered_mention_rows(spark, sf_dir), "filtered"))


def weekly_ranking(spark, sf_dir):
    """All weeks ranked: filters, components, composites, context, flags and events, as they are stored."""
    rows = scratch.materialize(filtered_mention_rows(spark, sf_dir), "filtered")
    out = ranking.rank_weeks(rows, WEIGHTS, bars_now(spark, sf_dir), None, filings_now(spark, sf_dir), FORMS)
    numbers = _r("attention_z", "sentiment", "momentum", "breadth", "composite_bull", "composite_bear", "ret_5d", "ret_30d", "rel_volume", "updown_vol_ratio")
    return out.select(_week_of(), "ticker", "mentions", *numbers, "insider_buy_flag", "early_chatter_flag", "events", "red_flag")


def heating_up(spark, sf_dir):
    both = None
    for side in ("bull", "bear"):
        part = signals.ranked_list(signals_now(spark, sf_dir), side, 20, ["week_start"]).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), F.lit(side).alias("side"), "rank", "ticker")
        both = part if both is None else both.unionByName(part)
    return both


# -- noise ---------------------------------------------------------------------------------------------------------


def _mentions(spark, sf_dir):
    return posts_now(spark, sf_dir).withColumnRenamed("id", "post_id").join(tickers_now(spark, sf_dir).select("post_id", "ticker"), "post_id").withColumn("block", F.datediff(F.lit(WEEK.friday), friday_of(F.col("created_at"))) / 7)


def drop_reposts(spark, sf_dir):
    return noise.drop_reposts(_mentions(spark, sf_dir)).select("post_id", "ticker")


def drop_syndicated(spark, sf_dir):
    return noise.drop_syndicated(_mentions(spark, sf_dir), ["news"]).select("post_id", "ticker")


def drop_spam(spark, sf_dir):
    return noise.drop_spam(posts_now(spark, sf_dir)).select("id")


def headline_kinds(spark, sf_dir):
    return posts_now(spark, sf_dir).where(F.col("title").isNotNull()).select("id", noise.headline_kind(F.col("title"), F.col("community")).alias("kind"))


def author_weights(spark, sf_dir):
    return noise.author_weights(_mentions(spark, sf_dir), AUTHOR_RULES, BOTS).select("post_id", "ticker", *_r("author_weight"))


def cap_per_author(spark, sf_dir):
    rows = _mentions(spark, sf_dir).withColumn("weight", F.coalesce(F.col("engagement"), F.lit(0)).cast("double"))
    return noise.cap_per_author(rows, 5, "block", SOCIAL).select("post_id", "ticker")


def post_weights(spark, sf_dir):
    w = noise.post_weight(F.col("engagement"), F.col("source"), F.lit(1.0), F.lit(1.0), {"news": 10.0}, {"reddit": 1.0, "news": 0.5})
    return posts_now(spark, sf_dir).select("id", F.round(w, 9).alias("weight"))


def near_duplicate_posts(spark, sf_dir):
    posts = posts_now(spark, sf_dir).select(F.col("id").alias("post_id"), "created_at", "title", "body")
    return noise.near_duplicate_posts(posts, algorithm="md5")


# -- text ----------------------------------------------------------------------------------------------------------


def content_hashes(spark, sf_dir):
    return posts_now(spark, sf_dir).select("id", content_hash(F.col("title"), F.col("body")).alias("content"), author_hash(F.col("author_id")).alias("author"))


def headline_keys(spark, sf_dir):
    return posts_now(spark, sf_dir).where(F.col("title").isNotNull()).select("id", headline_key(F.col("title"), unicode=False).alias("headline"))


def company_names(spark, sf_dir):
    rows = table(spark, sf_dir, "ticker_universe")
    return rows.select("ticker", clean_name(F.col("company_name")).alias("name"), org_key(F.col("company_name")).alias("org"), F.array_join(name_keys(F.col("company_name"), F.array().cast("array<string>")), "|").alias("keys"))


def post_sentences(spark, sf_dir):
    return posts_now(spark, sf_dir).where(F.col("body").isNotNull()).select("id", F.size(simple_sentences(F.col("body"))).alias("n"))


def post_cashtags(spark, sf_dir):
    return posts_now(spark, sf_dir).select("id", F.array_join(F.array_sort(cashtags(F.col("title"), F.col("body"))), ",").alias("symbols")).where(F.col("symbols") != "")


def extracted_tickers(spark, sf_dir):
    """Every post against the whole universe, with the companies' names, less the words that say what kind of company, as aliases."""
    universe = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"), "company_name")
    aliases = universe.select(F.get(name_keys(F.col("company_name"), F.array().cast("array<string>")), F.lit(0)).alias("alias"), "ticker", F.lit(False).alias("exact"))
    blocked = spark.createDataFrame([("ALL",), ("NOW",), ("FOR",)], "word string")
    return extract_tickers(posts_now(spark, sf_dir), universe, aliases, blocked).select("post_id", "ticker", "match_type", "confidence")


# -- filings and market --------------------------------------------------------------------------------------------


def filing_items(spark, sf_dir):
    return filings_now(spark, sf_dir).select("accession", F.array_join(describe_items(F.col("items")), "; ").alias("described"))


def filing_events(spark, sf_dir):
    rows = filings_now(spark, sf_dir).withColumn("week", week_start_of(F.coalesce("accepted_at", F.col("filing_date").cast("timestamp_ntz"))))
    out = market.event_labels(rows, ["ticker", "week"])
    return out.select("ticker", F.date_format("week", "yyyy-MM-dd").alias("week"), "events", "red_flag")


def session_context(spark, sf_dir):
    """Of every week that bars reach."""
    return market.weekly_context(bars_now(spark, sf_dir)).select(_week_of(), "ticker", *_r("ret_5d", "ret_30d", "rel_volume", "updown_vol_ratio"))


def dollar_volume(spark, sf_dir):
    return market.mean_dollar_volume(bars_now(spark, sf_dir)).select("ticker", F.round("avg_dollar_volume", 2).alias("avg_dollar_volume"))


def early_chatter(spark, sf_dir):
    rows = market.early_chatter(signals_now(spark, sf_dir).drop("early_chatter_flag"), ["week_start"])
    flag = market.divergence(F.col("rel_volume"), F.col("ret_5d"), F.col("sentiment"))
    return rows.select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "ticker", "early_chatter_flag", flag.alias("divergence"))


def _panel(spark, sf_dir):
    return market.return_panel(signals_now(spark, sf_dir), bars_now(spark, sf_dir))


def return_panel(spark, sf_dir):
    return _panel(spark, sf_dir).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "ticker", *_r("ret_prior", "ret_same", "ret_next"))


# -- evaluation ----------------------------------------------------------------------------------------------------


def lead_lag(spark, sf_dir):
    return evaluate.lead_lag(_panel(spark, sf_dir)).select("signal", "horizon", "weeks", *_r("mean_ic", "t_stat", "share_positive"))


def quintile_spread(spark, sf_dir):
    rows = evaluate.cumulative(evaluate.quintile_spread(_panel(spark, sf_dir), "composite_bull"), "week_start", "spread")
    return rows.select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), *_r("spread", "cumulative"))


def hit_rate(spark, sf_dir):
    return evaluate.hit_rate(_panel(spark, sf_dir), "composite_bull", 10, "bull", F.col("sentiment") > 0).select("picks", "hits", "weeks", *_r("hit_rate"))


def added_signal(spark, sf_dir):
    return evaluate.added_signal(_panel(spark, sf_dir)).select(*_r("mean_ic_base", "mean_ic_with"), "improves")


def verdicts(spark, sf_dir):
    return evaluate.verdict(evaluate.lead_lag(_panel(spark, sf_dir)))


def backtest(spark, sf_dir):
    return ranking.analyse(scratch.materialize(_panel(spark, sf_dir), "panel")).select("part", "measure", *_r("value"))


def scorer_agreement(spark, sf_dir):
    return evaluate.agreement(scores_now(spark, sf_dir), "lextone", "stocktwits_tag").select("pairs", "agree", "neutral", "opposite", *_r("accuracy", "accuracy_when_decisive"))


# -- scoring -------------------------------------------------------------------------------------------------------


def untagged_posts(spark, sf_dir):
    return scoring.untagged_posts(posts_now(spark, sf_dir), tickers_now(spark, sf_dir)).select("id")


def pending_pairs(spark, sf_dir):
    return scoring.pairs_to_score(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), "secondpass").select("post_id", "ticker", "n_tickers")


def second_pass_picks(spark, sf_dir):
    return scoring.second_pass(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), "lextone", "secondpass", datetime(2025, 7, 1), limit=2000).select("post_id", "ticker", "top")


def lexicon_scores(spark, sf_dir):
    """Every pair the lexicon hasn't scored."""
    return scoring.score_pending(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), scoring.LexiconScorer(), datetime(2025, 8, 1)).select("post_id", "ticker", "label", "score")


def trained_scores(spark, sf_dir):
    """All posts by a word model trained on the labels that the second pass gave."""
    posts = posts_now(spark, sf_dir).select("id", F.concat_ws("\n", "title", "body").alias("text"))
    labelled = scores_now(spark, sf_dir).where(F.col("model") == "secondpass").select(F.col("post_id").alias("id"), "label").join(posts, "id")
    return scoring.WordModel.train(labelled, "text", "label").apply(posts, "id", "text")


# -- reading -------------------------------------------------------------------------------------------------------


def _week(spark, sf_dir):
    return read_api.week_mentions(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), WEEK, MODELS)


def week_summary(spark, sf_dir):
    return read_api.week_summary(_week(spark, sf_dir), ["ticker"]).select("ticker", "mentions", "posts", "authors", "pos", "neg", "neu", _mean())


def community_breakdown(spark, sf_dir):
    return read_api.community_breakdown(_week(spark, sf_dir)).select("source", "community", "posts", _mean())


def top_posts(spark, sf_dir):
    best = read_api.tracked_tickers(tickers_now(spark, sf_dir)).first()
    return read_api.top_posts(_week(spark, sf_dir), best.ticker if best else "", 25).select("post_id", "engagement", "title")


def daily_trend(spark, sf_dir):
    best = read_api.tracked_tickers(tickers_now(spark, sf_dir)).first()
    rows = read_api.daily_trend(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), scores_now(spark, sf_dir), bars_now(spark, sf_dir), best.ticker if best else "", date(2025, 4, 1), date(2025, 5, 31), MODELS)
    return rows.select(F.date_format("on_day", "yyyy-MM-dd").alias("on_day"), "mentions", _mean(), *_r("close"))


def tracked_tickers(spark, sf_dir):
    return read_api.tracked_tickers(tickers_now(spark, sf_dir))


def ticker_picker(spark, sf_dir):
    universe = table(spark, sf_dir, "ticker_universe").withColumn("ticker", canonical_ticker("ticker"))
    return read_api.ticker_list(read_api.most_mentioned(posts_now(spark, sf_dir), tickers_now(spark, sf_dir), datetime(2025, 6, 20), 50), universe, 100)


def week_filings(spark, sf_dir):
    return read_api.week_filings(filings_now(spark, sf_dir), WEEK, FORMS).select("accession", "ticker", "items")


# -- calendar -----------------------------------------------------------------------------------------------------


def stamps_grid(spark, sf_dir):
    return spark.range(1).select(F.explode(quarter_hours(datetime(2025, 5, 9, 23, 7), datetime(2025, 5, 12, 1, 1))).alias("stamp"))


def week_calendar(spark, sf_dir):
    return posts_now(spark, sf_dir).select("id", F.date_format(friday_of(F.col("created_at")), "yyyy-MM-dd").alias("friday"), F.date_format(week_start_of(F.col("created_at")), "yyyy-MM-dd").alias("week_start"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_totals, mentions_effective_scores, attention_z, weekly_components, composite_scores, filtered_mentions, filtered_components, weekly_ranking, heating_up, drop_reposts, drop_syndicated, drop_spam, headline_kinds, author_weights, cap_per_author, post_weights, near_duplicate_posts,
        content_hashes, headline_keys, company_names, post_sentences, post_cashtags, extracted_tickers, filing_items, filing_events, session_context, dollar_volume, early_chatter, return_panel, lead_lag, verdicts, backtest, quintile_spread, hit_rate, added_signal,
        scorer_agreement, untagged_posts, pending_pairs, second_pass_picks, lexicon_scores, trained_scores, week_summary, community_breakdown, top_posts, daily_trend, tracked_tickers, ticker_picker, week_filings, stamps_grid, week_calendar,
    )
}

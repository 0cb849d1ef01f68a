"""Weekly components of each entity against its own baseline, and cross-sectional scores."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import Week, days_back, days_before_week_end, friday_of


def effective_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """Per (post_id, ticker) the label and score of the first model of ``models`` that scored it; others don't count.

    Several rows of that model: the latest, then by label and score. Aggregated, not windowed: one row per pair moves.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    best = F.min(F.struct(place.alias("place"), (-F.coalesce(F.unix_micros(F.col("scored_at").cast("timestamp")), F.lit(0))).alias("age"), "label", "score"))
    found = scores.where(F.col("model").isin(models)).groupBy("post_id", "ticker").agg(best.alias("b"))
    return found.select("post_id", "ticker", "b.label", "b.score")


def load_mentions(posts: DataFrame, tickers: DataFrame, scores: DataFrame, models: list[str], start: datetime, end: datetime, min_confidence: float) -> DataFrame:
    """Posts of [start, end) with their tickers of at least ``min_confidence`` and effective scores (NULL if none)."""
    stamp = lambda t: F.lit(t).cast("timestamp_ntz")
    window = posts.where((F.col("created_at") >= stamp(start)) & (F.col("created_at") < stamp(end))).withColumnRenamed("id", "post_id")
    sure = tickers.where(F.col("confidence") >= min_confidence).select("post_id", "ticker")
    # Scores meet the tickers first, so that the texts move once. All three grow with the posts, so none is broadcast by the bytes of its files.
    scored = sure.join(effective_scores(scores, models).hint("merge"), ["post_id", "ticker"], "left")
    rest = [c for c in window.columns if c != "post_id"]
    return window.join(scored.hint("merge"), "post_id").select("post_id", "ticker", *rest, "label", "score")


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the known values by weight; plain mean when the weights sum to 0; NULL when nothing is known."""
    known = value.isNotNull()
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(F.when(known, weight))), F.avg(value))


def attention(rows: DataFrame, week_days: int, baseline_days: int, std_floor: float, clip: float, by: list[str] = []) -> DataFrame:
    """(by, ticker, attention_z) of tickers with a row in the last ``week_days`` days: mean daily weight of these days less that
    of the baseline days before, over the baseline's population deviation (at least ``std_floor``), clipped. Silent days
    are 0. ``rows`` has ticker, day (0 is the last day) and weight."""
    n, key = week_days + baseline_days, [*by, "ticker"]
    daily = rows.where((F.col("day") >= 0) & (F.col("day") < n)).groupBy(*key, "day").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("c"))
    live = daily.where(F.col("day") < week_days).groupBy(*key).agg(F.sum("c").alias("c")).select(*key)
    grid = live.select(*key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("day"))
    full = grid.join(daily, [*key, "day"], "left").select(*key, "day", F.coalesce("w", F.lit(0.0)).alias("w"))
    now, base = F.when(F.col("day") < week_days, F.col("w")), F.when(F.col("day") >= week_days, F.col("w"))
    z = (F.avg(now) - F.avg(base)) / F.greatest(F.stddev_pop(base), F.lit(float(std_floor)))
    return full.groupBy(*key).agg(F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), z)).alias("attention_z"))


def with_days(mentions: DataFrame, week: Week, parity: bool = False) -> DataFrame:
    """Add ``day`` (0..6 is the week) and ``block`` (7-day blocks counted back)."""
    day = days_back(F.col("created_at"), week.end, parity)
    return mentions.withColumn("day", day).withColumn("block", F.floor(F.col("day") / 7).cast("int"))


def spread_over_weeks(mentions: DataFrame, baseline_days: int = 30) -> DataFrame:
    """Each mention once for every week whose window it lies in, the week itself and ``baseline_days`` before: adds
    ``week_start`` (the Monday), ``day`` and ``block``. A row lies in at most ``ceil((7 + baseline_days) / 7)`` windows, so all
    weeks are ranked in one job over so many times the rows."""
    reach = -(-(7 + baseline_days) // 7)
    own = mentions.withColumn("_tm_f", friday_of(F.col("created_at")))
    rows = own.withColumn("_tm_f", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda j: F.date_add("_tm_f", j * 7))))
    rows = rows.withColumn("day", days_before_week_end(F.col("created_at"), F.col("_tm_f"))).where(F.col("day").between(0, 6 + baseline_days))
    return rows.withColumn("block", F.floor(F.col("day") / 7).cast("int")).withColumn("week_start", F.date_sub("_tm_f", 4)).drop("_tm_f")


def distinct_counts(rows: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """(by, a count for each name) of the distinct known values of each column: made distinct first, then counted, so both
    steps are pre-aggregated and no set of values is held."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("of"), c.cast("string").alias("v")) for n, c in columns.items()]))
    seen = rows.select(*by, values.alias("d")).where(F.col("d.v").isNotNull()).select(*by, "d.of", "d.v").distinct()
    return seen.groupBy(*by).agg(*[F.count_if(F.col("of") == n).alias(n) for n in columns])


def weekly_components(rows: DataFrame, baseline_days: int = 30, std_floor: float = 1.0, clip: float = 10.0, by: list[str] = []) -> DataFrame:
    """Per ticker (and ``by``) with rows in block 0: mentions, n_authors, attention_z, sentiment, sentiment_prev, momentum, breadth.

    ``rows`` are weighted mention rows with day and block. Block 0 and block 1 are aggregated in one pass; distinct
    counts leave out NULLs.
    """
    key = [*by, "ticker"]
    now, prev = F.col("block") == 0, F.col("block") == 1
    only = lambda c, when: F.when(when, F.col(c))
    agg = rows.where(F.col("block") <= 1).groupBy(*key).agg(
        F.count_if(now).alias("mentions"),
        weighted_mean(only("score", now), only("weight", now)).alias("sentiment"),
        weighted_mean(only("score", prev), only("weight", prev)).alias("sentiment_prev"),
    )
    counts = distinct_counts(rows.where(now), key, n_authors=F.col("author_id"), n_communities=F.col("community"), n_sources=F.col("source"))
    joined = agg.where(F.col("mentions") > 0).join(counts, key, "left").na.fill(0, ["n_authors", "n_communities", "n_sources"])
    breadth = F.log1p(F.col("n_authors")) + F.log1p(F.col("n_communities")) + F.log1p(F.col("n_sources"))
    joined = joined.join(attention(rows, 7, baseline_days, std_floor, clip, by), key)
    return joined.select(*key, "mentions", "n_authors", "attention_z", "sentiment", "sentiment_prev", (F.col("sentiment") - F.col("sentiment_prev")).alias("momentum"), breadth.alias("breadth"))


def zscore(value: Column, by: list[str], fill: bool = True) -> Column:
    """Cross-sectional z-score with the population deviation; 0 for fewer than two known values or a constant.

    ``fill`` makes unknown values 0, else they stay NULL. A deviation under 1e-12 counts as 0.
    """
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    sd, n = F.stddev_pop(value).over(over), F.count(value).over(over)
    z = F.when((n < 2) | (sd < 1e-12) | sd.isNull(), F.when(value.isNotNull(), 0.0)).otherwise((value - F.avg(value).over(over)) / F.nullif(sd, F.lit(0.0)))
    return F.coalesce(z, F.lit(0.0)) if fill else z


def composites(df: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """Add composite_bull and composite_bear: weighted sums of z-scores; bear turns the sign of sentiment and momentum.

    ``weights`` by attention, sentiment, momentum, breadth. The window is one row per entity and period, which stays
    small whatever the number of posts.
    """
    columns = {"attention": "attention_z", "sentiment": "sentiment", "momentum": "momentum", "breadth": "breadth"}
    for name, column in columns.items():
        df = df.withColumn(f"_tm_{name}", zscore(F.col(column), by))
    part = lambda name, sign=1: F.lit(float(weights[name] * sign)) * F.col(f"_tm_{name}")
    bull = part("attention") + part("sentiment") + part("momentum") + part("breadth")
    bear = part("attention") + part("sentiment", -1) + part("momentum", -1) + part("breadth")
    return df.withColumn("composite_bull", bull).withColumn("composite_bear", bear).drop(*[f"_tm_{n}" for n in columns])


def ranked_list(signals: DataFrame, side: str, n: int, by: list[str] | None = None) -> DataFrame:
    """The ``n`` heating-up tickers (attention_z > 0, sentiment of the side's sign) by their composite, with ``rank``."""
    sign = F.col("sentiment") > 0 if side == "bull" else F.col("sentiment") < 0
    live = signals.where((F.col("attention_z") > 0) & sign)
    order = W.partitionBy(*(by or [])).orderBy(F.col(f"composite_{side}").desc_nulls_last(), F.col("ticker"))
    if by:
        return live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    top = live.orderBy(F.col(f"composite_{side}").desc_nulls_last(), "ticker").limit(n)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(f"composite_{side}").desc_nulls_last(), F.col("ticker"))))


def baseline_start(week: Week, days: int) -> datetime:
    return week.start - timedelta(days=days)

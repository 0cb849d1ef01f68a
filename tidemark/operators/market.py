"""Context of entities from their daily series: returns by session, volume ratios, filings, as-of values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import friday_of, week_start_of
from tidemark.functions.text import ITEM_NAMES, item_groups, split_items


def session_context(bars: DataFrame, friday: date, short: int = 5, long: int = 21, baseline_days: int = 30) -> DataFrame:
    """(ticker, ret_5d, ret_30d, rel_volume, updown_vol_ratio) from the bars up to ``friday``.

    Returns count sessions back from the last one and need more sessions than that. rel_volume is the week's mean volume
    (Saturday to Friday) over that of the ``baseline_days`` before. updown_vol_ratio sums volume of days that closed higher
    and lower than the session before. NULL where a part is missing or a divisor isn't positive.
    """
    day = F.lit(friday)
    known = bars.where(F.col("date") <= day)
    start = F.date_sub(day, 6)
    order = W.partitionBy("ticker").orderBy("date")
    rows = known.withColumn("back", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).withColumn("change", F.col("close") - F.lag("close").over(order))
    week = F.col("date") >= start
    base = (F.col("date") < start) & (F.col("date") >= F.date_sub(start, baseline_days))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("close")))
    mean = lambda when: F.avg(F.when(when, F.col("volume").cast("double")))
    total = lambda when: F.sum(F.when(week & when, F.col("volume").cast("double")))
    out = rows.groupBy("ticker").agg(at(1).alias("c0"), at(short + 1).alias("cs"), at(long + 1).alias("cl"), mean(week).alias("v"), mean(base).alias("b"), total(F.col("change") > 0).alias("up"), total(F.col("change") < 0).alias("down"))
    ratio = lambda a, b: F.try_divide(F.col(a), F.when(F.col(b) > 0, F.col(b)))
    return out.select("ticker", (F.try_divide(F.col("c0"), F.col("cs")) - 1).alias("ret_5d"), (F.try_divide(F.col("c0"), F.col("cl")) - 1).alias("ret_30d"), ratio("v", "b").alias("rel_volume"), F.try_divide(F.coalesce(F.col("up"), F.lit(0.0)), F.when(F.col("down") > 0, F.col("down"))).alias("updown_vol_ratio"))


def weekly_context(bars: DataFrame, short: int = 5, long: int = 21, baseline_days: int = 30, context_days: int = 60) -> DataFrame:
    """:func:`session_context` for all weeks at once: (week_start, ticker, ret_5d, ret_30d, rel_volume, updown_vol_ratio) of
    every week that a ticker's bars of the ``context_days`` before its Friday reach; only those bars count.

    A bar takes the closes ``short`` and ``long`` sessions before it along and goes to the weeks it can serve, at most
    ``context_days // 7 + 1``; then all is one aggregation.
    """
    sessions = W.partitionBy("ticker").orderBy("date")
    seen = bars.select("ticker", "date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), friday_of(F.col("date")).alias("own"))
    for k, name in ((1, "p"), (short, "s"), (long, "l")):
        seen = seen.withColumn(name, F.lag("close", k).over(sessions)).withColumn(f"{name}_at", F.lag("date", k).over(sessions))
    weeks = F.transform(F.sequence(F.lit(0), F.lit(context_days // 7 + 1)), lambda j: F.date_add("own", j * 7))
    rows = seen.withColumn("friday", F.explode(weeks)).where(F.datediff("friday", "date") <= context_days)
    start = F.date_sub("friday", 6)
    known = lambda name: F.when(F.datediff("friday", f"{name}_at") <= context_days, F.col(name))
    week, base = F.col("date") >= start, (F.col("date") < start) & (F.col("date") >= F.date_sub(start, baseline_days))
    change = F.col("close") - known("p")
    total = lambda when: F.sum(F.when(week & when, F.col("volume")))
    out = rows.groupBy("ticker", "friday").agg(
        F.max_by(F.struct(F.col("close").alias("c"), known("s").alias("s"), known("l").alias("l")), "date").alias("last"),
        F.avg(F.when(week, F.col("volume"))).alias("v"), F.avg(F.when(base, F.col("volume"))).alias("b"), total(change > 0).alias("up"), total(change < 0).alias("down"),
    )
    ratio = lambda x, y: F.try_divide(x, F.when(y > 0, y))
    ret = lambda x: F.try_divide(F.col("last.c"), F.col(f"last.{x}")) - 1
    return out.select(F.date_sub("friday", 4).alias("week_start"), "ticker", ret("s").alias("ret_5d"), ret("l").alias("ret_30d"), ratio(F.col("v"), F.col("b")).alias("rel_volume"), ratio(F.coalesce("up", F.lit(0.0)), F.col("down")).alias("updown_vol_ratio"))


def purchases_within(filings: DataFrame, lookback_days: int) -> DataFrame:
    """(week_start, ticker, insider_buy_flag) of all weeks with a filing in (friday - lookback, friday]: any with purchases?"""
    own = friday_of(F.col("filing_date"))
    weeks = F.transform(F.sequence(F.lit(0), F.lit(lookback_days // 7 + 1)), lambda j: F.date_add(own, j * 7))
    served = filings.where(F.col("filing_date").isNotNull()).select("ticker", "filing_date", "purchase_count", F.explode(weeks).alias("friday")).where(F.datediff("friday", "filing_date") < lookback_days)
    return served.groupBy(F.date_sub("friday", 4).alias("week_start"), "ticker").agg(F.bool_or(F.coalesce(F.col("purchase_count") > 0, F.lit(False))).alias("insider_buy_flag"))


def mean_dollar_volume(bars: DataFrame, sessions: int = 30) -> DataFrame:
    """(ticker, avg_dollar_volume): mean of close times volume over the last ``sessions`` bars; not positive ones dropped."""
    last = bars.withColumn("back", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))).where(F.col("back") <= sessions)
    return last.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume")).where(F.col("avg_dollar_volume") > 0)


def wide_to_long(wide: DataFrame, key: str, names: list[str], variable: str = "ticker", value: str = "close") -> DataFrame:
    """One row per key and column with a value."""
    return wide.unpivot(key, names, variable, value).where(F.col(value).isNotNull())


def top_share(value: Column, tie: Column, by: list[str], quantile: float) -> Column:
    """Is the row among the top 1 - quantile of its group by rank (at least one row)? Ties by ``tie``."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(group) * (1 - F.lit(quantile))))
    return F.row_number().over(group.orderBy(value.desc_nulls_last(), tie)) <= n


def early_chatter(signals: DataFrame, by: list[str], quantile: float = 0.9, max_abs_return: float = 0.03, min_rel_volume: float = 1.2) -> DataFrame:
    """Add early_chatter_flag: top composite of either side, little price movement yet, volume picking up; NULLs are false."""
    top = top_share(F.col("composite_bull"), F.col("ticker"), by, quantile) | top_share(F.col("composite_bear"), F.col("ticker"), by, quantile)
    return signals.withColumn("early_chatter_flag", F.coalesce(top & (F.abs("ret_5d") < max_abs_return) & (F.col("rel_volume") > min_rel_volume), F.lit(False)))


def divergence(rel_volume: Column, short_return: Column, sentiment: Column, min_rel_volume: float = 1.2, min_drop: float = 0.02) -> Column:
    return F.coalesce((rel_volume > min_rel_volume) & (short_return < -min_drop) & (sentiment > 0), F.lit(False))


def flag_within(signals: DataFrame, filings: DataFrame, friday: date, lookback_days: int) -> DataFrame:
    """Add insider_buy_flag: any filing with purchases in (friday - lookback, friday]; false without filings."""
    inside = filings.where((F.col("filing_date") > F.date_sub(F.lit(friday), lookback_days)) & (F.col("filing_date") <= F.lit(friday)))
    flags = inside.groupBy("ticker").agg(F.bool_or(F.coalesce(F.col("purchase_count") > 0, F.lit(False))).alias("insider_buy_flag"))
    return signals.drop("insider_buy_flag").join(flags, "ticker", "left").withColumn("insider_buy_flag", F.coalesce("insider_buy_flag", F.lit(False)))


def event_labels(filings: DataFrame, by: list[str], red_name: str = "Red flag") -> DataFrame:
    """Per group: ``events`` (item groups in their order, names of red-flag items behind theirs; NULL if none) and ``red_flag``.

    Codes are made distinct per group before they are gathered: at most as many as there are item codes.
    """
    codes = filings.select(*by, F.explode(split_items(F.col("items"))).alias("code")).distinct().groupBy(*by).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    names = F.create_map(*[F.lit(x) for kv in ITEM_NAMES.items() for x in kv])
    red = F.array(*[F.lit(c) for c in _red_codes()])
    reds = F.array_sort(F.transform(F.filter("codes", lambda c: F.array_contains(red, c)), lambda c: F.element_at(names, c)))
    groups = F.transform(item_groups(F.col("codes")), lambda g: F.when(g == red_name, F.concat(g, F.lit(": "), F.array_join(reds, ", "))).otherwise(g))
    return codes.select(*by, F.nullif(F.array_join(groups, "; "), F.lit("")).alias("events"), (F.size(reds) > 0).alias("red_flag"))


def _red_codes() -> list[str]:
    from tidemark.functions.text import ITEM_GROUPS

    return ITEM_GROUPS["Red flag"]


def filings_known_in(filings: DataFrame, forms: list[str], start: Column, end: Column) -> DataFrame:
    """Filings of the forms that became known in [start, end): by acceptance time, else by filing date."""
    at = F.coalesce(F.col("accepted_at"), F.col("filing_date").cast("timestamp_ntz"))
    return filings.where(F.col("form").isin(forms) & (at >= start) & (at < end))


def asof_close(bars: DataFrame, fridays: DataFrame, tolerance_days: int = 6) -> DataFrame:
    """(ticker, friday, close) of the newest bar at most ``tolerance_days`` before each Friday; NULL where none.

    Every bar is sent to the Fridays it can serve (at most ``ceil((tolerance + 1) / 7)``), so this is one aggregation of the
    bars: no range join and no window over a ticker's whole history. Fridays are dates; ``fridays`` has one column friday.
    """
    own = F.date_add(F.col("date"), F.pmod(F.lit(4) - F.weekday("date"), F.lit(7)))
    reach = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tolerance_days // 7)), lambda i: F.date_add(own, i * 7)), lambda f: F.datediff(f, F.col("date")) <= tolerance_days)
    served = bars.select("ticker", "date", "close", F.explode(reach).alias("friday"))
    newest = served.groupBy("ticker", "friday").agg(F.max(F.struct("date", "close")).alias("n")).select("ticker", "friday", F.col("n.close").alias("close"))
    return newest.join(fridays.distinct(), "friday", "left_semi").select("ticker", "friday", "close")


def return_panel(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with ret_prior, ret_same, ret_next: returns from as-of closes at the Fridays -2, -1, 0, +1 of each week."""
    friday = F.date_add("week_start", 4)
    weeks = signals.select(F.explode(F.array(*[F.date_add(friday, 7 * k) for k in (-2, -1, 0, 1)])).alias("friday")).distinct()
    closes = asof_close(bars, weeks)
    out = signals.withColumn("_tm_f", friday)
    for k, name in ((-2, "a"), (-1, "b"), (0, "c"), (1, "d")):
        at = closes.select("ticker", F.date_sub("friday", 7 * k).alias("_tm_f"), F.col("close").alias(f"_tm_{name}"))
        out = out.join(at, ["ticker", "_tm_f"], "left")
    ret = lambda x, y: F.try_divide(F.col(f"_tm_{y}"), F.col(f"_tm_{x}")) - 1
    return out.withColumns({"ret_prior": ret("a", "b"), "ret_same": ret("b", "c"), "ret_next": ret("c", "d")}).drop("_tm_f", "_tm_a", "_tm_b", "_tm_c", "_tm_d")


def with_context(signals: DataFrame, bars: DataFrame, purchases: DataFrame | None, filings: DataFrame | None, forms: list[str], lookback_days: int = 30, **limits: float) -> DataFrame:
    """Signals (week_start, ticker, composites, ...) of any number of weeks with everything that is context only and never
    ranks: returns and volume, early_chatter_flag, insider_buy_flag, events and red_flag.

    Without ``purchases`` (insider filings) or ``filings`` (SEC) their columns are NULL, as nothing is known; with them, tickers that have
    none get false. Nothing is broadcast: Spark goes by the compressed bytes of the bars and filings, and the labels are made later.
    """
    key = ["week_start", "ticker"]
    out = signals.join(weekly_context(bars).hint("merge"), key, "left")
    out = early_chatter(out, ["week_start"], **limits)
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    if purchases is None:
        out = out.withColumn("insider_buy_flag", F.lit(None).cast("boolean"))
    else:
        out = out.join(purchases_within(purchases, lookback_days).hint("merge"), key, "left").withColumn("insider_buy_flag", no("insider_buy_flag"))
    if filings is None:
        return out.withColumns({"events": F.lit(None).cast("string"), "red_flag": F.lit(None).cast("boolean")})
    at = F.coalesce(F.col("accepted_at"), F.col("filing_date").cast("timestamp_ntz"))
    known = filings.where(F.col("form").isin(forms) & at.isNotNull()).withColumn("week_start", week_start_of(at))
    return out.join(event_labels(known, ["ticker", "week_start"]).hint("merge"), key, "left").withColumn("red_flag", no("red_flag"))

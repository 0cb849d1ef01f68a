"""The ranking of weeks as one operator, and the evaluation of ranked weeks as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.operators import evaluate, market, signals

#: Signals whose lead or lag is put into words.
JUDGED = ["sentiment", "attention_z", "composite_bull"]


def rank_weeks(mentions: DataFrame, weights: dict[str, float], bars: DataFrame, purchases: DataFrame | None, filings: DataFrame | None, forms: list[str], eligible: Column | None = None, **limits: float) -> DataFrame:
    """The rows of weekly_signals for all weeks of ``mentions`` at once.

    ``mentions`` are weighted rows with week_start, day and block that have passed the noise filters. Components, the
    condition ``eligible`` on them, and composites among a week's tickers come first; context is joined on after that,
    so that it never ranks.
    """
    found = signals.weekly_components(mentions, by=["week_start"])
    if eligible is not None:
        found = found.where(eligible)
    ranked = scratch.materialize(signals.composites(found, ["week_start"], weights), "ranked")
    out = market.with_context(ranked, bars, purchases, filings, forms, **limits)
    return out.select(
        "week_start", "ticker", "mentions", "attention_z", "sentiment", "sentiment_prev", "momentum", "breadth", "composite_bull", "composite_bear",
        "ret_5d", "ret_30d", "rel_volume", "updown_vol_ratio", "insider_buy_flag", "early_chatter_flag", "events", "red_flag",
    )


def run_backtest(panel: DataFrame, n: int = 20, least: int = 5, weight: float = 0.15) -> dict[str, DataFrame]:
    """Everything that is asked of a panel: rank correlations of both composites with next week's returns by week and
    summed up, the quintile spread, hit rates of both lists and of the most mentioned tickers, and the added signal."""
    ic = {side: evaluate.spearman(panel, ["week_start"], f"composite_{side}", "ret_next", least).where(F.col("ic").isNotNull()) for side in ("bull", "bear")}
    live = F.col("attention_z") > 0
    lists = {"bull": live & (F.col("sentiment") > 0), "bear": live & (F.col("sentiment") < 0)}
    out = {f"ic_{side}": evaluate.summarise(rows, []) for side, rows in ic.items()} | {"ic_bull_series": ic["bull"], "quintile_spread": evaluate.quintile_spread(panel, "composite_bull", least)}
    for side, require in lists.items():
        out[f"{side}_list"] = evaluate.hit_rate(panel, f"composite_{side}", n, side, require)
        out[f"{side}_baseline_mentions"] = evaluate.hit_rate(panel, "mentions", n, side)
    return out | {"rel_volume": evaluate.added_signal(panel, weight=weight, least=least)}


def analyse(panel: DataFrame, n: int = 20, least: int = 5, weight: float = 0.15, min_weeks: int = 12) -> DataFrame:
    """(part, measure, value): the backtest, the number of weeks and whether they are enough, as one table of figures."""
    long = lambda df, part, *names: df.select(F.lit(part).alias("part"), F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("part", "m.*")
    back = run_backtest(panel, n, least, weight)
    known = panel.where(evaluate.clean("ret_next").isNotNull()).select("week_start").distinct().agg(F.count(F.lit(1)).alias("weeks_with_returns"))
    known = known.withColumn("enough_data", F.col("weeks_with_returns") >= min_weeks)
    parts = [long(known, "panel", "weeks_with_returns", "enough_data")]
    parts += [long(back[k], k, "mean_ic", "t_stat", "weeks", "share_positive") for k in ("ic_bull", "ic_bear")]
    parts.append(long(back["quintile_spread"].agg(F.avg("spread").alias("mean"), F.count(F.lit(1)).alias("weeks")), "quintile_spread", "mean", "weeks"))
    parts += [long(back[k], k, "picks", "hits", "hit_rate", "weeks") for k in ("bull_list", "bull_baseline_mentions", "bear_list", "bear_baseline_mentions")]
    parts.append(long(back["rel_volume"], "rel_volume", "mean_ic_base", "mean_ic_with", "improves"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

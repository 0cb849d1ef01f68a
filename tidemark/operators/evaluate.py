"""Evaluation of weekly signals against returns: rank correlation, quantile spread, hit rate, agreement of scorers.

A panel has one row per (week_start, ticker): as many rows as ranked entities, not posts. Windows are per week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNALS = ["sentiment", "momentum", "attention_z", "composite_bull", "composite_bear"]
HORIZONS = ["ret_prior", "ret_same", "ret_next"]


def clean(c: str) -> Column:
    """NaN as NULL."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1, tied values share the mean of their places."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, n, ic): rank correlation per group over complete pairs; NULL when one side is constant.

    Groups of fewer than max(3, ``least``) complete pairs have no row.
    """
    pairs = df.select(*by, clean(x).alias("x"), clean(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    ranked = pairs.select(*by, average_rank(F.col("x"), by).alias("rx"), average_rank(F.col("y"), by).alias("ry"))
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    found = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rx", "ry").alias("c"), spread.alias("s"))
    return found.where(F.col("n") >= max(3, least)).select(*by, "n", F.try_divide(F.col("c"), F.when(F.col("s") > 1e-12, F.col("s"))).alias("ic"))


def summarise(ics: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean_ic, t_stat, weeks, share_positive); t_stat is NULL for one week or constant values."""
    known = ics.where(F.col("ic").isNotNull())
    sd = F.stddev_samp("ic")
    out = known.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), sd.alias("_tm_sd"), F.count(F.lit(1)).alias("weeks"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("share_positive"))
    return out.select(*by, "mean_ic", F.when(F.col("_tm_sd") > 1e-12, F.col("mean_ic") / (F.col("_tm_sd") / F.sqrt("weeks"))).alias("t_stat"), "weeks", "share_positive")


def lead_lag(panel: DataFrame, least: int = 5, signals: list[str] = SIGNALS, horizons: list[str] = HORIZONS) -> DataFrame:
    """(signal, horizon, mean_ic, t_stat, weeks, share_positive): every pair in one grouped plan."""
    pair = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon"), clean(s).alias("x"), clean(h).alias("y")) for s in signals for h in horizons]))
    long = panel.select("week_start", pair.alias("p")).select("week_start", "p.*")
    return summarise(spearman(long, ["week_start", "signal", "horizon"], "x", "y", least), ["signal", "horizon"])


def quantile_bin(rank: Column, n: Column, bins: int = 5) -> Column:
    """Bin 0.. of rank 1..n, with edges at equal steps of rank, as ``qcut`` on ranks cuts (unlike ``ntile``)."""
    up = ((rank - 1) * bins + n - 2) / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.floor(up).cast("int"), F.lit(1)) - 1


def quintile_spread(panel: DataFrame, signal: str, least: int = 5, target: str = "ret_next") -> DataFrame:
    """(week_start, spread): mean target of the top fifth less that of the bottom fifth, of weeks with enough rows."""
    rows = panel.select("week_start", "ticker", clean(signal).alias("x"), clean(target).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    week = W.partitionBy("week_start")
    binned = rows.withColumn("n", F.count(F.lit(1)).over(week)).where(F.col("n") >= max(least, 5)).withColumn("b", quantile_bin(F.row_number().over(week.orderBy("x", "ticker")), F.col("n")))
    mean = lambda b: F.avg(F.when(F.col("b") == b, F.col("y")))
    return binned.groupBy("week_start").agg((mean(4) - mean(0)).alias("spread"))


def cumulative(df: DataFrame, order: str, value: str) -> DataFrame:
    """Add ``cumulative``: product of 1 + value up to the row, less 1. One row per week."""
    grown = F.product(F.lit(1.0) + F.col(value)).over(W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("cumulative", grown - 1)


def hit_rate(panel: DataFrame, pick: str, n: int, side: str, require: Column | None = None, target: str = "ret_next") -> DataFrame:
    """(picks, hits, hit_rate, weeks): of the ``n`` highest ``pick`` per week among rows that meet ``require``, the share that
    strictly beats (bull) or trails (bear) that week's median target over all rows."""
    rows = panel.select("week_start", "ticker", clean(pick).alias("x"), clean(target).alias("y"), (F.lit(True) if require is None else F.coalesce(require, F.lit(False))).alias("may")).where(F.col("y").isNotNull())
    medians = rows.groupBy("week_start").agg(F.median("y").alias("m"))
    chosen = rows.where(F.col("may") & F.col("x").isNotNull()).withColumn("r", F.row_number().over(W.partitionBy("week_start").orderBy(F.col("x").desc(), "ticker"))).where(F.col("r") <= n)
    hit = F.col("y") > F.col("m") if side == "bull" else F.col("y") < F.col("m")
    out = chosen.join(medians, "week_start").agg(F.count(F.lit(1)).alias("picks"), F.count_if(hit).alias("hits"), F.countDistinct("week_start").alias("weeks"))
    return out.select("picks", "hits", F.try_divide(F.col("hits"), F.col("picks")).alias("hit_rate"), "weeks")


def added_signal(panel: DataFrame, base: str = "composite_bull", extra: str = "rel_volume", weight: float = 0.15, least: int = 5, target: str = "ret_next") -> DataFrame:
    """(mean_ic_base, mean_ic_with, improves): does weight times the weekly z-score of ``extra`` improve the rank correlation?

    Rows that miss one of the columns are left out first; improves is NULL when either mean is.
    """
    from tidemark.operators.signals import zscore

    rows = panel.select("week_start", clean(base).alias("a"), clean(extra).alias("e"), clean(target).alias("y")).dropna()
    rows = rows.withColumn("b", F.col("a") + F.lit(weight) * zscore(F.col("e"), ["week_start"], fill=False))
    long = rows.select("week_start", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in ("a", "b")])).alias("s")).select("week_start", "y", "s.*")
    mean = summarise(spearman(long, ["week_start", "kind"], "x", "y", least), ["kind"])
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("mean_ic")))
    return mean.agg(pick("a").alias("mean_ic_base"), pick("b").alias("mean_ic_with")).withColumn("improves", F.col("mean_ic_with") > F.col("mean_ic_base"))


def verdict(table: DataFrame, min_t: float = 2.0) -> DataFrame:
    """(signal, verdict): what a signal's rank correlations with prior and next returns say, the first that holds of:

    unknown (one of them is missing), leads (next is significant, positive and no weaker than prior), reverse (next is significant
    and negative), follows (prior is significant and stronger than next), none.
    """
    at = lambda h, c: F.max(F.when(F.col("horizon") == h, F.col(c)))
    wide = table.groupBy("signal").agg(at("ret_prior", "mean_ic").alias("p"), at("ret_prior", "t_stat").alias("pt"), at("ret_next", "mean_ic").alias("n"), at("ret_next", "t_stat").alias("nt"))
    strong = lambda t: F.coalesce(F.abs(F.col(t)) >= min_t, F.lit(False))
    kind = F.when(F.col("n").isNull() | F.col("p").isNull(), "unknown").when(strong("nt") & (F.col("n") > 0) & (F.abs("n") >= F.abs("p")), "leads")
    kind = kind.when(strong("nt") & (F.col("n") < 0), "reverse").when(strong("pt") & (F.abs("p") > F.abs("n")), "follows").otherwise("none")
    return wide.select("signal", kind.alias("verdict"))


def agreement(scores: DataFrame, model: str, tag_model: str, neutral_band: float = 0.1) -> DataFrame:
    """One row: pairs scored by both models, how many agree in sign, are neutral (|score| <= band) or opposite, and the shares.

    Duplicate keys count once, with the latest score.
    """
    one = lambda m: scores.where((F.col("model") == m) & F.col("score").isNotNull()).groupBy("post_id", "ticker").agg(F.max(F.struct("scored_at", "score")).alias("s")).select("post_id", "ticker", F.col("s.score").alias(m))
    both = one(tag_model).join(one(model), ["post_id", "ticker"])
    quiet = F.abs(F.col(model)) <= neutral_band
    same = ~quiet & (F.signum(model) == F.signum(tag_model))
    out = both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(same).alias("agree"), F.count_if(quiet).alias("neutral"), F.count_if(~quiet & ~(F.signum(model) == F.signum(tag_model))).alias("opposite"))
    return out.withColumn("accuracy", F.try_divide("agree", "pairs")).withColumn("accuracy_when_decisive", F.try_divide(F.col("agree"), F.col("agree") + F.col("opposite")))

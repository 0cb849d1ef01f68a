"""Scoring of (post, ticker) pairs by pluggable models, and what is still to be scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.text import context_text


# Labels of a model's reply.
REPLY_LABELS = {"bullish": "pos", "bearish": "neg", "neutral": "neu"}


@dataclass(frozen=True)
class Score:
    label: str | None
    score: float | None


class Scorer(Protocol):
    """A model: ``name`` is what it is stored as; it is pickled to the workers and used batch by batch."""

    name: str

    def score(self, texts: list[str]) -> list[Score]: ...


class LexiconScorer:
    """Counts words of two lists; the score is (positive - negative) / (positive + negative)."""

    name = "lexicon"

    def __init__(self, positive: set[str] | None = None, negative: set[str] | None = None, band: float = 0.1):
        self.positive = positive or {"beat", "bullish", "buy", "cheap", "growth", "moon", "strong", "undervalued", "upgrade", "win"}
        self.negative = negative or {"bearish", "crash", "downgrade", "dump", "lawsuit", "miss", "overvalued", "sell", "weak", "worse"}
        self.band = band

    def score(self, texts: list[str]) -> list[Score]:
        out = []
        for text in texts:
            found = re.findall(r"[^\W\d_]+", text.lower())
            p, n = sum(w in self.positive for w in found), sum(w in self.negative for w in found)
            value = (p - n) / (p + n) if p + n else 0.0
            out.append(Score("pos" if value > self.band else "neg" if value < -self.band else "neu", value))
        return out


def score_from_probabilities(positive: Column, negative: Column, neutral: Column) -> Column:
    """Struct (label, score): the likeliest label, and positive less negative to six digits."""
    best = F.greatest(positive, negative, neutral)
    label = F.when(positive == best, "pos").when(negative == best, "neg").otherwise("neu")
    return F.struct(label.alias("label"), F.round(positive - negative, 6).alias("score"))


LABELS = ["pos", "neg", "neu"]


def _word_rows(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """(keep, word, n): how often each word stands in a text."""
    found = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    return df.select(*keep, found).groupBy(*keep, "word").agg(F.count(F.lit(1)).alias("n"))


class WordModel:
    """A multinomial naive Bayes model of labels, trained and applied as relations: a table of the log probability of
    each word under each label, of as many rows as there are words, and the labels' own frequencies."""

    def __init__(self, words: DataFrame, priors: dict[str, float]):
        self.words, self.priors = words, priors

    @classmethod
    def train(cls, labelled: DataFrame, text: str, label: str) -> WordModel:
        """From every row with a label of ``LABELS``; words are counted once more than they occur. NULL texts are empty."""
        rows = labelled.where(F.col(label).isin(LABELS)).select(F.col(label).alias("label"), F.coalesce(text, F.lit("")).alias("text"))
        known = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows at most
        each = scratch.materialize(_word_rows(rows, ["label"], F.col("text")), "label-words")
        mass = {r.label: r.n for r in each.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        size = each.select("word").distinct().count()
        log = [F.log((F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)) + 1) / F.lit(float(max(1, mass.get(k, 0) + size)))).alias(k) for k in LABELS]
        words = scratch.materialize(each.groupBy("word").agg(*log), "word-model")
        every = sum(known.values())
        return cls(words, {k: math.log((known.get(k, 0) + 1) / (every + len(LABELS))) for k in LABELS})

    def apply(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, label, score) of texts with unique keys: the likeliest label, and the probability of pos less that of neg. Words that
        the model doesn't know say nothing."""
        found = scratch.join_checked(_word_rows(texts, [key], F.coalesce(text, F.lit(""))), self.words, ["word"], "inner", key)
        sums = found.groupBy(key).agg(*[F.sum(F.col("n") * F.col(k)).alias(k) for k in LABELS])
        every = texts.select(key).join(sums, key, "left").select(key, *[(F.coalesce(k, F.lit(0.0)) + F.lit(self.priors[k])).alias(k) for k in LABELS])
        share = [F.lit(1.0) / sum(F.exp(F.least(F.col(j) - F.col(k), F.lit(700.0))) for j in LABELS) for k in LABELS]
        return every.select(key, score_from_probabilities(*share).alias("s")).select(key, "s.label", "s.score")


def score_from_reply(reply: Column) -> Column:
    """Struct (label, score) of a JSON reply: bullish, bearish or neutral as pos, neg or neu, the score (a number, or a
    string that reads as one) clamped to [-1, 1] and rounded to four digits; NULL when unreadable or of another label."""
    parsed = F.from_json(reply, "label string, score string")
    number = F.nanvl(parsed["score"].try_cast("double"), F.lit(None))
    value = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), number)), 4)
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in REPLY_LABELS.items() for x in kv]), parsed["label"])
    return F.when(label.isNotNull() & number.isNotNull(), F.struct(label.alias("label"), value.alias("score")))


def score_texts(pairs: DataFrame, text: str, scorer: Scorer, batch: int = 16) -> DataFrame:
    """``pairs`` with label and score; each distinct text is scored once, wherever it occurs.

    Texts are joined by a 128-bit hash, so no text is shuffled twice. NULL texts get NULL.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["t"].tolist()
            scores = [s for i in range(0, len(texts), batch) for s in scorer.score(texts[i : i + batch])]
            yield pd.DataFrame({"k": frame["k"], "label": [s.label for s in scores], "score": [s.score for s in scores]})

    keyed = pairs.withColumn("_tm_k", F.md5(F.col(text)))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy(F.col("_tm_k").alias("k")).agg(F.first(text).alias("t"))
    scored = distinct.mapInPandas(run, "k string, label string, score double")
    return keyed.join(scored.withColumnRenamed("k", "_tm_k"), "_tm_k", "left").drop("_tm_k")


def untagged_posts(posts: DataFrame, tickers: DataFrame) -> DataFrame:
    """Posts without a ticker found in their text (tags given by the source don't count)."""
    return posts.join(tickers.where(F.col("match_type") != "source").select(F.col("post_id").alias("id")), "id", "left_anti")


def pairs_to_score(posts: DataFrame, tickers: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """(post_id, ticker, title, body, created_at, n_tickers) of pairs the model hasn't scored.

    n_tickers counts the post's pairs still to be scored, not all its tickers. :func:`in_order` sorts them.
    """
    done = scores.where(F.col("model") == model).select("post_id", "ticker")
    todo = tickers.select("post_id", "ticker").distinct().join(done, ["post_id", "ticker"], "left_anti")
    counted = todo.join(todo.groupBy("post_id").agg(F.count(F.lit(1)).alias("n_tickers")), "post_id")
    return counted.join(posts.select(F.col("id").alias("post_id"), "title", "body", "created_at"), "post_id")


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs in the order in which they are scored."""
    return pairs.orderBy("created_at", "post_id", "ticker")


def second_pass(posts: DataFrame, tickers: DataFrame, scores: DataFrame, base_model: str, own_model: str, now: datetime, days: int = 14, doubt: float = 0.3, top_k: int = 5, limit: int = 2000, salts: int = 16) -> DataFrame:
    """Pairs for a second, costlier model: recent ones whose base score is doubtful, or of the ``top_k`` most engaged of their
    ticker and (Monday) week, not yet scored by it; the most engaged of the weeks first, at most ``limit``.

    The rank counts all candidates, scored again or not. Hot tickers are ranked in two stages.
    """
    start = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    recent = posts.where(F.col("created_at") >= start).select(F.col("id").alias("post_id"), "created_at", "engagement")
    base = scores.where((F.col("model") == base_model) & F.col("score").isNotNull()).groupBy("post_id", "ticker").agg(F.max(F.struct("scored_at", "score")).alias("s")).select("post_id", "ticker", F.col("s.score").alias("score"))
    rows = recent.join(tickers.select("post_id", "ticker").distinct(), "post_id").join(base, ["post_id", "ticker"]).withColumn("week", F.date_trunc("WEEK", "created_at"))
    order = [F.col("engagement").desc_nulls_last(), F.col("post_id")]
    salted = rows.withColumn("s", F.pmod(F.xxhash64("post_id"), F.lit(salts)))
    first = salted.withColumn("r", F.row_number().over(W.partitionBy("ticker", "week", "s").orderBy(*order)))
    top = first.where(F.col("r") <= top_k).withColumn("r", F.row_number().over(W.partitionBy("ticker", "week").orderBy(*order))).where(F.col("r") <= top_k).select("post_id", "ticker", F.lit(True).alias("top"))
    done = scores.where(F.col("model") == own_model).select("post_id", "ticker").distinct()
    marked = rows.join(top, ["post_id", "ticker"], "left").withColumn("top", F.coalesce("top", F.lit(False)))
    picked = marked.where(F.col("top") | (F.abs("score") < doubt)).join(done, ["post_id", "ticker"], "left_anti")
    return picked.orderBy(F.col("top").desc(), F.col("engagement").desc_nulls_last(), "post_id", "ticker").limit(limit).select("post_id", "ticker", "score", "engagement", "top")


def entity_patterns(tickers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(ticker, pattern): a regular expression for sentences that name the ticker, with or without $ in any case, or one of its
    aliases (alias, ticker, exact) as whole words. An entity has few aliases, so they are gathered by ticker."""
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.regexp_replace(c, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))
    own = tickers.select("ticker").where(F.col("ticker").isNotNull()).distinct()
    symbol = F.concat(F.lit(r"(?i)(?<![\w$])\$?"), quoted(F.col("ticker")), F.lit(r"(?!\w)"))
    if aliases is None:
        return own.select("ticker", F.concat(F.lit("(?U)"), symbol).alias("pattern"))
    flag = F.when(F.coalesce("exact", F.lit(False)), "(?-i)").otherwise("(?i)")
    each = aliases.where(F.trim("alias") != "").select("ticker", F.concat(flag, F.lit(r"(?<![\w&-])"), quoted(F.trim("alias")), F.lit(r"(?![\w&-])")).alias("a"))
    named = each.groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("a")), "|").alias("others"))
    return own.join(named, "ticker", "left").select("ticker", F.concat(F.lit("(?U)"), symbol, F.coalesce(F.concat(F.lit("|"), "others"), F.lit(""))).alias("pattern"))


def score_pending(posts: DataFrame, tickers: DataFrame, scores: DataFrame, scorer: Scorer, now: datetime, aliases: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """New rows of the score table for every pair the scorer hasn't scored.

    A post with several pairs to score is scored for each ticker by the sentences that name it (all its text when none does), cut
    to ``max_chars`` characters if the model reads no more; each distinct text is scored once.
    """
    todo = pairs_to_score(posts, tickers, scores, scorer.name)
    patterns = scratch.materialize(entity_patterns(todo, aliases), "patterns")
    todo = scratch.join_checked(todo, patterns, ["ticker"], "left", "post_id")
    todo = todo.withColumn("_tm_text", context_text(F.col("title"), F.col("body"), F.col("pattern"), F.col("n_tickers"), max_chars)).drop("pattern")
    scored = score_texts(todo, "_tm_text", scorer)
    return scored.select("post_id", "ticker", F.lit(scorer.name).alias("model"), "label", "score", F.lit(now).cast("timestamp_ntz").alias("scored_at"))


def run_second_pass(posts: DataFrame, tickers: DataFrame, scores: DataFrame, base_model: str, scorer: Scorer, now: datetime, aliases: DataFrame | None = None, max_chars: int | None = None, **selection) -> DataFrame:
    """New rows of the score table for the pairs that :func:`second_pass` picks, scored by ``scorer`` under its own name."""
    picked = scratch.materialize(second_pass(posts, tickers, scores, base_model, scorer.name, now, **selection).select("post_id", "ticker"), "picked")
    mine = tickers.join(picked, ["post_id", "ticker"], "left_semi")
    return score_pending(posts, mine, scores, scorer, now, aliases, max_chars)

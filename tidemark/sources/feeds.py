"""Feeds of discussion records: bulk news files, company news, message streams, forum listings.

Every reader gives rows of the posts schema plus ``source_tickers`` (array) and ``source_sentiment`` (-1, 1 or NULL).
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.calendar import age_in_dates, age_in_days, from_epoch_seconds, from_iso, from_stamp, quarter_hours
from tidemark.functions.text import author_hash, content_hash, mentions_name, org_key, unescape_html

COLUMNS = ["id", "source", "community", "author_id", "author_age_days", "author_karma", "created_at", "collected_at", "title", "body", "url", "engagement", "content_hash", "source_tickers", "source_sentiment"]


def _post(rows: DataFrame, now: datetime, **columns: Column) -> DataFrame:
    none = {"community": "string", "author_id": "string", "author_age_days": "int", "author_karma": "int", "title": "string", "body": "string", "url": "string", "engagement": "int", "source_tickers": "array<string>", "source_sentiment": "int"}
    columns = {k: F.lit(None).cast(kind) for k, kind in none.items()} | columns
    out = rows.select(*[c.alias(k) for k, c in columns.items()], F.lit(now).cast("timestamp_ntz").alias("collected_at"))
    return out.withColumn("content_hash", content_hash(F.col("title"), F.col("body"))).select(COLUMNS)


# -- bulk news files -----------------------------------------------------------------------------------------------


def expected_stamps(spark: SparkSession, start: datetime, end: datetime) -> DataFrame:
    """(stamp): the quarter hours of [start, end)."""
    return spark.range(1).select(F.explode(quarter_hours(start, end)).alias("stamp"))


def pending_stamps(spark: SparkSession, ledger: DataFrame, since: datetime, now: datetime, give_up: timedelta = timedelta(hours=48), per_hour: int = 4) -> DataFrame:
    """Stamps still to be read: those of the window that the ledger doesn't have as done; a share of each hour if asked.

    With an empty ledger the window begins at ``since``, else also ``give_up`` before now, if that is earlier. It ends a
    quarter of an hour before now, since the newest file isn't there yet.
    """
    start = since if ledger.isEmpty() else min(since, now - give_up)
    stamps = expected_stamps(spark, start, now - timedelta(minutes=15)).where((F.substring("stamp", 11, 2).cast("int") / 15).cast("int") < per_hour)
    return stamps.join(ledger.where(F.col("status") == "done").select("stamp"), "stamp", "left_anti")


def _unzip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for content in frame["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                lines = z.read(z.namelist()[0]).decode("utf-8", "replace").split("\n")
            yield pd.DataFrame({"value": lines})


def read_bulk_news(spark: SparkSession, path: str, zipped: bool = False) -> DataFrame:
    """(stamp, domain, url, orgs, extras) of tab-separated files without quoting; rows of 26 fields or fewer are dropped."""
    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_unzip, "value string") if zipped else spark.read.text(path)
    f = F.split("value", "\t", -1)
    return lines.where(F.size(f) > 26).select(f[1].alias("stamp"), f[3].alias("domain"), f[4].alias("url"), f[13].alias("orgs"), F.regexp_replace(f[26], "\r$", "").alias("extras"))


def org_tickers(universe: DataFrame, aliases: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(org, ticker): the names by which organisations are known, in lower case, each of one ticker.

    ``universe``: ticker, company_name, liquidity; of listings that share a name the most liquid one has it (then the least
    ticker). Names of fewer than ``least`` characters don't count. An alias (alias, ticker) of a ticker of the universe comes before names; of
    several tickers the least has it.
    """
    listed = universe.where(F.col("ticker").isNotNull())
    order = lambda part, liquidity: F.struct(F.lit(part).alias("part"), (-F.coalesce(liquidity, F.lit(float("-inf")))).alias("less"), "ticker")
    rows = listed.select(org_key(F.col("company_name"), least).alias("org"), order(1, F.nanvl(F.col("liquidity").cast("double"), F.lit(None))).alias("o"))
    if aliases is not None:
        known = aliases.join(listed.select("ticker").distinct(), "ticker", "left_semi")
        rows = rows.unionByName(known.select(F.lower(F.trim("alias")).alias("org"), order(0, F.lit(0.0)).alias("o")))
    return rows.where(F.col("org") != "").groupBy("org").agg(F.min("o").alias("o")).select("org", "o.ticker")


def bulk_news_posts(rows: DataFrame, orgs: DataFrame, keys: DataFrame, now: datetime, min_title: int = 20, excluded: list[str] | None = None) -> DataFrame:
    """Posts of bulk news rows whose organisations match a ticker that the headline names.

    ``orgs``: (org, ticker), materialised; ``keys``: (ticker, keys) as arrays of names, materialised; organisations in ``excluded`` (any case) don't count. The headline and the
    precise time are read from the extras; without the latter the file's time counts. One post per url, with all its tickers.
    """
    url_id = F.concat(F.lit("news:bulk:"), F.substring(F.sha1("url"), 1, 20))
    tag = lambda name: F.nullif(F.regexp_extract("extras", f"<{name}>(.*?)</{name}>", 1), F.lit(""))
    base = rows.select("url", "domain", "orgs", "stamp", url_id.alias("id"), tag("PAGE_TITLE").alias("raw"), tag("PAGE_PRECISEPUBTIMESTAMP").alias("exact"))
    base = base.withColumn("title", F.trim(unescape_html("raw"))).where(F.length("title") >= min_title)
    base = base.withColumn("created_at", F.coalesce(from_stamp(F.col("exact")), from_stamp(F.col("stamp")))).where(F.col("created_at").isNotNull())
    named = base.withColumn("org", F.explode(F.array_distinct(F.transform(F.split("orgs", ";"), lambda o: F.trim(o)))))
    named = named.where((F.col("org") != "") & ~F.col("org").isin([x.lower() for x in excluded or []])) if excluded else named.where(F.col("org") != "")
    named = scratch.join_checked(scratch.join_checked(named, orgs, ["org"], "inner", "id"), keys, ["ticker"], "left", "id")
    sure = named.where(mentions_name(F.col("ticker"), F.col("title"), F.lit(None).cast("string"), F.col("keys")))
    per = sure.groupBy("id").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.min(F.struct("created_at", "title", "domain", "url")).alias("r"))
    return _post(per, now, id=F.col("id"), source=F.lit("news"), community=F.col("r.domain"), author_id=author_hash(F.concat(F.lit("news:"), F.col("r.domain"))), created_at=F.col("r.created_at"), title=F.col("r.title"), url=F.col("r.url"), source_tickers=F.col("tickers"))


# -- JSON feeds ----------------------------------------------------------------------------------------------------

NEWS = "map<string, array<struct<datetime: bigint, headline: string, id: bigint, related: string, source: string, summary: string, url: string>>>"
MESSAGES = "map<string, struct<messages: array<struct<id: bigint, body: string, created_at: string, user: struct<id: bigint, username: string, join_date: string, followers: int>, symbols: array<struct<symbol: string>>, entities: struct<sentiment: struct<basic: string>>, likes: struct<total: int>, conversation: struct<replies: int>>>>>"
FORUM = "struct<collected_at: bigint, authors: map<string, struct<created_utc: double, link_karma: int, comment_karma: int, suspended: boolean>>, subreddits: map<string, array<struct<id: string, title: string, selftext: string, author: string, created_utc: double, score: int, num_comments: int, permalink: string>>>>"


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("j")).where(F.col("j").isNotNull())


def company_news_posts(spark: SparkSession, path: str, since: datetime, now: datetime) -> DataFrame:
    """Posts of company news by ticker: items without headline, time or id and those before ``since`` are dropped.

    An item listed under several tickers is one post with the fields of its first listing (by ticker) and the tags of all.
    """
    items = _documents(spark, path, NEWS).select(F.explode("j").alias("asked", "items")).select("asked", F.explode("items").alias("i")).select("asked", "i.*")
    rows = items.withColumn("created_at", from_epoch_seconds(F.col("datetime"))).where(F.col("id").isNotNull() & (F.trim("headline") != "") & (F.col("created_at") >= F.lit(since).cast("timestamp_ntz")))
    tags = F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda t: F.upper(F.trim(t)))
    rows = rows.withColumn("tags", F.filter(F.array_union(tags, F.array("asked")), lambda t: t != ""))
    per = rows.groupBy("id").agg(F.min(F.struct("asked", "headline", "summary", "source", "url", "created_at")).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    return _post(per, now, id=F.concat(F.lit("news:"), F.col("id").cast("string")), source=F.lit("news"), community=F.col("r.source"), author_id=author_hash(F.concat(F.lit("news:"), F.col("r.source"))), created_at=F.col("r.created_at"), title=F.col("r.headline"), body=F.nullif(F.col("r.summary"), F.lit("")), url=F.col("r.url"), source_tickers=F.col("tags"))


def message_posts(spark: SparkSession, path: str, since: datetime, now: datetime) -> DataFrame:
    """Posts of paged message streams since a time: engagement is likes and replies, a stated mood is +1 or -1; one per id."""
    pages = _documents(spark, path, MESSAGES).select(F.explode("j").alias("page", "p")).select("page", F.explode("p.messages").alias("m")).select("page", "m.*")
    rows = pages.withColumn("at", from_iso(F.col("created_at"))).where(F.col("id").isNotNull() & (F.col("at") >= F.lit(since).cast("timestamp_ntz")))
    mood = F.try_element_at(F.create_map(F.lit("Bullish"), F.lit(1), F.lit("Bearish"), F.lit(-1)), F.col("entities.sentiment.basic"))
    per = rows.groupBy("id").agg(F.min_by(F.struct("body", "at", "user", "symbols", mood.alias("mood"), "likes", "conversation"), F.col("page")).alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return _post(
        per, now, id=F.concat(F.lit("stocktwits:"), F.col("id").cast("string")), source=F.lit("stocktwits"), author_id=author_hash(F.concat(F.lit("stocktwits:"), F.col("r.user.username"))),
        author_age_days=age_in_dates(F.try_to_date("r.user.join_date"), F.lit(now).cast("timestamp_ntz")), author_karma=F.col("r.user.followers"), created_at=F.col("r.at"), body=F.col("r.body"),
        engagement=zero("r.likes.total") + zero("r.conversation.replies"), source_tickers=F.array_sort(F.array_distinct(F.transform("r.symbols", lambda s: F.upper(s["symbol"])))), source_sentiment=F.col("r.mood"),
    )


def forum_posts(spark: SparkSession, path: str, since: datetime, now: datetime, excluded: list[str] | None = None) -> DataFrame:
    """Posts of forum listings since a time, authors in ``excluded`` (any case) left out; one per id.

    Engagement is score and comments; an empty body is NULL; deleted or suspended authors have no age and karma.
    """
    doc = _documents(spark, path, FORUM)
    people = doc.select(F.explode("j.authors").alias("author", "a")).groupBy("author").agg(F.max("a").alias("a"))
    rows = doc.select(F.explode("j.subreddits").alias("community", "s")).select("community", F.explode("s").alias("s")).select("community", "s.*")
    rows = rows.withColumn("at", from_epoch_seconds(F.col("created_utc"))).where(F.col("id").isNotNull() & (F.col("at") >= F.lit(since).cast("timestamp_ntz")) & ~F.lower(F.coalesce("author", F.lit(""))).isin([x.lower() for x in excluded or []]))
    per = rows.groupBy("id").agg(F.min(F.struct("community", "at", "title", "selftext", "author", "score", "num_comments", "permalink")).alias("r")).withColumn("author", F.col("r.author")).join(people, "author", "left")
    known = F.col("a").isNotNull() & ~F.coalesce("a.suspended", F.lit(False))
    return _post(
        per, now, id=F.concat(F.lit("reddit:"), F.col("id")), source=F.lit("reddit"), community=F.col("r.community"), author_id=author_hash(F.col("author")),
        author_age_days=F.when(known, age_in_days(from_epoch_seconds(F.col("a.created_utc")), F.lit(now).cast("timestamp_ntz"))), author_karma=F.when(known, F.col("a.link_karma") + F.col("a.comment_karma")),
        created_at=F.col("r.at"), title=F.col("r.title"), body=F.nullif(F.col("r.selftext"), F.lit("")), url=F.col("r.permalink"), engagement=F.coalesce("r.score", F.lit(0)) + F.coalesce("r.num_comments", F.lit(0)),
    )

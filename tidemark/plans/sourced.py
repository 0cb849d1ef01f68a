"""Registered queries of the sources: files of each outside format are made from the tables in the shared folder and read back."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.keys import canonical_ticker, table
from tidemark.operators import market
from tidemark.operators.sinks import Store
from tidemark.plans import queries as q
from tidemark.sources import feeds, filings, listings
from tidemark.streaming import ingest

# Parameters of the queries: fixed values.
SINCE, NOW = datetime(2025, 3, 1), datetime(2025, 8, 1)
#: Posts to a document of the forum listings.
PAGE_POSTS = 5_000


def _text(df: DataFrame, name: str) -> str:
    path = scratch.new_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _listing(df: DataFrame, columns: list[str]) -> str:
    path = scratch.new_path(df.sparkSession, "listing")
    df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]).write.option("sep", "|").option("header", True).option("quote", "").csv(path)
    return path


def parsed_listings(spark, sf_dir):
    """Companies as two listing files, some as warrants, test issues or funds; the first file wins."""
    rows = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("t"), F.coalesce("company_name", F.lit("")).alias("n")).withColumn("k", F.length("n") % 5)
    name = F.concat("n", F.when(F.col("k") == 1, " - Warrant").when(F.col("k") == 2, " Class A Common Stock").otherwise(" - Common Stock"))
    flag = lambda k: F.when(F.col("k") == k, "Y").otherwise("N")
    first = rows.where(F.length("t") == 5).withColumns({"Symbol": F.col("t"), "Security Name": name, "Market Category": F.lit("Q"), "Test Issue": flag(3), "Financial Status": F.lit("N"), "Round Lot Size": F.lit("100"), "ETF": flag(4), "NextShares": F.lit("N")})
    code = F.element_at(F.array(F.lit("N"), F.lit("A"), F.lit("P")), (F.ascii("t") % 3 + 1).cast("int"))
    other = rows.withColumns({"ACT Symbol": F.col("t"), "Security Name": F.concat("n", F.lit(" Ordinary Shares")), "Exchange": code, "CQS Symbol": F.col("t"), "ETF": F.lit("N"), "Round Lot Size": F.lit("100"), "Test Issue": F.lit("N"), "NASDAQ Symbol": F.col("t")})
    a = _listing(first, ["Symbol", "Security Name", "Market Category", "Test Issue", "Financial Status", "Round Lot Size", "ETF", "NextShares"])
    b = _listing(other, ["ACT Symbol", "Security Name", "Exchange", "CQS Symbol", "ETF", "Round Lot Size", "Test Issue", "NASDAQ Symbol"])
    return listings.all_listings(listings.read_listed(spark, a), listings.read_other_listed(spark, b))


def liquid_universe(spark, sf_dir):
    """All tickers with their dollar volume; market caps only of those above a floor."""
    rows = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"), "company_name", "exchange", "market_cap")
    out = listings.attach_liquidity(rows.drop("market_cap"), market.mean_dollar_volume(q.bars_now(spark, sf_dir)), rows.select("ticker", "market_cap"), 1e7)
    return out.select("ticker", F.round("avg_dollar_volume_30d", 2).alias("avg_dollar_volume_30d"), "market_cap")


def _news(spark, sf_dir) -> DataFrame:
    """News posts with their tickers and companies, titles on one line and the company's name before each third."""
    names = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"), "company_name")
    posts = q.posts_now(spark, sf_dir).where((F.col("source") == "news") & F.col("title").isNotNull())
    rows = posts.join(q.tickers_now(spark, sf_dir), F.col("post_id") == F.col("id")).join(names, "ticker")
    title = F.trim(F.regexp_replace("title", r"[\s\p{Z}]+", " "))
    return rows.withColumn("title", F.when(F.length("id") % 3 == F.ascii(F.substring("id", -1, 1)) % 3, F.concat("company_name", F.lit(" & "), title)).otherwise(title))


def bulk_news(spark, sf_dir):
    """News as tab-separated lines that name the organisation; posts are those whose headline names the company."""
    org = feeds.org_tickers(table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"), "company_name", F.col("avg_dollar_volume_30d").alias("liquidity")))
    orgs = scratch.materialize(org, "orgs")
    rows = _news(spark, sf_dir).join(orgs, "ticker")
    escaped = F.regexp_replace(F.regexp_replace("title", "&", "&amp;"), "<", "&lt;")
    blank = lambda n: [F.lit("")] * n
    stamp = F.date_format("created_at", "yyyyMMddHHmmss")
    exact = F.when(F.second("created_at") % 2 == 0, F.concat(F.lit("<PAGE_PRECISEPUBTIMESTAMP>"), F.date_format(F.date_trunc("MINUTE", "created_at"), "yyyyMMddHHmmss"), F.lit("</PAGE_PRECISEPUBTIMESTAMP>"))).otherwise("")
    fields = [F.lit("1"), stamp, F.lit("1"), F.lit("news.example"), F.concat(F.lit("u/"), F.col("id")), *blank(8), F.concat(F.lit("someone;"), F.col("org")), *blank(12), F.concat(F.lit("<PAGE_TITLE>"), escaped, F.lit("</PAGE_TITLE>"), exact)]
    path = _text(rows.select(F.array_join(F.array(*fields), "\t").alias("value")), "bulk")
    made = feeds.bulk_news_posts(feeds.read_bulk_news(spark, path), orgs, scratch.materialize(q.name_forms(spark, sf_dir), "keys"), NOW)
    return made.select("url", "title", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.array_join("source_tickers", ",").alias("tickers"))


def company_news(spark, sf_dir):
    """News as JSON by ticker; items since March, each once with all its tickers."""
    item = F.struct(F.unix_seconds(F.col("created_at").cast("timestamp")).alias("datetime"), F.col("title").alias("headline"), F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("long").alias("id"), F.lit("").alias("related"), F.lit("Wire").alias("source"), F.lit("").alias("summary"), F.col("id").alias("url"))
    rows = _news(spark, sf_dir).withColumn("title", F.col("id"))
    path = _text(rows.select(F.to_json(F.create_map("ticker", F.array(item))).alias("value")).repartition(40), "news")
    made = feeds.company_news_posts(spark, _lines(spark, path), SINCE, NOW)
    return made.select("url", "title", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created_s"), F.array_join("source_tickers", ",").alias("tickers"))


def _lines(spark, path: str) -> str:
    """One file a line, as the JSON readers take a document a file."""
    out = scratch.new_path(spark, "documents")
    spark.read.text(path).withColumn("k", F.abs(F.xxhash64("value")) % 40).groupBy("k").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.expr("substring(value, 2, length(value) - 2)")))).alias("v")).select("k", F.concat(F.lit("{"), F.col("v"), F.lit("}")).alias("value")).repartition(40, "k").write.partitionBy("k").text(out)
    return f"{out}/*"


def parsed_filings(spark, sf_dir):
    """Filings as columnar lists by company, in a folder, read back with the companies' tickers."""
    rows = q.filings_now(spark, sf_dir).withColumn("cik", F.abs(F.hash("ticker") % 1_000_000)).where(F.col("filing_date").isNotNull())
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    at = F.coalesce(F.date_format("accepted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))
    one = F.sort_array(F.collect_list(F.struct("accession", text("form").alias("form"), F.date_format("filing_date", "yyyy-MM-dd").alias("day"), at.alias("at"), text("items").alias("items"))))
    lists = rows.groupBy("cik").agg(one.alias("r"))
    recent = F.struct(F.col("r.form").alias("form"), F.col("r.accession").alias("accessionNumber"), F.col("r.day").alias("filingDate"), F.col("r.at").alias("acceptanceDateTime"), F.col("r.items").alias("items"))
    path = scratch.new_path(spark, "submissions")
    # One folder a company; its number ends the name of the folder.
    lists.select("cik", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("value")).repartition(20, "cik").write.partitionBy("cik").text(path)
    companies = rows.groupBy("cik").agg(F.min("ticker").alias("ticker"))
    made = filings.read_submissions_folder(spark, f"{path}/*", companies, q.FORMS, date(2025, 2, 1), date(2025, 5, 31), r"cik=(\d+)")
    return made.select("accession", "form", F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"), F.unix_millis(F.col("accepted_at").cast("timestamp")).alias("accepted_ms"), "items")


def _number(ident: str):
    return F.conv(F.substring(F.md5(ident), 1, 12), 16, 10).cast("long")


def message_stream(spark, sf_dir):
    """Messages as pages of a stream, with moods, likes, replies and accounts; those since March."""
    posts = q.posts_now(spark, sf_dir).where((F.col("source") == "stocktwits") & F.col("body").isNotNull()).select("id", "body", "created_at", "author_id", "author_karma", "engagement", _number("id").alias("n"))
    tags = q.tickers_now(spark, sf_dir).groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct(F.lower("ticker").alias("symbol")))).alias("symbols"))
    joined = F.date_format(F.date_sub(F.to_date("created_at"), 10), "yyyy-MM-dd")
    mood = F.when(F.col("n") % 3 == 0, "Bullish").when(F.col("n") % 3 == 1, "Bearish")
    message = F.struct(
        F.col("n").alias("id"), "body", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.struct(F.lit(1).alias("id"), F.col("author_id").alias("username"), joined.alias("join_date"), F.col("author_karma").alias("followers")).alias("user"),
        "symbols", F.struct(F.struct(mood.alias("basic")).alias("sentiment")).alias("entities"), F.struct(F.col("engagement").alias("total")).alias("likes"), F.struct(F.lit(2).alias("replies")).alias("conversation"),
    )
    rows = posts.join(tags, F.col("post_id") == F.col("id"), "left")
    path = _text(rows.select(F.to_json(F.create_map("id", F.struct(F.array(message).alias("messages")))).alias("value")), "stream")
    made = feeds.message_posts(spark, _lines(spark, path), SINCE, NOW)
    return made.select("id", "body", "engagement", "author_age_days", "author_karma", F.array_join("source_tickers", ",").alias("tickers"), F.col("source_sentiment").alias("mood"))


def forum_listing(spark, sf_dir):
    """Forum posts as listings by community with their authors' accounts; one author is left out, suspended ones have no karma."""
    posts = q.posts_now(spark, sf_dir).where((F.col("source") == "reddit") & F.col("title").isNotNull()).select("id", "title", F.coalesce("body", F.lit("")).alias("body"), "created_at", "author_id", F.coalesce("community", F.lit("none")).alias("community"), F.coalesce("engagement", F.lit(0)).alias("e"))
    seconds = F.unix_seconds(F.col("created_at").cast("timestamp"))
    sub = F.struct("id", "title", F.col("body").alias("selftext"), F.col("author_id").alias("author"), seconds.cast("double").alias("created_utc"), F.col("e").alias("score"), F.lit(1).alias("num_comments"), F.concat(F.lit("/"), F.col("id")).alias("permalink"))
    person = F.struct(F.lit(1.7e9).alias("created_utc"), F.length("author_id").alias("link_karma"), F.lit(5).alias("comment_karma"), (F.length("author_id") % 4 == 0).alias("suspended"))
    # A document is a page of posts of any communities: neither do documents grow with the table, nor is there one for each community.
    kept = scratch.materialize(posts, "forum-posts")
    posts = kept.withColumn("page", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-kept.count() // PAGE_POSTS)))))
    lists = posts.groupBy("page", "community").agg(F.array_sort(F.collect_list(sub)).alias("s")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("community", "s"))).alias("s"))
    people = posts.where(F.col("author_id").isNotNull()).groupBy("page").agg(F.map_from_entries(F.collect_set(F.struct("author_id", person))).alias("a"))
    doc = F.struct(F.lit(0).cast("long").alias("collected_at"), F.col("a").alias("authors"), F.col("s").alias("subreddits"))
    out = scratch.new_path(spark, "forum")
    lists.join(people, "page", "left").select("page", F.to_json(doc).alias("value")).repartition(20, "page").write.partitionBy("page").option("compression", "gzip").text(out)
    scratch.release(kept)
    scratch.tidy(spark)
    made = feeds.forum_posts(spark, f"{out}/*", SINCE, NOW, ["U1", "automod"])
    return made.select("id", "title", "community", "engagement", "author_karma", "author_age_days", F.col("body").isNull().alias("bodyless"))


def parsed_reports(spark, sf_dir):
    """Transaction reports as XML, made from the bars of each ticker: purchases by file, files without any included."""
    bars = q.bars_now(spark, sf_dir).where(F.col("date") < F.lit(date(2025, 3, 1)))
    number = lambda name, value: F.concat(F.lit(f"<{name}><value>"), value, F.lit(f"</value></{name}>"))
    code = F.when(F.col("volume") % 3 == 0, "P").otherwise("S")
    price = F.when(F.col("volume") % 5 == 0, "").otherwise(F.floor("close").cast("string"))
    transaction = F.concat(
        F.lit("<nonDerivativeTransaction><transactionCoding><transactionCode>"), code, F.lit("</transactionCode></transactionCoding><transactionAmounts>"), number("transactionShares", F.dayofmonth("date").cast("string")), number("transactionPricePerShare", price),
        number("transactionAcquiredDisposedCode", F.when(F.col("volume") % 2 == 0, "A").otherwise("D")), F.lit("</transactionAmounts></nonDerivativeTransaction>"),
    )
    files = bars.where(F.col("volume").isNotNull()).groupBy("ticker").agg(F.array_join(F.collect_list(transaction), "").alias("t"))
    names = table(spark, sf_dir, "ticker_universe").select(canonical_ticker("ticker").alias("ticker"))
    path = scratch.new_path(spark, "reports")
    names.join(files, "ticker", "left").select("ticker", F.concat(F.lit("<ownershipDocument>"), F.coalesce("t", F.lit("")), F.lit("</ownershipDocument>")).alias("value")).repartition(20, "ticker").write.partitionBy("ticker").text(path)
    return filings.read_purchases(spark, f"{path}/*").select(F.regexp_extract("path", r"ticker=([^/]+)/", 1).alias("ticker"), "purchase_count", "purchase_value")


def pending_files(spark, sf_dir):
    """Quarter hours of three days that a ledger made from the posts' times doesn't have as done."""
    stamp = F.date_format(F.timestamp_seconds(F.floor(F.unix_seconds(F.col("created_at").cast("timestamp")) / 900) * 900), "yyyyMMddHHmmss").alias("stamp")
    ledger = q.posts_now(spark, sf_dir).groupBy(stamp).agg(F.when(F.max("engagement") > 5, "done").otherwise("missing").alias("status"))
    return feeds.pending_stamps(spark, ledger, datetime(2025, 5, 14), datetime(2025, 5, 15, 7, 40), per_hour=3)


def stream_upserted(spark, sf_dir):
    """The posts table as a stream of files, upserted by micro-batch."""
    store = Store(spark, scratch.new_path(spark, "store"), buckets=4)
    ingest.upsert_stream(ingest.posts_stream(spark, f"{sf_dir}/posts[.]parquet"), store, scratch.new_path(spark, "stream")).awaitTermination()
    return store.read("posts").select("id", "engagement", "content_hash")


def stream_weekly_counts(spark, sf_dir):
    """Rows and engagement by week and source of the weeks that the watermark has passed."""
    counts = ingest.weekly_counts(ingest.posts_stream(spark, f"{sf_dir}/posts[.]parquet"), ["source"])
    out = scratch.new_path(spark, "weeks")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).select(F.date_format("week_start", "yyyy-MM-dd").alias("week"), "source", "posts", "engagement")


QUERIES = {f.__name__: f for f in (parsed_listings, liquid_universe, bulk_news, company_news, message_stream, forum_listing, parsed_filings, parsed_reports, pending_files, stream_upserted, stream_weekly_counts)}

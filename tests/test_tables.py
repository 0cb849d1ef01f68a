import json
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import scratch
from tidemark.operators.sinks import Store, report_json, report_table
from tidemark.schemas import KEYS, TABLES, schema
from tidemark.sources import feeds, filings, listings
from tidemark.streaming import ingest

T0 = datetime(2025, 5, 1)
POST = "id string, source string, community string, author_id string, author_age_days int, author_karma int, created_at timestamp_ntz, collected_at timestamp_ntz, title string, body string, url string, engagement int, content_hash string"


def posts(spark, *data):
    return spark.createDataFrame([(i, "reddit", "c", "u", age, karma, T0, at, title, None, None, eng, None) for i, at, title, eng, age, karma in data], POST)


def test_schemas(spark):
    assert set(KEYS) == set(TABLES) and all(set(KEYS[n]) <= set(schema(n).names) for n in TABLES)


def test_upsert_posts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    first = posts(spark, ("1", T0, "a", 5, 10, None), ("2", T0, "b", 6, None, 7), ("2", T0 + timedelta(1), "b", 8, None, 7))
    assert store.upsert_posts(first) == (2, 0)
    again = posts(spark, ("1", T0 + timedelta(2), "changed", None, None, 3), ("3", T0, "c", 1, 1, 1))
    assert store.upsert_posts(again) == (1, 1)
    want = [("1", "a", None, 10, 3, T0), ("2", "b", 8, None, 7, T0 + timedelta(1)), ("3", "c", 1, 1, 1, T0)]
    view = lambda: rows(store.read("posts").select("id", "title", "engagement", "author_age_days", "author_karma", "collected_at"))
    assert view() == want
    assert store.upsert_posts(again) == (0, 2) and view() == want  # a write may be repeated


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_write_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    """Killed after the data, after the staged manifest, or in the rename: all rows stay, and the next write goes on."""
    store = Store(spark, str(tmp_path))
    one = lambda i, eng: posts(spark, (i, T0, "a", eng, 1, 1))
    store.upsert_posts(one("1", 1))
    want = [("1", 1)]
    for n, broken in enumerate(("_publish", "_load", "_fs")):
        with monkeypatch.context() as m:

            class Fails:
                def __getattr__(self, name):
                    if name == "rename":
                        raise OSError("killed")
                    return getattr(store.__dict__["_fs_before"], name)

            store._fs_before = store._fs
            if broken == "_fs":
                m.setattr(store, "_fs", Fails())
            elif broken == "_publish":
                m.setattr(store, "_publish", lambda *x: (_ for _ in ()).throw(OSError("killed")))
            else:
                m.setattr(store, "_commit", lambda *x, **y: (_ for _ in ()).throw(OSError("killed")))
            for write in (lambda: store.upsert_posts(one("1", 50)), lambda: store.replace("posts", one("7", 7)), lambda: store.upsert_posts(one("9", 9))):
                with pytest.raises(OSError):
                    write()
        assert rows(store.read("posts").select("id", "engagement")) == want
        store.upsert_posts(one(f"n{n}", n))
        want = sorted([*want, (f"n{n}", n)])
        assert rows(store.read("posts").select("id", "engagement")) == want
    assert len(list((tmp_path / "posts" / "data").iterdir())) <= 6


def test_a_small_upsert_writes_little(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    many = spark.range(20_000).select(F.format_string("p%06d", "id").alias("id"), F.lit("x").alias("source"), *[F.lit(None).cast("string").alias(c) for c in ("community", "author_id")], *[F.lit(None).cast("int").alias(c) for c in ("author_age_days", "author_karma")], F.lit(T0).cast("timestamp_ntz").alias("created_at"), F.lit(T0).cast("timestamp_ntz").alias("collected_at"), F.sha2(F.col("id").cast("string"), 512).alias("title"), F.sha2((F.col("id") + 1).cast("string"), 512).alias("body"), F.lit(None).cast("string").alias("url"), F.col("id").cast("int").alias("engagement"), F.lit(None).cast("string").alias("content_hash"))
    assert store.upsert_posts(many) == (20_000, 0)
    before = size(tmp_path / "posts" / "data")
    change = many.where("engagement % 100 = 7").withColumn("engagement", F.col("engagement") + 100_000)
    assert store.upsert_posts(change) == (0, 200)
    assert size(tmp_path / "posts" / "data") - before < 0.1 * before
    got = store.read("posts")
    assert got.count() == 20_000 and got.where("engagement >= 100000").count() == 200
    for _ in range(20):  # merged now and then
        store.upsert_posts(change)
    assert store.read("posts").where("engagement >= 100000").count() == 200 and size(tmp_path / "posts" / "data") < 4 * before


def test_insert_replace_and_prices(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    score = lambda *x: spark.createDataFrame([(p, "A", "m", "pos", s, T0) for p, s in x], schema("post_scores"))
    assert store.insert_absent("post_scores", score(("1", 0.1), ("1", 0.1))) == 1
    assert store.insert_absent("post_scores", score(("1", 0.9), ("2", 0.2))) == 1
    assert rows(store.read("post_scores").select("post_id", "score")) == [("1", 0.1), ("2", 0.2)]
    bars = spark.createDataFrame([("A", date(2025, 1, 2), 1.0, 2.5, 1), ("A", date(2025, 1, 2), 2.0, 3.5, 2), ("A", date(2025, 1, 3), None, 1.0, 1)], "ticker string, date date, close double, volume double, n int")
    bars = bars.withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low")})
    store.upsert_prices(bars, F.col("n"))
    assert rows(store.read("prices_daily").select("close", "volume")) == [(2.0, 4)]
    tags = lambda *x: spark.createDataFrame(x, schema("post_tickers"))
    store.replace("post_tickers", tags(("1", "A", "source", 0.9), ("1", "B", "bare", 0.5), ("2", "C", "bare", 0.5)))
    n = store.replace_post_tickers(spark.createDataFrame([("1",)], "post_id string"), tags(("1", "A", "cashtag", 0.95), ("1", "D", "alias", 0.75)))
    assert n == 1 and rows(store.read("post_tickers").select("post_id", "ticker", "match_type")) == [("1", "A", "source"), ("1", "D", "alias"), ("2", "C", "bare")]


def test_source_tags_guard_and_week(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    p = spark.createDataFrame([("1", "stocktwits", -1, ["A", "A", "Z"]), ("2", "news", None, ["A"])], "id string, source string, source_sentiment int, source_tickers array<string>")
    store.add_source_tags(p, 0.9, spark.createDataFrame([("A",)], "ticker string"), F.lit(T0).cast("timestamp_ntz"))
    assert rows(store.read("post_tickers").select("post_id", "ticker")) == [("1", "A"), ("2", "A")]
    assert rows(store.read("post_scores").select("post_id", "model", "label", "score")) == [("1", "stocktwits_tag", "neg", -1.0)]
    uni = spark.createDataFrame([("A", "a", "N", 1.0, None, T0), ("B", "b", "N", 1.0, 2.0, T0)], schema("ticker_universe"))
    store.replace_guarded("ticker_universe", uni, "avg_dollar_volume_30d", 0.5)
    for bad in (uni.limit(0), uni.where("ticker = 'A'")):
        with pytest.raises(ValueError):
            store.replace_guarded("ticker_universe", bad, "avg_dollar_volume_30d", 0.5)
    assert store.read("ticker_universe").count() == 2
    sig = spark.createDataFrame([("A", float("nan"), "")], "ticker string, sentiment double, events string")
    for _ in range(2):
        store.write_week(date(2025, 5, 12), sig)
        store.write_week(date(2025, 5, 19), sig)
    assert rows(store.read("weekly_signals").select("week_start", "sentiment", "events")) == [(date(2025, 5, 12), None, None), (date(2025, 5, 19), None, None)]


def test_reports(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", float("nan"))], "k string, h string, v double")
    assert json.loads(report_json({"x": float("nan"), "t": df}))["t"][1]["v"] is None
    assert rows(report_table(df, "k", "h", ["a", "b"], "v"))[0][:2] == ("s", 1.0)


def test_scratch_join_beyond_the_broadcast_bound(spark):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = scratch.materialize(spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("x")))
    for bound in (100, 2):
        assert sorted(tuple(r) for r in scratch.join_checked(big, small, ["k"], "inner", "v", bound).collect()) == sorted((v % 7, v, v % 7 * 10) for v in range(500) if v % 7 < 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scratch_tables_are_broadcast_only_when_counted(spark):
    """Their files are far under Spark's own threshold, but not so the rows, and sixteen copies of them."""
    big, small = spark.range(1000).withColumn("v", F.col("id")), scratch.materialize(spark.range(500).withColumn("w", F.lit("x")))
    assert "BroadcastHashJoin" not in plan(scratch.join_checked(big, small, ["id"], "inner", "v", 499))
    assert "BroadcastHashJoin" in plan(scratch.join_checked(big, small, ["id"], "inner", "v", 500))
    assert "BroadcastHashJoin" not in plan(big.join(small.groupBy("id").agg(F.max("w").alias("w")), "id"))
    scratch.release(small)


def test_stored_keys_are_broadcast_only_when_counted(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    row = lambda n, label: spark.range(n).select(F.col("id").cast("string").alias("post_id"), F.lit("A").alias("ticker"), F.lit("m").alias("model"), F.lit(label).alias("label"), F.lit(1.0).alias("score"), F.lit(None).cast("timestamp_ntz").alias("scored_at"))
    store.insert_absent("post_scores", row(30, "old"))
    store.upsert("post_scores", row(9, "new"), F.lit(0))
    assert "BroadcastHashJoin" in plan(store.read("post_scores"))
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 8)
    assert "BroadcastHashJoin" not in plan(store.read("post_scores"))
    assert {r.label: r["count"] for r in store.read("post_scores").groupBy("label").count().collect()} == {"new": 9, "old": 21}
    assert store.insert_absent("post_scores", row(40, "last")) == 10


def test_scratch_tables_can_be_cleaned(spark, tmp_path):
    one = scratch.materialize(spark.range(3), path=str(tmp_path / "one"))
    scratch.materialize(spark.range(3), path=str(tmp_path / "two"))
    scratch.release(one)
    assert not (tmp_path / "one").exists() and (tmp_path / "two").exists()
    kept, scratch._written = scratch._written, {str(tmp_path / "two")}
    scratch.clean(spark)
    assert not (tmp_path / "two").exists() and not scratch._written
    scratch._written = kept


def test_each_write_tidies_the_driver(spark, tmp_path, monkeypatch):
    """Shuffle files and broadcast tables of a step that is written go with it; many steps in a row collect seldom."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(scratch, "_tidied", float("-inf"))
    before = full()
    scratch.release(scratch.materialize(spark.range(3)))
    assert full() > before
    monkeypatch.setattr(scratch, "_tidied", float("-inf"))
    before = full()
    scratch.tidy(spark)
    scratch.tidy(spark)
    assert full() - before == 1


def test_listings(spark, tmp_path):
    a, b = tmp_path / "a.txt", tmp_path / "b.txt"
    a.write_text("Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares\nAAA|Alpha Inc. - Common Stock|Q|N|N|100|N|N\nETF1|Fund|Q|N|N|100|Y|N\nTST|Test|Q|Y|N|100|N|N\nAAAW|Alpha - Warrant|Q|N|N|100|N|N\n\nFile Creation Time: 0101|||||||\n")
    b.write_text("ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol\nAAA|Other|N|AAA|N|100|N|AAA\nBR.B|Bravo Class B|A|BR.B|N|100|N|BR.B\nCC|Arca|P|CC|N|100|N|CC\nD$A|Pref|N|D|N|100|N|D\nFile Creation Time: 0101|||||||\n")
    both = listings.all_listings(listings.read_listed(spark, str(a)), listings.read_other_listed(spark, str(b)))
    assert rows(both) == [("AAA", "Alpha Inc.", "NASDAQ"), ("BR.B", "Bravo Class B", "NYSE American")]
    vol = spark.createDataFrame([("AAA", 5.0)], "ticker string, avg_dollar_volume double")
    caps = spark.createDataFrame([("AAA", 1.0), ("BR.B", 2.0)], "ticker string, market_cap double")
    assert rows(listings.attach_liquidity(both, vol, caps, 5.0).select("ticker", "market_cap")) == [("AAA", 1.0), ("BR.B", None)]
    (tmp_path / "al.csv").write_text("alias,ticker,case_sensitive\nAlpha , aaa,0\nBell,BB,1\n")
    assert rows(listings.read_aliases(spark, str(tmp_path / "al.csv"))) == [("Alpha", "AAA", False), ("Bell", "BB", True)]
    (tmp_path / "w.txt").write_text("# head\nall now # rest\n\nIt\n")
    assert rows(listings.read_words(spark, str(tmp_path / "w.txt"))) == [("ALL",), ("IT",), ("NOW",)]


def test_bulk_news(spark, tmp_path):
    def line(url, orgs, extras, n=27):
        f = [""] * n
        f[1], f[3], f[4], f[13] = "20250501120000", "d.example", url, orgs
        f[-1] = extras
        return "\t".join(f)

    text = "\n".join([line("u1", " acme;other;acme", "<PAGE_TITLE>Acme &amp; friends rise</PAGE_TITLE><PAGE_PRECISEPUBTIMESTAMP>20250501113000</PAGE_PRECISEPUBTIMESTAMP>"), line("u2", "acme", "<PAGE_TITLE>Nothing about it at all</PAGE_TITLE>"), line("u3", "acme", "no title"), line("u4", "acme", "x", 20), line("u1", "shared", "<PAGE_TITLE>Acme &amp; friends rise</PAGE_TITLE>")])
    (tmp_path / "a.tsv").write_text(text)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.tsv", text)
    universe = spark.createDataFrame([("AAA", "Acme Corp", 1.0), ("BBB", "Shared Inc", 5.0), ("CCC", "Shared", 9.0), ("DDD", "AT&T-Works", None), ("EEE", "Abc", 3.0), ("FFF", None, 1.0), ("GGG", "Shared Co", float("nan"))], "ticker string, company_name string, liquidity double")
    aliases = spark.createDataFrame([("Acme", "BBB"), ("abc", "EEE"), ("gone", "ZZZ")], "alias string, ticker string")
    assert rows(feeds.org_tickers(universe, aliases)) == [("abc", "EEE"), ("acme", "BBB"), ("at&t-works", "DDD"), ("shared", "CCC")]
    orgs = feeds.org_tickers(universe)
    assert rows(orgs) == [("acme", "AAA"), ("at&t-works", "DDD"), ("shared", "CCC")]
    keys = spark.createDataFrame([("AAA", ["acme"])], "ticker string, keys array<string>")
    for raw in (feeds.read_bulk_news(spark, str(tmp_path / "a.tsv")), feeds.read_bulk_news(spark, str(tmp_path / "a.zip"), zipped=True)):
        assert raw.count() == 4
        (r,) = feeds.bulk_news_posts(raw, orgs, keys, T0, min_title=10).collect()
        assert (r.title, r.created_at, r.source_tickers, r.url) == ("Acme & friends rise", datetime(2025, 5, 1, 11, 30), ["AAA"], "u1")
        assert feeds.bulk_news_posts(raw, orgs, keys, T0, min_title=30).count() == feeds.bulk_news_posts(raw, orgs, keys, T0, min_title=10, excluded=["ACME"]).count() == 0
    ledger = spark.createDataFrame([("20250501000000", "done"), ("20250501001500", "error")], "stamp string, status string")
    assert [r[0] for r in rows(feeds.pending_stamps(spark, ledger, T0, T0 + timedelta(minutes=55), timedelta(0)))] == ["20250501001500", "20250501003000"]  # that of 00:45 isn't there yet


def test_json_feeds(spark, tmp_path):
    at = int((T0 + timedelta(hours=5)).timestamp())
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    item = dict(datetime=at, headline="H", id=7, related="bb, AA", source="S", summary="", url="u")
    path = put("news.json", {"AA": [item, item | dict(id=8, headline=" "), item | dict(id=9, datetime=5)], "CC": [item | dict(headline="other")]})
    (r,) = feeds.company_news_posts(spark, path, T0, T0).collect()
    assert (r.id, r.title, r.body, r.source_tickers, r.engagement) == ("news:7", "H", None, ["AA", "BB", "CC"], None)
    message = dict(id=1, body="b", created_at="2025-05-01T06:00:00Z", user=dict(id=1, username="u", join_date="2025-04-01", followers=3), symbols=[dict(symbol="aa")], entities=dict(sentiment=dict(basic="Bearish")), likes=dict(total=2))
    path = put("stream.json", {"p1": dict(messages=[message, message | dict(id=2, created_at="2024-01-01T00:00:00Z")]), "p2": dict(messages=[message | dict(body="again")])})
    (r,) = feeds.message_posts(spark, path, T0, T0).collect()
    assert (r.id, r.body, r.engagement, r.author_age_days, r.author_karma, r.source_sentiment, r.source_tickers) == ("stocktwits:1", "b", 2, 30, 3, -1, ["AA"])
    sub = dict(id="x", title="T", selftext="", author="Bob", created_utc=at, score=4, num_comments=1, permalink="/p")
    path = put("forum.json", dict(collected_at=at, authors=dict(Bob=dict(created_utc=at - 86400 * 9, link_karma=1, comment_karma=2), Eve=dict(suspended=True)), subreddits=dict(s=[sub, sub | dict(id="y", author="AutoMod"), sub | dict(id="z", author="Eve"), sub | dict(id="w", author=None)])))
    got = {r.id: (r.author_karma, r.author_age_days is None, r.body, r.engagement) for r in feeds.forum_posts(spark, path, T0, T0 + timedelta(days=1), ["automod"]).collect()}
    assert got == {"reddit:x": (3, False, None, 5), "reddit:z": (None, True, None, 5), "reddit:w": (None, True, None, 5)}


def test_forum_documents_have_a_bounded_size(spark, tmp_path, monkeypatch):
    """As many documents as the posts fill, however many communities there are."""
    from tidemark.plans import sourced

    rows = posts(spark, *[(f"p{i}", T0, "t", 1, None, None) for i in range(60)]).withColumn("community", F.concat(F.lit("c"), F.substring("id", -1, 1)))
    rows.write.parquet(str(tmp_path / "posts.parquet"))
    monkeypatch.setattr(sourced, "PAGE_POSTS", 20)
    read, seen = sourced.feeds.forum_posts, []
    monkeypatch.setattr(sourced.feeds, "forum_posts", lambda spark, path, *rest: seen.append(spark.read.option("wholetext", True).text(path).count()) or read(spark, path, *rest))
    got = sourced.forum_listing(spark, str(tmp_path))
    assert got.count() == 60 and seen == [3]


def test_filings(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"0": dict(cik_str=5, ticker="BR-B", title="Bravo")}))
    assert rows(filings.read_symbols(spark, str(tmp_path / "m.json"))) == [("BR.B", 5, "Bravo")]
    recent = dict(form=["8-K", "4", "8-K"], accessionNumber=["1-2-3", "4-5-6", "7-8-9"], filingDate=["2025-05-01", "2025-05-02", "2024-01-01"], acceptanceDateTime=["2025-05-01T10:00:00.000Z"], primaryDocument=["a.htm", "xslF345X05/b.xml", "c"])
    (tmp_path / "s.json").write_text(json.dumps(dict(filings=dict(recent=recent))))
    got = filings.read_submissions(spark, str(tmp_path / "s.json"), 5, "A", ["8-K", "4"], date(2025, 1, 1), date(2025, 12, 31)).orderBy("accession").collect()
    assert [(r.accession, r.accepted_at, r["items"]) for r in got] == [("1-2-3", datetime(2025, 5, 1, 10), None), ("4-5-6", None, None)]
    assert got[1].document_url.endswith("/456/b.xml") and got[0].url.endswith("/123/1-2-3-index.htm")
    one = lambda code, n, p, d="A": f"<nonDerivativeTransaction><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>{n}</value></transactionShares><transactionPricePerShare><value>{p}</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{d}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    (tmp_path / "f.xml").write_text(f"<ownershipDocument>{one('P', 10, 2.5)}{one('P', 'x', 1)}{one('S', 5, 5, 'D')}{one('P', 3, '')}</ownershipDocument>")
    (tmp_path / "g.xml").write_text("<ownershipDocument><issuer>x</issuer></ownershipDocument>")
    read = lambda paths: filings.read_purchases(spark, str(tmp_path / "[fg].xml")).join(paths, "path", "left_semi")
    assert [(r.path[-5:], r.purchase_count, r.purchase_value) for r in filings.read_purchases(spark, str(tmp_path / "[fg].xml")).orderBy("path").collect()] == [("f.xml", 3, 25.0), ("g.xml", 0, 0.0)]
    store = Store(spark, str(tmp_path / "store"))
    at = [r.path for r in filings.read_purchases(spark, str(tmp_path / "[fg].xml")).orderBy("path").collect()]
    reports = spark.createDataFrame([("a1", "AAA", date(2025, 5, 1), at[0]), ("a2", "AAA", date(2025, 5, 2), at[1])], "accession string, ticker string, filing_date date, path string")
    assert filings.update_insider_cache(store, reports.limit(1), read, T0) == 1
    asked = []
    assert filings.update_insider_cache(store, reports, lambda paths: asked.extend(r.path for r in paths.collect()) or read(paths), T0) == 1 and asked == [at[1]]
    assert filings.update_insider_cache(store, reports, None, T0) == 0
    assert rows(store.read("insider_filings").select("accession", "purchase_count")) == [("a1", 3), ("a2", 0)]
    (tmp_path / "lists").mkdir()
    for cik in (5, 6, 7):
        (tmp_path / "lists" / f"CIK00{cik}.json").write_text(json.dumps(dict(filings=dict(recent=recent))))
    many = filings.read_submissions_folder(spark, str(tmp_path / "lists"), spark.createDataFrame([(5, "A"), (5, "AB"), (6, "B")], "cik int, ticker string"), ["8-K"], date(2025, 1, 1), date(2025, 12, 31))
    assert [(r.ticker, r.cik, r.url.split("/")[-3]) for r in many.orderBy("cik").collect()] == [("A", 5, "5"), ("B", 6, "6")]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    posts(spark, ("1", T0, "a", 5, None, None), ("2", T0, "b", 1, None, None)).write.parquet(str(folder / "f1"))
    posts(spark, ("1", T0 + timedelta(1), "a", 9, None, None)).write.parquet(str(folder / "f2"))
    stream = ingest.posts_stream(spark, str(folder / "*"), 1)
    store = Store(spark, str(tmp_path / "store"))
    ingest.upsert_stream(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert rows(store.read("posts").select("id", "title")) == [("1", "a"), ("2", "b")]
    q = ingest.first_copies(stream).writeStream.format("memory").queryName("copies").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("copies").count() == 2
    q = ingest.weekly_counts(stream, ["source"]).writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("weeks")) == [(datetime(2025, 4, 26), "reddit", 3, 15)]



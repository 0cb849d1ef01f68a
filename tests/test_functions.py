import hashlib
import re
from datetime import date, datetime

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions import text as T
from tidemark.functions.calendar import Week, age_in_dates, age_in_days, days_back, friday_of, from_epoch_seconds, from_iso, from_stamp, latest_completed_friday, monday_of, quarter_hours, week_start_of
from tidemark.functions.keys import canonical_ticker, community_key, current_rows, folded
from tidemark.operators.noise import headline_kind


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_keys(spark):
    df = spark.createDataFrame([(" $brk-b ",), ("AAA.C",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(canonical_ticker("t")).collect()] == ["BRK.B", "AAA.C", None, ""]
    df = spark.createDataFrame([(" R/Deep ",), ("r/r/x",), (None,)], "t string")
    assert [tuple(r) for r in df.select(folded("t"), community_key("t")).collect()] == [("r/deep", "deep"), ("r/r/x", "r/x"), (None, None)]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 9, "n")], "k string, at int, v string")
    assert rows(current_rows(df, "k", "at", ["v"])) == [("a", "y")]


def test_week():
    week = Week.ending(date(2025, 5, 16))
    assert (week.start, week.end, week.monday) == (datetime(2025, 5, 10), datetime(2025, 5, 17), date(2025, 5, 12))
    assert Week.latest_completed(datetime(2025, 5, 16, 23)).friday == date(2025, 5, 9)
    assert Week.latest_completed(datetime(2025, 5, 17)).friday == date(2025, 5, 16)
    try:
        Week.ending(date(2025, 5, 15))
        raise AssertionError
    except ValueError:
        pass


def test_calendar_columns(spark):
    ts = lambda *a: F.lit(datetime(*a)).cast("timestamp_ntz")
    assert one(spark, friday_of(ts(2025, 5, 10))) == date(2025, 5, 16) == one(spark, friday_of(ts(2025, 5, 16, 23, 59)))
    assert one(spark, week_start_of(ts(2025, 5, 17))) == date(2025, 5, 19)
    assert one(spark, monday_of(F.lit(date(2025, 5, 18)))) == date(2025, 5, 12)
    assert one(spark, latest_completed_friday(F.lit(date(2025, 5, 16)))) == date(2025, 5, 9)
    end = datetime(2025, 5, 17)
    assert [one(spark, days_back(ts(2025, 5, d), end)) for d in (16, 10)] == [0, 6] and one(spark, days_back(ts(2025, 5, 10), end, parity=True)) == 7
    assert one(spark, from_epoch_seconds(F.lit(0))) == datetime(1970, 1, 1)
    assert one(spark, from_iso(F.lit("2025-01-02T03:04:05Z"))) == datetime(2025, 1, 2, 3, 4, 5) and one(spark, from_iso(F.lit("x"))) is None
    assert one(spark, from_stamp(F.lit("20250102030405"))) == datetime(2025, 1, 2, 3, 4, 5) and one(spark, from_stamp(F.lit("20251"))) is None
    assert one(spark, age_in_days(ts(2025, 1, 1, 12), ts(2025, 1, 3, 11))) == 1 and one(spark, age_in_dates(ts(2025, 1, 1, 12), ts(2025, 1, 3, 11))) == 2
    assert one(spark, quarter_hours(datetime(2025, 1, 1, 0, 1), datetime(2025, 1, 1, 0, 31))) == ["20250101001500", "20250101003000"]
    assert one(spark, quarter_hours(datetime(2025, 1, 1), datetime(2025, 1, 1, 0, 15))) == ["20250101000000"]
    assert one(spark, quarter_hours(datetime(2025, 1, 1, 0, 1), datetime(2025, 1, 1, 0, 2))) == []


def test_hashes(spark):
    assert one(spark, T.content_hash(F.lit(" A  b"), F.lit(None).cast("string"))) == hashlib.sha256(b"a b").hexdigest()
    assert one(spark, T.author_hash(F.lit("Bob"))) == hashlib.sha256(b"bob").hexdigest()[:16]
    assert one(spark, T.author_hash(F.lit(""))) is None


def test_simhash(spark):
    def brute(text, digest):
        w = re.findall(r"[a-z0-9$']+", text.lower())
        if len(w) < 3:
            return None
        v = [0] * 64
        for i in range(len(w) - 2):
            h = int.from_bytes(digest(" ".join(w[i : i + 3]).encode()), "big")
            for b in range(64):
                v[b] += 1 if h >> b & 1 else -1
        x = sum(1 << b for b in range(64) if v[b] > 0)
        return x - 2**64 if x >= 2**63 else x

    texts = ["The quick brown fox can't jump $5", "too short", "", None, "a b c d", "Ünïcode words are split up here"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, digest in (("blake2b", lambda b: hashlib.blake2b(b, digest_size=8).digest()), ("md5", lambda b: hashlib.md5(b).digest()[:8])):
        assert [r[0] for r in df.select(T.simhash(F.col("t"), algorithm=name)).collect()] == [brute(t or "", digest) for t in texts]
    assert one(spark, T.hamming(F.lit(7).cast("long"), F.lit(-1).cast("long"))) == 61
    assert [b.value for b in one(spark, T.band_values(F.lit(-1).cast("long"), 3))] == [65535] * 4


def test_headlines(spark):
    kinds = {"Acme Announces New Plant": "press_release", "3 stocks to buy now": "promo", "Why Acme stock plunged today": "price_recap", "Acme shares could jump 40%": "news", "Acme opens a plant": "news", None: "news"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r[0]: r[1] for r in df.select("t", headline_kind(F.col("t"))).collect()} == kinds
    assert one(spark, headline_kind(F.lit("Plain"), F.lit(" GlobeNewswire "))) == "press_release"
    assert one(spark, T.headline_key(F.lit("Ünder: 5%!"))) == "ünder 5" and one(spark, T.headline_key(F.lit("!!"))) is None


def test_names(spark):
    assert one(spark, T.clean_name(F.lit("Acme Holdings, Inc. Class A Common Stock"))) == "Acme Holdings, Inc."
    assert one(spark, T.clean_name(F.lit("Beta Ltd - Ordinary Shares"))) == "Beta Ltd"
    assert [one(spark, T.is_equity(F.lit(s), F.lit(n))) for s, n in (("A", "A Corp"), ("A$B", "A"), ("W", "A Warrant"), ("U", "A Units"), ("L", "A LP Common Units"))] == [True, False, False, False, True]
    none = F.array().cast("array<string>")
    assert one(spark, T.name_keys(F.lit("Acme Wholesale Corporation"), F.array(F.lit("ACM")))) == ["acm", "acme wholesale", "acme"]
    assert one(spark, T.name_keys(F.lit(None).cast("string"), none)) == []
    assert one(spark, T.org_key(F.lit("The Acme, Inc."))) == "acme" and one(spark, T.org_key(F.lit("Ab Co"))) is None
    about = lambda t, keys: one(spark, T.mentions_name(F.lit("AB.C"), F.lit(t), F.lit(None).cast("string"), F.array(*[F.lit(k) for k in keys]) if keys else none))
    assert [about("buy $AB.C now", []), about("AB.CD", []), about("ABXC", []), about("the Acme way", ["acme"]), about("acmes", ["acme"])] == [True, False, False, True, False]
    assert one(spark, T.unescape_html(F.lit("A &amp; B"))) == "A & B"
    assert one(spark, T.dotted_symbol(F.lit("brk-b"))) == "BRK.B" and one(spark, T.dashed_symbol(F.lit("BRK.B"))) == "BRK-B"


def test_sentences_and_context(spark):
    assert one(spark, T.simple_sentences(F.lit("One. Two!  \n\nThree"))) == ["One.", "Two!", "Three"]
    ctx = lambda n: one(spark, T.context_text(F.lit("Head"), F.lit("AAA is up. BBB is down."), F.lit("AAA"), F.lit(n), 50))
    assert ctx(1).startswith("Head") and ctx(2) == "AAA is up."


def test_items_and_display(spark):
    assert one(spark, T.describe_items(F.lit("2.02, 9.01,6.66"))) == ["Earnings results", "Item 6.66"]
    assert one(spark, T.describe_items(F.lit(None).cast("string"))) == []
    assert one(spark, T.item_groups(T.split_items(F.lit("8.01,4.01,2.02")))) == ["Earnings", "Red flag", "Other"]
    assert [one(spark, T.tone(F.lit(x))) for x in (0.5, 0.1, -0.2)] == ["positive", "neutral", "negative"]
    assert one(spark, T.gauge(F.lit(3.0))) == 100.0 and one(spark, T.percent(F.lit(0.0512))) == "+5.1%"

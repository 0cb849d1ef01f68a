import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark import scratch
from tidemark.operators import noise, signals

SCHEMA = "post_id string, ticker string, source string, community string, engagement int, created_at timestamp_ntz, content_hash string, block int, author_id string, author_age_days int, author_karma int, title string, body string"
T0 = datetime(2025, 5, 1)


def frame(spark, data):
    base = dict(ticker="A", source="reddit", community="c", engagement=1, created_at=T0, content_hash=None, block=0, author_id="u", author_age_days=None, author_karma=None, title=None, body=None)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | x)[n] for n in names) for x in data], SCHEMA)


def ids(df):
    return sorted(r.post_id for r in df.collect())


def test_reposts_and_syndication(spark):
    df = frame(spark, [dict(post_id="1", content_hash="h", created_at=T0 + timedelta(1)), dict(post_id="2", content_hash="h"), dict(post_id="2", content_hash="h", ticker="B"), dict(post_id="3"), dict(post_id="4", content_hash="h")])
    assert ids(noise.drop_reposts(df)) == ["2", "2", "3"]
    df = frame(spark, [dict(post_id=str(n), source=s, title=t) for n, (s, t) in enumerate([("news", "Big News!"), ("news", "big  news"), ("reddit", "big news"), ("news", None), ("news", "!!"), ("news", "??")])])
    assert ids(noise.drop_syndicated(df, ["news"])) == ["0", "2", "3", "4", "5"]
    assert ids(noise.drop_reposts(df.limit(0))) == []


def test_spam(spark):
    df = frame(spark, [dict(post_id="1", title="JOIN OUR Discord"), dict(post_id="2", body="fine"), dict(post_id="3")])
    assert ids(noise.drop_spam(df)) == ["2", "3"] and ids(noise.drop_spam(df, [])) == ["1", "2", "3"]


def test_author_weights_and_caps(spark):
    rules = {"reddit": {"min_age_days": 30, "new_account_weight": 0.25, "min_karma": 100, "low_karma_weight": 0.5}}
    data = [dict(post_id="n", author_age_days=3, author_karma=5), dict(post_id="o", author_age_days=300), dict(post_id="x", source="news", author_age_days=1)] + [dict(post_id=f"b{n}", author_id="bot") for n in range(4)]
    got = {r.post_id: r.author_weight for r in noise.author_weights(frame(spark, data), rules, {"sources": ["reddit"], "max_posts": 3, "weight": 0.1}).collect()}
    assert got == {"n": 0.125, "o": 1.0, "x": 1.0} | {f"b{n}": 0.1 for n in range(4)}
    df = frame(spark, data).withColumn("weight", F.when(F.col("post_id") == "b2", 9.0).otherwise(1.0))
    assert ids(noise.cap_per_author(df, 2, "block", ["reddit"])) == ["b0", "b2", "n", "o", "x"]


def test_weights_and_quality(spark):
    w = noise.post_weight(F.col("engagement"), F.col("source"), F.lit(1.0), F.lit(0.5), {"news": 10}, {"news": 2})
    df = frame(spark, [dict(post_id="1", engagement=None), dict(post_id="2", source="news"), dict(post_id="3", engagement=-4)])
    import math

    assert [round(r[0], 9) for r in df.orderBy("post_id").select(w).collect()] == [0.0, round(math.log1p(10), 9), 0.0]
    df = frame(spark, [dict(post_id="1", source="news", title="3 stocks to buy"), dict(post_id="2", title="3 stocks to buy")])
    got = {r.post_id: (r.news_kind, round(r.quality, 9)) for r in noise.news_quality(df, ["news"], {"promo": 0.3}, 0.3, F.lit(False)).collect()}
    assert got == {"1": ("promo", 0.09), "2": (None, 1.0)}


def greedy(posts, hashes, k):
    kept, out = [], set()
    for p in sorted((p for p in posts if hashes[p[0]] is not None), key=lambda p: (p[1], p[0])):
        if any(bin((hashes[p[0]] ^ h) & (2**64 - 1)).count("1") <= k for h in kept):
            out.add(p[0])
        else:
            kept.append(hashes[p[0]])
    return out


def test_near_duplicates_are_greedy(spark):
    from tidemark.functions.text import simhash

    rng = random.Random(3)
    words = [f"w{n}" for n in range(50)]
    posts = []
    for _ in range(20):
        v = [rng.choice(words) for _ in range(60)]
        for _ in range(4):
            v = list(v)
            v[rng.randrange(60)] = rng.choice(words)
            posts.append((f"p{len(posts):03d}", T0 + timedelta(minutes=rng.randrange(50)), None, " ".join(v)))
    posts += [("short", T0, "a b", None), ("null", T0, None, None)]
    df = spark.createDataFrame(posts, "post_id string, created_at timestamp_ntz, title string, body string")
    hashes = {r.post_id: r.h for r in df.select("post_id", simhash(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))).alias("h")).collect()}
    hashes |= {"short": None, "null": None}
    for k in (3, 12):
        assert {r.post_id for r in noise.near_duplicate_posts(df, k).collect()} == greedy(posts, hashes, k)
    assert noise.drop_near_duplicates(df.withColumn("ticker", F.lit("A")), 3).count() == len(posts) - len(greedy(posts, hashes, 3))
    assert noise.near_duplicate_posts(df.limit(0)).count() == 0


def test_hash_pairs_are_complete(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for _ in range(3):
            x = v
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            values.append(x)
    values = sorted({v - 2**64 if v >= 2**63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in values], "h long")
    want = sorted((a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3)
    assert sorted(tuple(r) for r in noise.similar_hash_pairs(df, "h", 3).collect()) == want


def test_all_filters_in_order(spark):
    import math

    from tidemark.operators import signals

    long = "one two three four five six seven eight nine ten eleven twelve thirteen"
    later = lambda n: T0 + timedelta(minutes=n)
    data = [
        dict(post_id="h1", content_hash="h"), dict(post_id="h2", content_hash="h", author_id="v", created_at=later(1)),  # repost
        dict(post_id="n1", body=long, author_id="w"), dict(post_id="n2", body=long.upper(), author_id="x", created_at=later(1)),  # near copy
        dict(post_id="s", title="join our discord", author_id="y"),  # spam
        dict(post_id="d1", source="news", title="Acme widgets", author_id="o1"), dict(post_id="d2", source="news", title="ACME widgets!", author_id="o2", created_at=later(1)),  # syndicated
        dict(post_id="p", source="news", title="Why Acme stock soared 9%", author_id="o1"),  # recap: weight 0
        dict(post_id="q", source="news", title="3 stocks to buy", author_id="o1"),  # promo, off topic
        dict(post_id="g", author_age_days=2, author_id="z"),  # new account
        *[dict(post_id=f"c{n}", author_id="many", engagement=n) for n in range(1, 5)],  # capped at 2
    ]
    news = {"sources": ["news"], "kind_weights": {"price_recap": 0.0, "promo": 0.3}, "off_topic_weight": 0.3}
    rules = {"reddit": {"min_age_days": 30, "new_account_weight": 0.25, "min_karma": 100, "low_karma_weight": 0.5}}
    keys = spark.createDataFrame([("A", ["acme"])], "ticker string, keys array<string>")
    out = noise.filtered_mentions(frame(spark, data), keys, rules, None, news, {"news": 10.0}, {"news": 2.0}, 2, ["reddit"])
    unit = math.log(2)
    want = {"h1": unit, "n1": unit, "d1": 2 * math.log(11), "q": 0.09 * 2 * math.log(11), "g": 0.25 * unit, "c4": math.log(5), "c3": math.log(4)}
    assert {r.post_id: round(r.weight, 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}
    got = signals.weekly_components(out.withColumn("day", F.lit(0)).withColumn("score", F.lit(1.0))).first()
    assert (got.mentions, got.n_authors) == (7, 5)


def left(spark, made):
    """What ``made`` writes to the scratch folder and leaves there."""
    before = set(scratch._written)
    made()
    return sorted(x.rsplit("/", 1)[-1].split("-")[0] for x in scratch._written - before)


def test_filters_leave_only_their_result(spark):
    """Every step but the last is deleted once it is read, so disk holds no more than two or three steps at a time."""
    data = [{"post_id": f"p{i}", "body": " ".join(f"w{i % 3}x{k}" for k in range(20)), "content_hash": f"h{i}", "author_id": "a", "created_at": T0 + timedelta(hours=i)} for i in range(9)]
    keys = spark.createDataFrame([("A", ["acme"])], "ticker string, keys array<string>")
    news = {"sources": ["news"], "kind_weights": {}, "off_topic_weight": 0.3}
    spread = lambda df: signals.spread_over_weeks(df.drop("block"))
    assert left(spark, lambda: noise.filtered_mentions(frame(spark, data), keys, {}, None, news, {}, {}, 5, None, spread=spread, by=["week_start"])) == ["weighted"]


def test_near_duplicates_leave_only_their_result(spark):
    data = [{"post_id": f"p{i}", "body": " ".join(f"w{i % 3}x{k}" for k in range(20)), "created_at": T0 + timedelta(hours=i)} for i in range(9)]
    found = []
    assert left(spark, lambda: found.append(noise.near_duplicate_posts(frame(spark, data)))) == ["copies"]
    assert {r.post_id for r in found[0].collect()} == {f"p{i}" for i in range(3, 9)}


def test_entries_of_hashes_are_not_broadcast(spark):
    """Twenty rows for each hash, of which Spark knows nothing when it takes the table for a small one."""
    pairs = noise.similar_hash_pairs(spark.sql("SELECT * FROM VALUES (0L), (7L), (15L) AS t(h)"), "h", 3)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert rows(pairs) == [(0, 7), (7, 15)]

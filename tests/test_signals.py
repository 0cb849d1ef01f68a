import math
import random
import statistics
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.calendar import Week
from tidemark.operators import evaluate, market, ranking, scoring, signals

WEEK = Week.ending(date(2025, 5, 16))


def test_effective_scores(spark):
    t = datetime(2025, 1, 1)
    df = spark.createDataFrame([("p", "A", "low", "pos", 0.5, t), ("p", "A", "top", "neg", -0.5, t), ("q", "A", "low", "neu", None, t), ("q", "A", "low", "pos", 0.9, t + timedelta(1)), ("r", "A", "other", "pos", 1.0, t)], "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz")
    assert rows(signals.effective_scores(df, ["top", "low"])) == [("p", "A", "neg", -0.5), ("q", "A", "pos", 0.9)]


def test_attention_known_values(spark):
    data = [("A", d, 2.0) for d in range(7)] + [("A", d, 1.0) for d in range(7, 37, 2)] + [("B", 8, 5.0), ("C", 0, 1000.0)]
    got = dict(rows(signals.attention(spark.createDataFrame(data, "ticker string, day int, weight double"), 7, 30, 1.0, 10.0)))
    assert set(got) == {"A", "C"} and abs(got["A"] - 1.5) < 1e-12 and got["C"] == 10.0


def test_components(spark):
    data = [("A", 0, 0, 1.0, 0.5, "u", "c", "s"), ("A", 1, 0, 3.0, -0.5, "u", None, "s"), ("A", 2, 0, 1.0, None, None, "d", "s"), ("A", 8, 1, 0.0, 0.2, "v", "c", "s"), ("B", 9, 1, 1.0, 0.1, "v", "c", "s")]
    df = spark.createDataFrame(data, "ticker string, day int, block int, weight double, score double, author_id string, community string, source string")
    (r,) = signals.weekly_components(df).collect()
    assert (r.ticker, r.mentions, r.n_authors) == ("A", 3, 1)
    assert abs(r.sentiment + 0.25) < 1e-12 and r.sentiment_prev == 0.2 and abs(r.momentum + 0.45) < 1e-12
    assert abs(r.breadth - (math.log(2) + math.log(3) + math.log(2))) < 1e-12


def test_later_rows_change_nothing(spark):
    posts = spark.createDataFrame([("1", datetime(2025, 5, 16, 23)), ("2", datetime(2025, 5, 17))], "id string, created_at timestamp_ntz")
    tickers = spark.createDataFrame([("1", "A", 0.9), ("2", "A", 0.9), ("1", "B", 0.2)], "post_id string, ticker string, confidence double")
    scores = spark.createDataFrame([], "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz")
    got = signals.load_mentions(posts, tickers, scores, ["m"], WEEK.start, WEEK.end, 0.5)
    assert [(r.post_id, r.ticker, r.score) for r in got.collect()] == [("1", "A", None)]
    assert signals.with_days(got, WEEK).select("day", "block").first() == (0, 0)


def test_zscore_and_composites(spark):
    df = spark.createDataFrame([("w", "A", 1.0), ("w", "B", 3.0), ("w", "C", None), ("x", "A", 0.1), ("x", "B", 0.1), ("y", "A", 4.0)], "w string, t string, v double")
    got = {(r.w, r.t): r.z for r in df.withColumn("z", signals.zscore(F.col("v"), ["w"])).collect()}
    assert got == {("w", "A"): -1.0, ("w", "B"): 1.0, ("w", "C"): 0.0, ("x", "A"): 0.0, ("x", "B"): 0.0, ("y", "A"): 0.0}
    df = spark.createDataFrame([("A", 1.0, 1.0, 0.0, 1.0), ("B", 0.0, -1.0, 0.0, 0.0)], "ticker string, attention_z double, sentiment double, momentum double, breadth double")
    got = {r.ticker: (r.composite_bull, r.composite_bear) for r in signals.composites(df, [], {"attention": 0.5, "sentiment": 0.3, "momentum": 0.1, "breadth": 0.1}).collect()}
    assert {k: tuple(round(x, 9) for x in v) for k, v in got.items()} == {"A": (0.9, 0.3), "B": (-0.9, -0.3)}


def test_ranked_list(spark):
    df = spark.createDataFrame([("A", 1.0, 0.1, 2.0, 0.0), ("B", 1.0, 0.1, 2.0, 0.0), ("C", -1.0, 0.1, 9.0, 0.0), ("D", 1.0, -0.1, 9.0, 1.0)], "ticker string, attention_z double, sentiment double, composite_bull double, composite_bear double")
    assert [(r.ticker, r["rank"]) for r in signals.ranked_list(df, "bull", 5).collect()] == [("A", 1), ("B", 2)]
    assert [(r.ticker, r["rank"]) for r in signals.ranked_list(df, "bear", 5).collect()] == [("D", 1)]


def bars(spark, closes, volumes=None, last=date(2025, 5, 16)):
    n = len(closes)
    return spark.createDataFrame([("A", last - timedelta(days=n - 1 - i), c, (volumes or [100] * n)[i]) for i, c in enumerate(closes)], "ticker string, date date, close double, volume long")


def test_session_context(spark):
    closes = [100.0 + i for i in range(40)]
    r = market.session_context(bars(spark, closes + [999.0], last=date(2025, 5, 17)), WEEK.friday).first()
    assert abs(r.ret_5d - (139 / 134 - 1)) < 1e-12 and abs(r.ret_30d - (139 / 118 - 1)) < 1e-12 and r.rel_volume == 1.0 and r.updown_vol_ratio is None
    r = market.session_context(bars(spark, [2.0, 1.0, 3.0], [5, 10, 40]), WEEK.friday).first()
    assert (r.ret_5d, r.rel_volume, r.updown_vol_ratio) == (None, None, 4.0)


def test_chatter_flags_and_events(spark):
    df = spark.createDataFrame([(f"t{n}", float(n), -float(n), 0.01 if n != 9 else None, 2.0) for n in range(10)], "ticker string, composite_bull double, composite_bear double, ret_5d double, rel_volume double")
    assert [r.ticker for r in market.early_chatter(df, []).where("early_chatter_flag").collect()] == ["t0"]
    filings = spark.createDataFrame([("A", date(2025, 5, 10), 2), ("B", date(2025, 4, 16), 1), ("C", date(2025, 5, 17), 1)], "ticker string, filing_date date, purchase_count int")
    sig = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    assert rows(market.flag_within(sig, filings, WEEK.friday, 30)) == [("A", True), ("B", False), ("C", False)]
    items = spark.createDataFrame([("A", "9.01"), ("B", "4.01,2.02"), ("B", "8.01, 1.03"), ("C", None)], "ticker string, items string")
    assert rows(market.event_labels(items, ["ticker"])) == [("A", None, False), ("B", "Earnings; Red flag: Auditor change, Bankruptcy or receivership; Other", True)]


def test_asof_and_panel(spark):
    data = [("A", date(2025, 5, 2), 10.0), ("A", date(2025, 5, 8), 11.0), ("A", date(2025, 5, 10), 12.0), ("A", date(2025, 5, 23), 15.0)]
    b = spark.createDataFrame(data, "ticker string, date date, close double")
    fridays = spark.createDataFrame([(date(2025, 5, d),) for d in (2, 9, 16, 23, 30)], "friday date")
    assert sorted(tuple(r) for r in market.asof_close(b, fridays).collect()) == [("A", date(2025, 5, 2), 10.0), ("A", date(2025, 5, 9), 11.0), ("A", date(2025, 5, 16), 12.0), ("A", date(2025, 5, 23), 15.0)]
    assert len(rows(market.asof_close(b, fridays, 13))) == 5
    (r,) = market.return_panel(spark.createDataFrame([(date(2025, 5, 12), "A")], "week_start date, ticker string"), b).collect()
    assert [round(x, 9) for x in (r.ret_prior, r.ret_same, r.ret_next)] == [0.1, round(12 / 11 - 1, 9), 0.25]


def panel(spark, kind, seed=5):
    rng = random.Random(seed)
    data = []
    for w in range(20):
        for t in range(30):
            s = rng.gauss(0, 1)
            noise = lambda: rng.gauss(0, 1)
            data.append((date(2025, 1, 6) + timedelta(weeks=w), f"t{t:02d}", s, s, 0.0, s, -s, noise(), s * (kind == "follows") + noise(), noise(), s * (kind == "leads") + noise()))
    return spark.createDataFrame(data, "week_start date, ticker string, sentiment double, momentum double, attention_z double, composite_bull double, composite_bear double, rel_volume double, ret_prior double, ret_same double, ret_next double")


def test_evaluation_tells_leading_from_following(spark):
    for kind in ("leads", "follows", "none"):
        p = panel(spark, kind)
        table = {(r.signal, r.horizon): r for r in evaluate.lead_lag(p).collect()}
        lead, lag = table[("sentiment", "ret_next")], table[("sentiment", "ret_prior")]
        assert (abs(lead.t_stat) > 5) == (kind == "leads") and (abs(lag.t_stat) > 5) == (kind == "follows")
        assert ("attention_z", "ret_next") not in table  # constant
        assert lead.weeks == 20
    p = panel(spark, "leads")
    assert {r.signal: r.verdict for r in evaluate.verdict(evaluate.lead_lag(p)).collect()}["sentiment"] == "leads"
    table = spark.createDataFrame([(n, h, ic, t) for n, prior, after in (("leads", (0.1, 9.0), (0.1, 2.0)), ("reverse", (0.1, 1.0), (-0.3, -5.0)), ("follows", (-0.4, -3.0), (0.1, 2.5)), ("none", (0.1, 3.0), (0.2, 1.0)), ("unknown", (0.1, 3.0), (None, None)), ("none2", (0.1, None), (0.2, None))) for h, (ic, t) in (("ret_prior", prior), ("ret_next", after))], "signal string, horizon string, mean_ic double, t_stat double")
    assert all(r.signal.rstrip("2") == r.verdict for r in evaluate.verdict(table).collect())
    full = {(r.part, r.measure): r.value for r in ranking.analyse(p.withColumn("mentions", F.lit(1))).collect()}
    assert full[("panel", "weeks_with_returns")] == 20 and full[("panel", "enough_data")] == 1 and full[("ic_bull", "t_stat")] > 5 and full[("bull_list", "picks")] == 0  # attention is constant
    assert {(r.part, r.measure): r.value for r in ranking.analyse(p.withColumn("mentions", F.lit(1)).limit(0)).collect()}[("panel", "weeks_with_returns")] == 0
    spread = evaluate.cumulative(evaluate.quintile_spread(p, "composite_bull"), "week_start", "spread").orderBy("week_start").collect()
    assert statistics.mean(r.spread for r in spread) > 1 and abs(spread[1].cumulative - ((1 + spread[0].spread) * (1 + spread[1].spread) - 1)) < 1e-9
    r = evaluate.hit_rate(p, "composite_bull", 3, "bull", F.col("sentiment") > 0).first()
    assert r.picks == 60 and r.weeks == 20 and r.hit_rate > 0.7
    assert evaluate.added_signal(p).first().mean_ic_base > 0.4
    assert evaluate.hit_rate(p.limit(0), "composite_bull", 3, "bull").first().hit_rate is None


def test_spearman_ties_and_bins(spark):
    df = spark.createDataFrame([("w", 1.0, 1.0), ("w", 1.0, 2.0), ("w", 2.0, 2.0), ("w", 3.0, 5.0), ("w", None, 1.0), ("w", 9.0, float("nan")), ("x", 1.0, 1.0), ("x", 1.0, 2.0), ("x", 1.0, 3.0), ("y", 1.0, 1.0)], "w string, a double, b double")
    import pandas as pd

    pdf = pd.DataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 5.0)])
    got = {r.w: r.ic for r in evaluate.spearman(df, ["w"], "a", "b").collect()}
    assert set(got) == {"w", "x"} and got["x"] is None and abs(got["w"] - pdf[0].rank().corr(pdf[1].rank())) < 1e-12
    for n in (5, 7, 23):
        ranks = spark.range(1, n + 1).select(evaluate.quantile_bin(F.col("id"), F.lit(n)).alias("b")).collect()
        assert [r.b for r in ranks] == pd.qcut(pd.Series(range(1, n + 1)), 5, labels=False).tolist()


def test_agreement(spark):
    t = datetime(2025, 1, 1)
    data = [(str(n), "A", m, "x", s, t) for n, (a, b) in enumerate([(0.5, 1.0), (-0.5, 1.0), (0.05, 1.0), (0.5, None)]) for m, s in (("m", a), ("tag", b))]
    r = evaluate.agreement(spark.createDataFrame(data, "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz"), "m", "tag").first()
    assert (r.pairs, r.agree, r.neutral, r.opposite, r.accuracy_when_decisive) == (3, 1, 1, 1, 0.5)


def test_scoring(spark):
    t = datetime(2025, 5, 1)
    posts = spark.createDataFrame([("1", t, "A", "strong buy", 5), ("2", t, "A", "strong buy", None), ("3", t, "weak", None, 9)], "id string, created_at timestamp_ntz, title string, body string, engagement int")
    tickers = spark.createDataFrame([("1", "X", "bare"), ("1", "Y", "bare"), ("2", "X", "source"), ("3", "X", "bare")], "post_id string, ticker string, match_type string")
    scores = spark.createDataFrame([("1", "X", "lexicon", "pos", 0.9, t), ("1", "X", "base", "pos", 0.9, t), ("2", "X", "base", "neu", 0.1, t), ("3", "X", "base", "neg", -0.9, t), ("3", "X", "own", "neg", -1.0, t)], "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz")
    assert [r.id for r in scoring.untagged_posts(posts, tickers).collect()] == ["2"]
    assert rows(scoring.pairs_to_score(posts, tickers, scores, "lexicon").select("post_id", "ticker", "n_tickers")) == [("1", "Y", 1), ("2", "X", 1), ("3", "X", 1)]
    got = rows(scoring.score_pending(posts, tickers, scores, scoring.LexiconScorer(), t).select("post_id", "ticker", "model", "label", "score"))
    assert got == [("1", "Y", "lexicon", "pos", 1.0), ("2", "X", "lexicon", "pos", 1.0), ("3", "X", "lexicon", "neg", -1.0)]
    picks = scoring.second_pass(posts, tickers, scores, "base", "own", t + timedelta(days=1), top_k=1)
    assert [(r.post_id, r.top) for r in picks.collect()] == [("2", False)]
    reply = spark.createDataFrame([('{"label": "bullish", "score": 3}',), ('{"label": "bearish", "score": "-0.123456"}',), ('{"label": "neutral", "score": 0.04}',), ('{"label": "pos", "score": 0}',), ('{"label": "bullish"}',), ("broken",), (None,)], "r string")
    assert [r[0] and tuple(r[0]) for r in reply.select(scoring.score_from_reply(F.col("r"))).collect()] == [("pos", 1.0), ("neg", -0.1235), ("neu", 0.04), None, None, None, None]
    own = scoring.run_second_pass(posts, tickers, scores, "base", type("Own", (scoring.LexiconScorer,), {"name": "own"})(), t + timedelta(days=1), top_k=1)
    assert rows(own.select("post_id", "ticker", "model", "label")) == [("2", "X", "own", "pos")]


def test_each_ticker_is_scored_by_its_own_sentences(spark):
    t = datetime(2025, 5, 1)
    posts = spark.createDataFrame([("1", t, "Two of them", "AAA is a strong buy. Acme Works? weak! $bbb will crash. aaab buy", 5), ("2", t, None, "strong buy", 1)], "id string, created_at timestamp_ntz, title string, body string, engagement int")
    tickers = spark.createDataFrame([("1", "AAA", "bare"), ("1", "BBB", "bare"), ("1", "CCC", "bare"), ("1", "D.D", "bare"), ("2", "AAA", "bare")], "post_id string, ticker string, match_type string")
    aliases = spark.createDataFrame([("acme works", "CCC", False), ("TWO", "D.D", True)], "alias string, ticker string, exact boolean")
    none = spark.createDataFrame([], "post_id string, ticker string, model string, label string, score double, scored_at timestamp_ntz")
    got = {(r.post_id, r.ticker): r.score for r in scoring.score_pending(posts, tickers, none, scoring.LexiconScorer(), t, aliases).collect()}
    assert got == {("1", "AAA"): 1.0, ("1", "BBB"): -1.0, ("1", "CCC"): 0.0, ("1", "D.D"): (3 - 2) / 5, ("2", "AAA"): 1.0}
    assert [r.post_id for r in scoring.in_order(scoring.pairs_to_score(posts, tickers, none, "m")).collect()] == ["1"] * 4 + ["2"]
    assert tuple(spark.range(1).select(scoring.score_from_probabilities(F.lit(0.2), F.lit(0.7), F.lit(0.1))).first()[0]) == ("neg", -0.5)


def test_all_weeks_at_once_are_what_each_week_is(spark):
    from tidemark.operators import read_api

    rng = random.Random(5)
    first = datetime(2025, 1, 1)
    data = [(f"p{n}", rng.choice("AB"), rng.choice(["u", "v", None]), rng.choice("xyz"), "reddit", first + timedelta(minutes=rng.randrange(80 * 1440)), rng.choice([None, 0.5, -1.0]), float(rng.randrange(4))) for n in range(400)]
    data += [("edge", "A", "u", "x", "reddit", datetime(2025, 2, 1), 1.0, 1.0)]  # Saturday 00:00
    mentions = spark.createDataFrame(data, "post_id string, ticker string, author_id string, community string, source string, created_at timestamp_ntz, score double, weight double")
    together = rows(signals.weekly_components(signals.spread_over_weeks(mentions), by=["week_start"]))
    alone = []
    for k in range(-1, 14):
        week = Week.ending(date(2025, 1, 3) + timedelta(weeks=k))
        inside = signals.with_days(mentions, week).where(F.col("day").between(0, 36))
        alone += [(week.monday, *r) for r in rows(signals.weekly_components(inside))]
    close = lambda a, b: all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for x, y in zip(a, b))
    assert len(together) == len(alone) > 15 and all(close(a, b) for a, b in zip(together, sorted(alone, key=repr)))
    bars = [(t, date(2025, 1, 1) + timedelta(days=d), 10 + rng.random(), float(rng.randrange(1, 9))) for t in "AB" for d in range(59) if rng.random() < 0.7 and not (t == "B" and d > 35)]
    frame = spark.createDataFrame(bars, "ticker string, date date, close double, volume double")
    weekly = {(r.week_start, r.ticker): tuple(r)[2:] for r in market.weekly_context(frame).collect()}
    for friday in (date(2025, 1, 31), date(2025, 2, 28)):
        for r in market.session_context(frame.where(F.col("date") >= F.lit(friday - timedelta(days=60))), friday).collect():
            assert close([x or 0.0 for x in tuple(r)[1:]], [x or 0.0 for x in weekly[(friday - timedelta(days=4), r.ticker)]])
    buys = spark.createDataFrame([("A", date(2025, 1, 31), 2), ("A", date(2025, 1, 31), 0), ("B", date(2025, 2, 3), None)], "ticker string, filing_date date, purchase_count int")
    flags = {(r.week_start, r.ticker): r.insider_buy_flag for r in market.purchases_within(buys, 30).collect()}
    for k in range(8):
        friday = date(2025, 1, 24) + timedelta(weeks=k)
        one = market.flag_within(spark.createDataFrame([("A",), ("B",)], "ticker string"), buys, friday, 30).collect()
        assert all(r.insider_buy_flag == flags.get((friday - timedelta(days=4), r.ticker), False) for r in one)
    lists = [spark.createDataFrame(x, "rank int, ticker string, red_flag boolean, events string") for x in ([(1, "A", True, "e"), (2, "B", False, None), (3, "C", True, "f")], [(1, "C", True, "f"), (2, "D", None, None), (3, "E", True, "g")])]
    assert [tuple(r) for r in read_api.red_flag_panel(*lists).collect()] == [("A", "e"), ("C", "f"), ("E", "g")]
    top = spark.createDataFrame([("news", "Why Acme stock plunged today", None), ("reddit", "Why Acme stock plunged today", None), ("news", "Plain", "PR Newswire"), ("news", None, None)], "source string, title string, community string")
    assert [(r.kind_label or "")[:5] for r in read_api.with_news_kind(top).collect()] == ["PRICE", "", "PRESS", ""]


def test_word_model_on_held_out_texts(spark):
    rng = random.Random(6)
    own = {"pos": ["rise", "beat", "strong"], "neg": ["fall", "miss", "weak"], "neu": ["flat", "same", "wait"]}
    made = [(n, label := rng.choice(list(own)), " ".join(rng.choice(own[label]) if rng.random() < 0.4 else f"Word{rng.randrange(40)}" for _ in range(12))) for n in range(900)]
    frame = spark.createDataFrame(made, "id int, label string, text string")
    model = scoring.WordModel.train(frame.where("id < 600").unionByName(spark.createDataFrame([(1, None, "rise"), (2, "odd", "x"), (3, "neu", None)], frame.schema)), "text", "label")
    got = {r.id: (r.label, r.score) for r in model.apply(frame.where("id >= 600"), "id", "text").collect()}
    right = sum(got[n][0] == label for n, label, _ in made[600:])
    assert len(got) == 300 and right > 0.9 * 300 and all(-1 <= s <= 1 for _, s in got.values())
    odd = {r.id: r.label for r in model.apply(spark.createDataFrame([(1, ""), (2, None), (3, "unseen"), (4, "rise " * 5000)], "id int, text string"), "id", "text").collect()}
    assert len(odd) == 4 and odd[4] == "pos"
    empty = scoring.WordModel.train(frame.limit(0), "text", "label")
    assert empty.apply(frame.limit(2), "id", "text").count() == 2 and empty.apply(frame.limit(0), "id", "text").count() == 0


def test_mentions_are_not_broadcast(spark):
    values = lambda data, names: spark.sql(f"SELECT * FROM VALUES {data} AS t({names})")
    posts = values("('p', TIMESTAMP_NTZ'2025-05-01')", "id, created_at")
    tickers = values("('p', 'A', 0.9D), ('p', 'B', 0.1D), ('q', 'A', 0.9D)", "post_id, ticker, confidence")
    scores = values("('p', 'A', 'm', 'pos', 0.5D, TIMESTAMP_NTZ'2025-05-01')", "post_id, ticker, model, label, score, scored_at")
    out = signals.load_mentions(posts, tickers, scores, ["m"], datetime(2025, 5, 1), datetime(2025, 5, 2), 0.5)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert rows(out) == [("p", "A", datetime(2025, 5, 1), "pos", 0.5)]


def test_context_is_not_broadcast(spark):
    values = lambda data, names: spark.sql(f"SELECT * FROM VALUES {data} AS t({names})")
    signal = values("(DATE'2025-05-12', 'A', 1D, 1D), (DATE'2025-05-12', 'B', 0D, 0D)", "week_start, ticker, composite_bull, composite_bear")
    bars = values("('A', DATE'2025-05-15', 2D, 5L), ('A', DATE'2025-05-16', 3D, 6L)", "ticker, date, close, volume")
    buys = values("('B', DATE'2025-05-16', 1)", "ticker, filing_date, purchase_count")
    filings = values("('A', '8-K', DATE'2025-05-13', TIMESTAMP_NTZ'2025-05-13', '4.01')", "ticker, form, filing_date, accepted_at, items")
    out = market.with_context(signal, bars, buys, filings, ["8-K"]).select("ticker", "insider_buy_flag", "events", "red_flag")
    assert rows(out) == [("A", False, "Red flag: Auditor change", True), ("B", True, None, False)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.extract import Rules, cashtags, extract_tickers

UNIVERSE = ["AAA", "BBB", "CCC", "T", "F", "BRK.B", "ALL", "ON", "GRN", "AT.T"]
ALIASES = [("Acme", "AAA", False), ("Acme Steel", "BBB", False), ("Bell", "CCC", True), ("Gone", "ZZZ", False), ("R&D Works", "GRN", False), ("Yo!", "ON", False), ("Steel Town", "F", False), (None, "AAA", False), (" ", "AAA", False)]
BLOCKED = ["ALL", "ON"]
# title, body, what is named how
CASES = [
    ("buy $aaa and $T", None, {"AAA": "cashtag", "T": "cashtag"}),
    ("$brk.b and $BRK.BX", None, {"BRK.B": "cashtag"}),
    ("cost $AAAA, US$AAA, $$AAA, $AAA_x", None, {}),
    ("($AAA)", "$BBB.", {"AAA": "cashtag", "BBB": "cashtag"}),
    ("$ALL of it", None, {"ALL": "cashtag"}),
    ("$ZZZ flies", None, {}),
    ("$AAAé", None, {}),
    ("ACME rises, bell rings", None, {"AAA": "alias"}),
    ("the Bell rang", None, {"CCC": "alias"}),
    ("the bell rang", "BELL!", {}),
    ("acme steel is up", None, {"BBB": "alias"}),
    ("acme steel town", None, {"BBB": "alias"}),
    ("acme, steel town", None, {"AAA": "alias", "F": "alias"}),
    ("Acme-Steel", "Acmes and pre-acme", {}),
    ("Acme\nSteel", None, {"AAA": "alias"}),
    ("the r&d works report", None, {"GRN": "alias"}),
    ("xR&D Works", "R&D Works2", {}),
    ("so yo! stops", "yo", {"ON": "alias"}),
    ("yo!yo", "Yo!", {"ON": "alias"}),
    ("gone fishing", None, {}),
    ("BBB is nice", None, {}),
    ("BBB stock is nice", None, {"BBB": "bare"}),
    ("BBB at 5%", None, {"BBB": "bare"}),
    ("BBB for $ 5", None, {"BBB": "bare"}),
    ("Stocks", "then BBB", {"BBB": "bare"}),
    ("restocks", "then BBB", {}),
    ("BBB beats acme", None, {"BBB": "bare", "AAA": "alias"}),
    ("BBB after $CCC", None, {"BBB": "bare", "CCC": "cashtag"}),
    ("ALL in, ON stock", None, {}),
    ("T stock, F shares", None, {}),
    ("BRK.B shares, AT.T too", None, {"BRK.B": "bare", "AT.T": "bare"}),
    ("shares of BBBs, xBBB, BBB_", ".BBB", {}),
    ("stock news", "WOW THIS IS BBB", {}),
    ("stock news", "WOW THIS BBB\nAAA", {"BBB": "bare", "AAA": "bare"}),
    ("stock news", "WOW WHAT NEWS BBB\r\nAAA BBB CCC", {"AAA": "bare", "BBB": "bare", "CCC": "bare"}),
    ("WOW WHAT NEWS", "stock BBB", {"BBB": "bare"}),
    ("stock https://x.example/AAA www.BBB.com", None, {}),
    ("stock r/BBB /u/AAA r/x and/or/BBB", None, {"BBB": "bare"}),
    ("$AAA AAA Acme", None, {"AAA": "cashtag"}),
    ("Acme AAA", None, {"AAA": "alias"}),
    (None, None, {}),
    ("", "", {}),
    (None, "$AAA", {"AAA": "cashtag"}),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(t,) for t in [*UNIVERSE, "AAA", None]], "ticker string"), spark.createDataFrame(ALIASES, "alias string, ticker string, exact boolean"), spark.createDataFrame([(w,) for w in BLOCKED], "word string")


def test_cases(spark, tables):
    posts = spark.createDataFrame([(str(n), t, b) for n, (t, b, _) in enumerate(CASES)] + [(None, "$AAA", None), ("0", *CASES[0][:2])], "id string, title string, body string")
    found = rows(extract_tickers(posts.selectExpr("*", "'x' AS ticker", "1 AS post_id"), *tables))
    got: dict = {}
    for post, ticker, kind, confidence in found:
        got.setdefault(int(post), {})[ticker] = kind
        assert confidence == Rules().confidence[kind]
    assert {n: got.get(n, {}) for n in range(len(CASES))} == {n: want for n, (_, _, want) in enumerate(CASES)}
    assert len(found) == len(set(found))


def test_beyond_the_broadcast_bound(spark, tables, monkeypatch):
    import tidemark.scratch as scratch

    posts = spark.createDataFrame([(str(n), t, b) for n, (t, b, _) in enumerate(CASES)], "id string, title string, body string")
    want = rows(extract_tickers(posts, *tables))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert rows(extract_tickers(posts, *tables)) == want


def test_without_aliases_and_empty(spark, tables):
    posts = spark.createDataFrame([("1", "acme and $AAA, ALL stock", None)], "id string, title string, body string")
    assert rows(extract_tickers(posts, tables[0])) == [("1", "AAA", "cashtag", 0.95), ("1", "ALL", "bare", 0.5)]
    assert rows(extract_tickers(posts.limit(0), *tables)) == rows(extract_tickers(posts, tables[0].limit(0), tables[1], tables[2])) == []
    assert rows(extract_tickers(posts, tables[0], tables[1].limit(0))) == [("1", "AAA", "cashtag", 0.95), ("1", "ALL", "bare", 0.5)]
    df = spark.createDataFrame([("$AAA up", None), (None, None), ("", "$bbb $BBB")], "title string, body string")
    assert [r[0] for r in df.select(cashtags(F.col("title"), F.col("body"))).collect()] == [["AAA"], [], ["BBB"]]

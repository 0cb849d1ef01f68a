import random
from datetime import date, timedelta

from tests.conftest import rows
from tidemark.operators.rolling import rolling_totals, spikes

START = date(2025, 1, 1)


def brute(data, periods):
    out = {}
    entities = {e for e, d, _ in data if e and d}
    for e in entities:
        own = [(d, v) for f, d, v in data if f == e and d]
        first, last = min(d for d, _ in own), max(d for d, _ in own)
        for n in range((last - first).days + 1):
            day = first + timedelta(days=n)
            sums = []
            for k in periods:
                inside = [0 if v is None or v != v else v for d, v in own if day - timedelta(days=k) < d <= day]
                sums += [sum(inside), sum(inside) / k, len(inside)]
            out[(e, day)] = sums
    return out


def test_totals_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), START + timedelta(days=rng.randrange(90)) if rng.random() < 0.95 else None, rng.choice([None, 1, 5, 8])) for _ in range(120)]
    df = spark.createDataFrame([(*x, 1) for x in data], "e string, d date, v int, on_day int")
    got = {(r[0], r[1]): list(r[2:]) for r in rolling_totals(df, "e", "d", "v", (3, 10)).collect()}
    assert got == brute(data, (3, 10))


def test_nan_single_day_and_empty(spark):
    df = spark.createDataFrame([("a", START, float("nan")), ("a", START, 2.0), ("a", START, 2.0)], "e string, d date, v double")
    assert [tuple(r) for r in rolling_totals(df, "e", "d", "v", (7,)).collect()] == [("a", START, 4.0, 4.0 / 7, 3)]
    assert rows(rolling_totals(df.limit(0), "e", "d", "v")) == []


def test_far_off_day_costs_one_run(spark):
    df = spark.createDataFrame([("a", date(1970, 1, 1), 1), ("a", date(2070, 1, 1), 1)], "e string, d date, v int")
    assert rolling_totals(df, "e", "d", "v").count() == (date(2070, 1, 1) - date(1970, 1, 1)).days + 1


def test_spikes(spark):
    data = [("a", START + timedelta(days=n), 1) for n in range(40)] + [("a", START + timedelta(days=38), 500), ("b", START, 9)]
    df = spark.createDataFrame(data, "e string, d date, v int")
    totals = brute(data, (7, 30))
    want = sorted((e, d) for (e, d), (s7, _, _, s30, _, n30) in totals.items() if d >= START + timedelta(days=29) and n30 >= 12 and s7 * 30 > 3 * s30 * 7)
    assert rows(spikes(df, "e", "d", "v")) == want and want

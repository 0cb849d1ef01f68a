import random
from datetime import datetime, timedelta

from tidemark.llm.nearest import nearest_in_time

START = datetime(2025, 1, 1)


def test_against_brute_force(spark):
    rng = random.Random(3)
    at = lambda: START + timedelta(minutes=rng.randrange(60 * 24 * 30))
    left = [(rng.choice(["a", "b", None]), at() if rng.random() < 0.95 else None, n) for n in range(150)]
    right = list({(rng.choice(["a", "b", "c", None]), at()) for _ in range(90)})
    ls = spark.createDataFrame(left, "e string, at timestamp_ntz, matched int")
    rs = spark.createDataFrame(right, "e string, at timestamp_ntz")
    for bucket in (None, 7200):
        got = {r[2]: r[3] and r[3].at for r in nearest_in_time(ls, rs, "e", "at", "at", 3 * 3600, bucket).collect()}
        assert len(got) == len(left)
        for e, t, n in left:
            near = sorted((abs(t - x), x) for f, x in right if t and f == e and x and e is not None and abs(t - x) <= timedelta(hours=3))
            assert got[n] == (near[0][1] if near else None), n


def test_ties_bounds_and_empty(spark):
    ls = spark.createDataFrame([("a", START)], "e string, t timestamp_ntz")
    rs = spark.createDataFrame([("a", START + timedelta(hours=2)), ("a", START - timedelta(hours=2))], "e string, u timestamp_ntz")
    assert nearest_in_time(ls, rs, "e", "t", "u", 7200).first().matched.u == START - timedelta(hours=2)
    assert nearest_in_time(ls, rs, "e", "t", "u", 7199).first().matched is None
    assert nearest_in_time(ls, rs.limit(0), "e", "t", "u", 7200).first().matched is None
    assert nearest_in_time(ls.limit(0), rs, "e", "t", "u", 7200).count() == 0

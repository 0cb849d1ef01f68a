import random

from tests.conftest import rows
from tidemark.llm.topn import top_n


def test_against_sorting(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), f"i{n:03d}", rng.choice([None, float("nan"), 1.0, 1.0, 2.0, -3.0]), n) for n in range(200)]
    df = spark.createDataFrame(data, "g string, i string, s double, rank int")
    for subgroups in (1, 8):
        got = {(r.g, r.i, r["rank"]) for r in top_n(df, ["g"], "s", "i", 5, subgroups).collect()}
        want = set()
        for g in ("a", "b", None):
            known = sorted((x for x in data if x[0] == g and x[2] is not None and x[2] == x[2]), key=lambda x: (-x[2], x[1]))
            want |= {(g, x[1], k + 1) for k, x in enumerate(known[:5])}
        assert got == want


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("a", "1", 1.0)] * 3 + [("a", "2", 0.5)], "g string, i string, s double")
    assert rows(top_n(df, ["g"], "s", "i", 2)) == [("a", "1", 1.0, 1), ("a", "1", 1.0, 2)]
    assert rows(top_n(df.limit(0), ["g"], "s", "i", 2)) == []

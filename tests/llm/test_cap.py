import random

from tests.conftest import rows
from tidemark.llm.cap import CapState, cap_share


def brute(data, limit):
    groups = {}
    for g, i, s in data:
        if g is not None and i is not None:
            best = groups.setdefault(g, {})
            value = float("-inf") if s is None or s != s else s
            best[i] = max(best.get(i, float("-inf")), value)
    out = set()
    for g, items in groups.items():
        order = sorted(items, key=lambda i: (-items[i], i))
        out |= {(g, i) for i in order[limit:]}
    return out


def test_batches_give_what_one_batch_gives(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(6)}", f"r{n:04d}", rng.choice([None, 1.0, 2.0, 2.0, 7.5, float("nan"), -1.0])) for n in range(300)]
    data += [(None, "x", 1.0), ("g1", None, 1.0)]
    state = CapState(spark, ["g"], "i", "s", 4)
    for k in range(3):
        state.apply(spark.createDataFrame(data[k::3], "g string, i string, s double"))
    assert {tuple(r) for r in state.displaced().select("g", "i").collect()} == brute(data, 4)
    kept = rows(state.kept().select("g", "i", "place"))
    assert len(kept) == len({(g, p) for g, _, p in kept})
    assert not {(g, i) for g, i, _ in kept} & brute(data, 4)
    again = CapState(spark, ["g"], "i", "s", 4, state.path)
    assert again.generations == [0, 1, 2]


def test_twenty_batches_with_records_that_come_again(spark):
    """Lower, higher, equal and unknown scores of records kept or displaced before, against one ranking of all."""
    import tidemark.llm.cap as m
    from tidemark import scratch

    rng = random.Random(4)
    state, seen, files = CapState(spark, ["g"], "i", "s", 3), [], []
    for n in range(20):
        batch = [(rng.choice(["hot", "hot", "x", "y"]), f"r{rng.randrange(60):02d}", rng.choice([None, 1.0, 2.0, 3.0, 5.0, 8.0, float("nan")])) for _ in range(25)]
        seen += batch
        state.apply(spark.createDataFrame(batch, "g string, i string, s double"))
        files.append(len(state.kept().inputFiles()))
        if n in (3, 4, 10, 19):
            gone = brute(seen, 3)
            assert {tuple(r) for r in state.displaced().collect()} == gone
            everyone = {(g, i) for g, i, _ in seen}
            assert {(r.g, r.i) for r in state.kept().collect()} == everyone - gone
    assert max(files[12:]) <= max(files[:8])  # reads don't grow with the number of batches
    scratch.remove(spark, state._at(20, "whole"))
    again = CapState(spark, ["g"], "i", "s", 3, state.path)
    assert rows(again.kept()) == rows(state.kept()) and len(again.generations) == 20 and 20 % m.COMPACT == 0


def test_repeated_rows_and_records_that_come_again(spark):
    state = CapState(spark, ["g"], "i", "s", 2)
    first = spark.createDataFrame([("a", "1", 5), ("a", "1", 5), ("a", "2", 4), ("a", "3", 3)], "g string, i string, s int")
    state.apply(first)
    state.apply(first)
    assert rows(state.kept().select("i", "place")) == [("1", 1), ("2", 2)]
    assert rows(state.displaced()) == [("a", "3")]


def test_empty_batch(spark):
    state = CapState(spark, ["g"], "i", "s", 2)
    assert state.kept() is None and state.displaced() is None
    state.apply(spark.createDataFrame([], "g string, i string, s int"))
    assert rows(state.kept()) == [] and rows(state.displaced()) == []


def test_share(spark):
    data = [("t", "a", f"{n:02d}", n) for n in range(8)] + [("t", "b", "90", None), ("t", None, "91", 1), ("t", "b", "92", 3)]
    df = spark.createDataFrame(data, "t string, a string, i string, s int")
    out = cap_share(df, ["t"], "a", "i", "s", 0.3)
    kept = {r.i for r in out.where("kept").collect()}
    assert kept == {"07", "06", "05", "90", "91", "92"}  # 0.3 of eleven, the one without contributor included
    more = df.unionByName(spark.createDataFrame([("t", None, f"n{n}", 0) for n in range(3)] + [(None, "a", "no", 1)], df.schema))
    assert {r.i for r in cap_share(more, ["t"], "a", "i", "s", 0.3).where("a = 'a' and kept").collect()} == {"07", "06", "05", "04", "no"}  # of fourteen
    assert out.count() == len(data)
    assert rows(cap_share(df.limit(0), ["t"], "a", "i", "s", 0.3)) == []

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm.components import connected_components


def brute(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_random_graphs(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(links)


def test_chain_star_and_nulls(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    links = list(zip(order, order[1:])) + [(1000, n) for n in range(1001, 1040)] + [(1000, 1001)] * 3
    df = spark.createDataFrame([*links, (None, 5), (7, None)], "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == brute(links)

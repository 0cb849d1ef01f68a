import random

import pytest

from tidemark.llm.packing import grid, pack, token_counts


def check(spark, sizes, capacity, **kw):
    out = pack(spark.createDataFrame(list(enumerate(sizes)), "id long, tokens int"), "id", "tokens", capacity, **kw).collect()
    room, parts = {}, {}
    for r in out:
        room[r.container] = room.get(r.container, 0) + r.tokens
        parts.setdefault(r.id, []).append((r.piece, r.token_from, r.token_to))
    assert max(room.values()) <= capacity
    assert set(parts) == set(range(len(sizes)))
    for k, n in enumerate(sizes):
        n = n or 0
        got = sorted(parts[k])
        assert len(got) == max(1, -(-n // capacity))
        assert [p for p, _, _ in got] == list(range(len(got)))
        assert got[0][1] == 0 and got[-1][2] == n and all(a[2] == b[1] for a, b in zip(got, got[1:]))
    return len(room), sum(n or 0 for n in sizes)


def test_every_item_once_and_well_filled(spark):
    rng = random.Random(8)
    sizes = [rng.choice([rng.randrange(1, 30), rng.randrange(1, 120), rng.randrange(60, 101), 230, 0]) for _ in range(3000)] + [None, 100, 50, 50, 1000]
    bins, total = check(spark, sizes, 100, workers=4)
    assert total / (bins * 100) > 0.85


def test_leftovers_up_a_tree_of_workers(spark, monkeypatch):
    import tidemark.llm.packing as m

    rng = random.Random(9)
    sizes = [rng.randrange(1, 60) for _ in range(2000)]
    flat, _ = check(spark, sizes, 100, workers=40)
    monkeypatch.setattr(m, "FAN_IN", 4)
    tree, _ = check(spark, sizes, 100, workers=40)  # three levels
    assert tree <= flat * 1.02


@pytest.mark.parametrize("sizes", [[0], [None, 0], [7], [100], [101], [51] * 9, [1] * 250])
def test_small_inputs(spark, sizes):
    check(spark, sizes, 100)


def test_same_whatever_the_partitioning(spark):
    df = spark.createDataFrame([(n, n * 7 % 90) for n in range(300)], "id long, tokens int")
    one = {(r.id, r.piece, r.container) for r in pack(df.coalesce(1), "id", "tokens", 100).collect()}
    assert one == {(r.id, r.piece, r.container) for r in pack(df.repartition(7), "id", "tokens", 100).collect()}


def test_wrong_input_and_empty(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 2), (1, 3)], "id long, tokens int"), "id", "tokens", 10)
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(None, 2)], "id long, tokens int"), "id", "tokens", 10)
    assert pack(spark.createDataFrame([], "id long, tokens int"), "id", "tokens", 10).count() == 0


def test_grid():
    ks = grid(2048)
    assert ks[:40] == list(range(1, 41)) and ks == sorted(set(ks)) and ks[-1] <= 2048


def test_token_counts(spark):
    from tokenizers import Tokenizer

    from tidemark.llm.packing import TOKENIZER

    texts = ["", None, "Plain words, twice.", "<|endoftext|>", "x" * 50_000]
    got = {r.id: r.tokens for r in token_counts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    assert got == {k: len(model.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}

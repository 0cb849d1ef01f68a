import random
import re

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm.neardup import near_duplicate_classes, near_duplicate_pairs

WORDS = [f"w{n}" for n in range(400)]


def made(rng, n=60):
    docs = []
    for k in range(n):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 60))]
        docs.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [rng.choice(WORDS)]
            docs.append(other)
    data = [(f"id{n:03d}", " ".join(d) if n % 3 else ", ".join(d).upper()) for n, d in enumerate(docs)]
    return data + [("null", None), ("empty", ""), ("one", "word"), ("two", "word"), (None, "a b c d e f g h"), ("id000", data[0][1])]


def shingles(text, k):
    v = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(v[i : i + k]) for i in range(len(v) - k + 1)}


def brute(data, k, t):
    data = sorted({x for x in data if x[0] is not None})
    sets = [(i, shingles(x, k)) for i, x in data]
    return {(a, b) for n, (a, p) in enumerate(sets) for b, q in sets[n + 1 :] if p and q and len(p & q) >= t * len(p | q)}


def test_pairs_and_classes_against_brute_force(spark):
    data = made(random.Random(5))
    df = spark.createDataFrame(data, "id string, text string").repartition(3)
    for k, t in ((3, 0.6), (5, 0.8)):
        want = brute(data, k, t)
        assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, "id", F.col("text"), k, t).collect()} == want
        up = {i: i for i, _ in data if i is not None}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        text = dict(data)
        for a, b in want | {("one", "two"), ("empty", "null")}:
            a, b = sorted((find(a), find(b)))
            up[b] = a
        got = {r.id: r.class_id for r in near_duplicate_classes(df, "id", F.col("text"), k, t).collect()}
        assert got == {i: find(i) for i in text if i is not None}


def test_many_copies_and_a_full_bucket(spark):
    import tidemark.llm.neardup as m

    base = " ".join(WORDS[:80])
    data = [(f"c{n:03d}", base) for n in range(200)] + [(f"v{n:02d}", f"{base} tail{n}") for n in range(30)]
    old, m.BLOCK = m.BLOCK, 8  # several blocks a bucket
    try:
        got = rows(near_duplicate_classes(spark.createDataFrame(data, "id string, text string"), "id", F.col("text")))
    finally:
        m.BLOCK = old
    assert {c for _, c, _ in got} == {"c000"} and len(got) == 230
    assert len(near_duplicate_pairs(spark.createDataFrame(data[:200], "id string, text string"), "id", F.col("text")).collect()) == 200 * 199 // 2
    assert {n for _, _, n in got} == {30}  # each text is similar to all others; copies don't count


def test_hot_keys_go_as_blocks(spark):
    """A bucket that all texts of a batch share: no partition and no row holds more than a block of it, no pair is lost."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType

    import tidemark.llm.neardup as m

    n, parts = 60_000, 32
    common = " ".join(WORDS[:60])
    df = spark.range(n).select("id", F.concat(F.lit(common), F.lit(" x"), F.col("id").cast("string")).alias("text")).repartition(6)
    texts = m.texts_of(df, "id", F.col("text"))
    signed = texts.select("id", "t", "h").mapInArrow(m._signer(5, 2, 5, parts, to_arrow_type(LongType())), "part int, keys binary, texts binary, hot binary, key long, block binary, t long, bits binary, id long, enough boolean")
    bucketed = signed.repartitionById(parts, "part").withColumn("at", F.spark_partition_id())
    held = bucketed.groupBy("at").agg(F.sum(F.coalesce(F.length("texts"), F.lit(0)) + F.coalesce(F.length("block"), F.lit(0))).alias("bytes")).collect()
    assert sum(r.bytes for r in held) == 2 * n * 8 and max(r.bytes for r in held) <= 0.1 * 2 * n * 8
    assert bucketed.agg(F.max(F.length("block"))).first()[0] <= 8 * m.BLOCK


def test_hot_and_cold_texts_of_one_key_meet(spark, monkeypatch):
    import tidemark.llm.neardup as m

    monkeypatch.setattr(m, "HOT", 6)
    monkeypatch.setattr(m, "BLOCK", 4)
    rng = random.Random(2)
    bases = [[rng.choice(WORDS) for _ in range(60)] for _ in range(4)]
    data = [(f"i{k:03d}", " ".join(bases[0 if k < 40 else 1 + k % 3] + [f"x{k}"])) for k in range(55)]
    spread = spark.createDataFrame(data[:30], "id string, text string").coalesce(1).unionByName(spark.createDataFrame(data[30:], "id string, text string").repartition(5))
    assert {(r.id_a, r.id_b) for r in near_duplicate_pairs(spread, "id", F.col("text")).collect()} == brute(data, 5, 0.8)


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert rows(near_duplicate_pairs(df, "id", F.col("text"))) == [] and rows(near_duplicate_classes(df, "id", F.col("text"))) == []

import os
import random

import numpy as np
import pytest

import tidemark.llm.leakage as leakage
from tests.conftest import rows
from tidemark.llm.leakage import BUCKETS, DIMENSIONS, LatentSpace, _Cells, _common_subsequences, _hash_words, _Items, _longest_runs, _places, _tokenise, leaked_passages, leaked_runs, word_list

WORDS = [f"word{n}" for n in range(60)]
SF = "/root/testdata/sf0.01"
ITEM = "item_id long, text string"
DOC = "doc_id long, text string"


def made():
    rng = random.Random(6)
    items = [(n, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 40)))) for n in range(12)] + [(90, None), (91, "")]
    docs = []
    for n in range(150):
        v = [rng.choice(WORDS) for _ in range(rng.randrange(0, 120))]
        if n % 3 == 0:
            own = items[n % 12][1].split()
            size = rng.choice([6, 9, 10, 11, 20])
            a, at = rng.randrange(max(1, len(own) - size)), rng.randrange(len(v) + 1)
            v[at:at] = own[a : a + size]
        docs.append((n, rng.choice([" ", ", ", "\n"]).join(v).upper() if n % 2 else " ".join(v)))
    return docs + [(900, None), (901, ""), (None, items[0][1]), (0, docs[0][1])], items


def brute(docs, items):
    grams = lambda t: {tuple(v[i : i + 10]) for v in [word_list(t)] for i in range(len(v) - 9)}
    return sorted({(d, i) for d, t in docs if d is not None for i, u in items if grams(t) & grams(u)}, key=repr)


@pytest.mark.parametrize("words", [400_000, 30])
def test_runs_against_brute_force(spark, monkeypatch, words):
    monkeypatch.setattr(leakage, "ITEM_WORDS", words)  # one and several passes
    docs, items = made()
    long = " ".join(f"other{n}" for n in range(12))
    docs, items = docs + [(902, long)], items + [(0, long)]  # an id with two texts
    frame = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS doc", "2 AS words", "3 AS item")
    got = rows(leaked_runs(frame, spark.createDataFrame(items, ITEM)))
    assert got == brute(docs, items) and (902, 0) in got


def test_normal_forms(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "x " + text.replace("three", "th\xadree").replace("five", "ＦＩＶＥ")), (2, text.replace("ten", "tin")), (3, "zero " + " ".join(text.split()[1:]))]
    items = [(1, text), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3, text + " twelve")]
    assert rows(leaked_runs(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))) == [(1, 1), (1, 3), (3, 1), (3, 3)]
    assert word_list("ΟΔΟΣ İx a_b 3½​c") == ["οδος", "i", "x", "a", "b", "31", "2c"] and word_list(None) == word_list(" -") == []


def test_long_items_by_segments(spark):
    rng = random.Random(3)
    book = [f"w{rng.randrange(9000)}" for _ in range(5000)]
    docs = [(n, " ".join(["x"] * 7 + book[a : a + 12] + ["y"] * 9)) for n, a in enumerate((0, 1790, 1796, 1995, 3600, 4988))] + [(9, " ".join(book[40:49]))]
    got = leaked_passages(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, " ".join(book))], ITEM)).collect()
    assert {r.doc_id: r.run for r in got} == dict.fromkeys(range(6), 12)


def subsequence(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            table[j + 1], left = left + 1 if x == y else max(table[j + 1], table[j]), table[j + 1]
    return table[-1]


def test_region_checks_against_tables():
    rng = random.Random(9)
    space = LatentSpace(np.ones(BUCKETS, np.float32), np.zeros((BUCKETS, DIMENSIONS), np.float32))
    for longest, some in ((60, 9), (200, 30)):
        texts = [" ".join(f"w{rng.randrange(some)}" for _ in range(rng.randrange(longest - 55, longest))) for _ in range(40)]
        items = _Items(list(range(40)), texts, space, 4)
        flat, ends = _hash_words([" ".join(f"w{rng.randrange(some)}" for _ in range(rng.randrange(1, 150))) for _ in range(40)])
        item = np.arange(40)
        for limbs in np.unique(items.limbs):
            mine = item[items.limbs == limbs]
            _, bits = _places(items, flat, ends[:-1][mine].astype(np.int64), ends[1:][mine].astype(np.int64), mine, int(limbs))
            begin = np.concatenate(([0], np.cumsum(items.n)))
            for i, shared, run in zip(mine, _common_subsequences(bits, items.n[mine]), _longest_runs(bits)):
                a, b = items.words[begin[i] : begin[i + 1]].tolist(), flat[ends[i] : ends[i + 1]].tolist()
                assert shared == subsequence(a, b)
                assert run == max((k for k in range(1, len(a) + 1) for j in range(len(a) - k + 1) if a[j : j + k] in [b[x : x + k] for x in range(len(b) - k + 1)]), default=0)


def test_cells_find_what_all_comparisons_find():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 24))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    v, x = unit(np.repeat(base, 8, axis=0) + 0.6 * rng.standard_normal((2400, 24))), unit(np.repeat(base, 5, axis=0) + 0.6 * rng.standard_normal((1500, 24)))
    x = np.concatenate([x, unit(v[::4] + 0.03 * rng.standard_normal((600, 24)))])
    for least, probes, part in ((0.97, None, 1.0), (0.7, None, 1.0), (0.7, leakage.PROBES, 0.9)):
        want = set(zip(*(y.tolist() for y in np.nonzero(x @ v.T >= least))))
        got = {(r, m) for rs, ms, _ in _Cells(v).search(x, least, probes) for r, m in zip(rs.tolist(), ms.tolist())}
        assert want and got <= want and len(got) >= part * len(want)


def changed(kind, w, pool, rng):
    """An item's words reworded: every 7th, 5th or 3rd word another, words put in, neighbours swapped, words left out."""
    if kind.startswith("other"):
        return [x if i % int(kind[5:]) != int(kind[5:]) - 1 else rng.choice(pool) for i, x in enumerate(w)]
    if kind == "more":
        return [y for i, x in enumerate(w) for y in ([x, rng.choice(pool)] if i % 3 == 2 else [x])]
    if kind == "swapped":
        return [w[i + 1] if i % 4 == 0 and i + 1 < len(w) else w[i - 1] if i % 4 == 1 else x for i, x in enumerate(w)]
    return [x for i, x in enumerate(w) if i % 4 != 3]


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_planted_paraphrases(spark):
    """Recall and precision at the query's own parameters, of texts in four languages put into documents once or twice."""
    rng = random.Random(5)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/eval_items.parquet").select("item_id", "text").orderBy("item_id").collect()]
    pool = [w for _, t in docs[:300] for w in word_list(t)]
    hosts = [word_list(t) for _, t in docs if t and len(t) > 200]
    planted = []
    for kind in ("other7", "other5", "other3", "more", "swapped", "fewer", "twice", "late"):
        for n, text in items:
            w, host = word_list(text), rng.choice(hosts)
            made = changed("other5" if kind in ("twice", "late") else kind, w, pool, rng)
            at = rng.randrange(len(host) + 1)
            body = host[:at] + made + host[at:]
            body = body + rng.choices(pool, k=400) + made + host[:50] if kind == "twice" else rng.choices(pool, k=3000) + body if kind == "late" else body
            planted.append((kind, n, w, made, (10**7 + len(planted), " ".join(body))))
    frame = spark.createDataFrame(docs + [p[4] for p in planted], DOC).repartition(4)
    space = LatentSpace.fit(frame.select("doc_id", "text").mapInArrow(_tokenise, "doc long, words array<long>"))
    block = _Items([n for n, _ in items], [t for _, t in items], space, 4)
    rare = {n: set(block.rare[i, : block.rares[i]].tolist()) for i, (n, _) in enumerate(items)}
    found = leaked_passages(frame, spark.createDataFrame(items, ITEM)).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    for kind in sorted({p[0] for p in planted}):
        # those that the operator's own definition takes for a paraphrase
        real = [(p[4][0], p[1]) for p in planted if p[0] == kind and subsequence(p[2], p[3]) >= 0.6 * len(p[2]) and len(rare[p[1]] & set(_hash_words([" ".join(p[3])])[0].tolist())) >= 0.5 * len(rare[p[1]])]
        assert len(real) > 100 and sum(x in pairs for x in real) >= 0.97 * len(real), kind
    text_of = {p[4][0]: p[4][1] for p in planted} | dict(docs)
    other = [r for r in found if r.doc_id >= 10**7 and r.item_id != planted[r.doc_id - 10**7][1]]
    hosted = {(d, i) for d, i in brute([(r.doc_id, text_of[r.doc_id]) for r in other], items)}  # hosts that leak an item themselves
    wrong = [r for r in other if (r.doc_id, r.item_id) not in hosted]
    assert len(wrong) <= 0.05 * len(pairs)


def test_space_decides(spark, monkeypatch):
    """Content words exchanged for others of the same use: near in the latent space, far apart with random vectors."""
    rng = random.Random(8)
    topic = [[(f"alpha{t}x{c}", f"beta{t}x{c}") for c in range(12)] for t in range(30)]
    small = lambda: f"of{rng.randrange(4)}"
    use = lambda t, n: [w for _ in range(n) for w in (rng.choice(rng.choice(topic[t])), small(), small())]
    docs = [(n, " ".join(use(n % 30, 40))) for n in range(1500)]
    items = []
    for t in range(30):
        first = [w for c in range(12) for w in (topic[t][c][0], f"of{c % 4}", f"of{c % 3}")]
        other = [w for c in range(12) for w in (topic[t][c][1], f"of{c % 4}", f"of{c % 3}")]
        names = [f"name{t}n{k}" for k in range(4)]
        items.append((t, " ".join([names[0], *first[:18], *names[1:3], *first[18:], names[3]])))
        docs.append((10_000 + t, " ".join([*use(t, 30), names[0], *other, names[3], *use(t, 30)])))
    want = {(10_000 + t, t) for t in range(30)}
    frame, asked = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    got = {(r.doc_id, r.item_id) for r in leaked_passages(frame, asked).collect()}
    fit = LatentSpace.fit

    def shuffled(words):
        space = fit(words)
        return LatentSpace(space.idf, np.random.default_rng(1).standard_normal(space.vectors.shape).astype(np.float32))

    monkeypatch.setattr(LatentSpace, "fit", staticmethod(shuffled))
    by_chance = {(r.doc_id, r.item_id) for r in leaked_passages(frame, asked).collect()}
    assert got == want and len(by_chance & want) <= 15, (len(got & want), len(by_chance & want))


def test_empty(spark):
    none, some = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b c d e f g h i j")], ITEM)
    assert rows(leaked_runs(none, some)) == []
    assert rows(leaked_runs(spark.createDataFrame([(1, "a b c d e f g h i j")], DOC), some.limit(0))) == []
    with pytest.raises(ValueError):
        leaked_runs(none, some, run_words=5)

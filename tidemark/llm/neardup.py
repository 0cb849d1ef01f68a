"""Near-duplicate records by MinHash banding, signature verification and connected components.

Texts with the same words are one *text* (known by a 64-bit hash of its words); all work is done once per text, so a
third of all rows being copies of one text costs nothing but their membership rows.

1. Every text's set of word runs is hashed, and ``bands * rows`` universal hash minima are taken from it.
2. Each band of minima makes a key; texts that share one are candidates. Keys go as packed arrays, 13 bytes a key, to as
   many partitions as keep each at ``PARTITION_KEYS`` keys, and are paired there.
3. Keys that many texts of one batch share are hot: their texts go as blocks, apart from the others, and a task pairs two
   blocks, so no task holds a whole bucket, however many texts share it.
4. Candidates are verified on their signatures (one bit of every minimum), which are far smaller than the texts.
5. What passes is verified on the exact sets of word runs.
6. Linked texts are joined to classes by alternating large-star and small-star.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark import scratch
from tidemark.llm.components import connected_components

#: A pair at the threshold t is missed with probability (1 - t**ROWS)**BANDS; at t = 0.6 that is 0.8 %, at 0.65 under
#: 0.1 %, at 0.7 two in a hundred thousand. Fewer rows or more bands find more at the cost of candidates or shuffle.
BANDS, ROWS = 60, 5
#: Keys of a partition. Within one of P partitions a key has 40 bits, so all keys are of 40 + log2(P) bits: a key meets
#: a stranger by chance with a probability of ``PARTITION_KEYS / 2**40``, whatever the number of texts. There are at most
#: ``PARTITIONS``; beyond that many keys (1.6 billion texts) the partitions grow.
PARTITION_KEYS, PARTITIONS = 1_000_000, 100_000
#: Standard deviations that a true pair's signature may fall short by.
SLACK = 4.5
#: Texts of one bucket that are paired at once; a bucket of more is paired block by block.
BLOCK = 256
#: Texts of one batch that make a key hot.
HOT = 64
SEED = 20_250_101


def words(text: Column) -> Column:
    """Longest runs of Unicode letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def texts_of(df: DataFrame, ident: str, text: Column) -> DataFrame:
    """(ident, word_hashes, text_hash): a hash of every word, and of their order. NULL texts count as empty."""
    hashed = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return df.where(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), hashed.alias("h")).select("id", "h", F.xxhash64("h").alias("t"))


def _runs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of many texts, and where each text's runs start and how many they are.

    Texts must have at least ``width`` words.
    """
    counts = ends - starts - width + 1
    offsets = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, counts)
    x = np.zeros(len(at), np.uint64)
    for k in range(width):
        x = (x ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x, offsets[:-1], counts


def _hashes(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = bands * rows
    return (rng.integers(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)


_LOW = np.uint64((1 << 40) - 1)
_SIGNED = ["part", "keys", "texts", "hot", "key", "block", "t", "bits", "id", "enough"]


def _rows(names: list[str], kinds: list[pa.DataType], n: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch in which all other columns are NULL."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds)], names)


def _cut(x: np.ndarray, edges: np.ndarray) -> list[bytes]:
    return [x[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _signer(width: int, bands: int, rows: int, parts: int, id_kind: pa.DataType):
    """mapInArrow: (id, t, h) -> by partition the packed band keys with their texts and the keys that are hot here, blocks of
    hot keys' texts, each text's signature bits, and each record's text."""
    a, b = _hashes(bands, rows)
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), id_kind, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column(1).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offs = lists.offsets.to_numpy()
            starts, ends = offs[:-1].astype(np.int64), offs[1:].astype(np.int64)
            enough = ends - starts >= width
            home = (t.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            yield _rows(_SIGNED, kinds, len(t), part=pa.array(home), t=pa.array(t), id=batch.column(0), enough=pa.array(enough))
            _, keep = np.unique(t, return_index=True)  # copies within the batch
            keep = keep[enough[keep]]
            if not len(keep):
                continue
            t, home = t[keep], home[keep]
            x, begin, _ = _runs(flat, starts[keep], ends[keep], width)
            x = (x >> np.uint64(32)).astype(np.uint32)
            n = len(t)
            keys = np.empty((bands, n), np.uint64)
            bits = np.zeros((n, -(-bands * rows // 8) * 8), np.uint8)
            y = np.empty_like(x)
            for band in range(bands):
                k = np.full(n, (band * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1), np.uint64)
                for r in range(band * rows, band * rows + rows):
                    np.multiply(x, a[r], out=y)
                    np.add(y, b[r], out=y)
                    least = np.minimum.reduceat(y, begin)
                    bits[:, r] = (least ^ (least >> np.uint32(7)) ^ (least >> np.uint32(13))) & 1
                    k = (k ^ least) * np.uint64(0xD6E8FEB86659FD93)
                    k ^= k >> np.uint64(32)
                keys[band] = k
            yield _rows(_SIGNED, kinds, n, part=pa.array(home), t=pa.array(t), bits=pa.array(_cut(np.packbits(bits, axis=1), np.arange(n + 1)), pa.binary()))
            keys = keys.ravel()
            keys = (keys >> np.uint64(40)) % np.uint64(parts) << np.uint64(40) | keys & _LOW
            order = np.argsort(keys, kind="stable")
            keys, texts = keys[order], t[order % n]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(first, len(keys)))
            hot = size >= HOT
            cold = np.repeat(~hot, size)
            for at, many in zip(first[hot].tolist(), size[hot].tolist()):
                edges = np.append(np.arange(at, at + many, BLOCK), at + many)
                away = (np.arange(len(edges) - 1) * 7919 + int(keys[at] & _LOW) + int(t[0] & 0xFFFF)) % parts
                yield _rows(_SIGNED, kinds, len(away), part=pa.array(away.astype(np.int32)), key=pa.array(np.full(len(away), keys[at].view(np.int64))), block=pa.array(_cut(texts, edges), pa.binary()))
            hot_keys, keys, texts = keys[first[hot]], keys[cold], texts[cold]
            part, hot_part = (keys >> np.uint64(40)).astype(np.int32), (hot_keys >> np.uint64(40)).astype(np.int32)
            found = np.union1d(part, hot_part)
            edges, hot_edges = (np.append(np.searchsorted(p, found), len(p)) for p in (part, hot_part))
            low = keys & _LOW
            packed = [p + q for p, q in zip(_cut(low.astype(np.uint32), edges), _cut((low >> np.uint64(32)).astype(np.uint8), edges))]
            yield _rows(_SIGNED, kinds, len(found), part=pa.array(found), keys=pa.array(packed, pa.binary()), texts=pa.array(_cut(texts, edges), pa.binary()), hot=pa.array(_cut(hot_keys & _LOW, hot_edges), pa.binary()))

    return run


_BUCKETED = ["kind", "x", "y", "key", "block", "t", "bits", "id", "enough"]


def _bucketer(id_kind: pa.DataType):
    """mapInArrow over the rows of one partition: pairs (x, y) of texts that share a key, blocks of the keys that are hot
    or shared by more than ``BLOCK`` texts, signatures once per text, records."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), id_kind, pa.bool_()]

    def made(kind: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return _rows(_BUCKETED, kinds, n, kind=pa.array([kind] * n), **columns)

    def lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, texts, hot, part = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        signed, bits = [np.zeros(0, np.int64)], []
        for batch in batches:
            columns = dict(zip(_SIGNED, batch.columns))
            valid = {c: columns[c].is_valid().to_numpy(zero_copy_only=False) for c in ("keys", "key", "bits", "enough")}
            at = np.flatnonzero(valid["enough"])
            if len(at):
                take = pa.array(at)
                yield made("member", len(at), t=columns["t"].take(take), id=columns["id"].take(take), enough=columns["enough"].take(take))
            at = np.flatnonzero(valid["key"])
            if len(at):
                blobs = columns["block"].take(pa.array(at)).to_pylist()
                yield made("block", len(at), key=columns["key"].take(pa.array(at)), block=lists(np.frombuffer(b"".join(blobs), np.int64), np.cumsum([0, *[len(x) // 8 for x in blobs]])))
            at = np.flatnonzero(valid["bits"])
            if len(at):
                signed.append(columns["t"].take(pa.array(at)).to_numpy(zero_copy_only=False))
                bits.append(columns["bits"].take(pa.array(at)))
            for i in np.flatnonzero(valid["keys"]).tolist():
                part = columns["part"][i].as_py()
                packed = columns["keys"][i].as_buffer()
                n = len(packed) // 5
                low.append(np.frombuffer(packed, np.uint32, n))
                high.append(np.frombuffer(packed, np.uint8, n, 4 * n))
                texts.append(np.frombuffer(columns["texts"][i].as_buffer(), np.int64))
                hot.append(np.frombuffer(columns["hot"][i].as_buffer(), np.uint64))
        t, once = np.unique(np.concatenate(signed), return_index=True)
        if len(t):
            yield made("text", len(t), t=pa.array(t), bits=pa.concat_arrays(bits).take(pa.array(once)))
        del signed, bits
        key = np.concatenate(high).astype(np.uint64) << np.uint64(32) | np.concatenate(low)
        text = np.concatenate(texts)
        del low, high, texts
        # Keys of one text only go first; what is left is small.
        order = np.argsort(key, kind="stable")
        key, text = key[order], text[order]
        same = key[1:] == key[:-1]
        shared = np.append(False, same) | np.append(same, False) | np.isin(key, np.concatenate(hot))
        key, text = key[shared], text[shared]
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[: len(key)]
        key, text = key[fresh], text[fresh]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))[: len(key)]
        size = np.diff(np.append(first, len(key)))
        large = (size > BLOCK) | np.isin(key[first], np.concatenate(hot))
        for n in np.unique(size[~large & (size > 1)]).tolist():
            i, j = np.triu_indices(n, 1)
            begin = first[~large & (size == n)]
            step = max(1, 50_000 // len(i))
            for k in range(0, len(begin), step):
                x, y = (text[begin[k : k + step, None] + at].ravel() for at in (i, j))
                yield made("pair", len(x), x=pa.array(x), y=pa.array(y))
        for at, n in zip(first[large].tolist(), size[large].tolist()):
            edges = np.append(np.arange(0, n, BLOCK), n)
            whole = int(key[at]) | part << 40
            yield made("block", len(edges) - 1, key=pa.array(np.full(len(edges) - 1, whole)), block=lists(text[at : at + n], edges))

    return run


def _agreeing(least: int):
    """mapInArrow: keep (x, y) pairs whose signatures agree in at least ``least`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            differ = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
            keep = pa.array(differ <= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["x", "y"])

    return run


def _verifier(width: int, threshold_num: int, threshold_den: int):
    """mapInArrow: keep (x, y) whose sets of word runs reach the threshold, and their common and united runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2_000):
                batch = whole.slice(k, 2_000)
                runs, pair, side = [], [], []
                for which in (2, 3):
                    lists = batch.column(which)
                    offs = lists.offsets.to_numpy().astype(np.int64)
                    x, _, counts = _runs(lists.values.to_numpy(zero_copy_only=False).view(np.uint64), offs[:-1], offs[1:], width)
                    runs.append(x)
                    pair.append(np.repeat(np.arange(batch.num_rows), counts))
                    side.append(np.full(len(x), which))
                run_of, pair_of, side_of = np.concatenate(runs), np.concatenate(pair), np.concatenate(side)
                order = np.lexsort((side_of, run_of, pair_of))
                run_of, pair_of, side_of = run_of[order], pair_of[order], side_of[order]
                same = (run_of[1:] == run_of[:-1]) & (pair_of[1:] == pair_of[:-1])
                first = np.append(True, ~same)  # a run of either text
                both = np.append(same & (side_of[1:] != side_of[:-1]), False)
                united = np.bincount(pair_of[first], minlength=batch.num_rows)
                common = np.bincount(pair_of[both], minlength=batch.num_rows)
                keep = pa.array(np.flatnonzero(common * threshold_den >= united * threshold_num))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(common.astype(np.int32)).take(keep), pa.array(united.astype(np.int32)).take(keep)], ["x", "y", "common", "united"])

    return run


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs x < y of the texts of all blocks (key, block) of one key; a row holds two blocks at most."""
    blocks = blocks.select("key", "block", F.xxhash64("block").alias("b"))
    left = blocks.select("key", F.col("block").alias("p"), F.col("b").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(scratch.SALTS - 1).cast("long"))).alias("s"))
    right = blocks.select("key", F.col("block").alias("q"), F.col("b").alias("j"), F.pmod("b", F.lit(scratch.SALTS).cast("long")).alias("s"))
    met = left.join(right, ["key", "s"]).where(F.col("i") <= F.col("j"))
    pairs = met.select(F.explode("p").alias("x"), "q").select("x", F.explode("q").alias("y")).where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def similar_texts(df: DataFrame, ident: str, text: Column, width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """The links and the members: (x, y, common, united) for texts x < y with at least ``threshold`` of their word runs in
    common, and (id, t, enough), each record's text and whether it has ``width`` words; only those take part.

    Exact in what it gives: every pair is verified on whole sets; see ``BANDS`` for what it may miss.
    """
    if width < 1 or not 0 < threshold <= 1:
        raise ValueError("width must be positive, threshold in (0, 1]")
    spark = df.sparkSession
    n_bits = bands * rows
    num, den = round(threshold * 1000), 1000
    source = df.where(F.col(ident).isNotNull())
    texts = texts_of(source, ident, text)
    kind = texts.schema["id"].dataType
    id_kind = to_arrow_type(kind)
    parts = min(PARTITIONS, max(spark.sparkContext.defaultParallelism, -(-source.count() * bands // PARTITION_KEYS)))
    signed = texts.select("id", "t", "h").mapInArrow(_signer(width, bands, rows, parts, id_kind), f"part int, keys binary, texts binary, hot binary, key long, block binary, t long, bits binary, id {kind.simpleString()}, enough boolean")
    bucketed = signed.repartitionById(parts, "part").mapInArrow(_bucketer(id_kind), f"kind string, x long, y long, key long, block array<long>, t long, bits binary, id {kind.simpleString()}, enough boolean")
    bucketed = scratch.materialize(bucketed, "buckets", partition_by=["kind"])
    of = lambda name: bucketed.where(F.col("kind") == name)
    members = of("member").select("id", "t", "enough")
    pairs = scratch.materialize(of("pair").select("x", "y").unionByName(_block_pairs(of("block").select("key", "block").distinct())).distinct(), "candidates")
    bits = of("text").select("t", "bits")
    agree = (1 + threshold) / 2
    differ = math.ceil(n_bits * (1 - agree) + SLACK * math.sqrt(n_bits * agree * (1 - agree)))
    signs = pairs.join(bits.select(F.col("t").alias("x"), F.col("bits").alias("p")), "x").join(bits.select(F.col("t").alias("y"), F.col("bits").alias("q")), "y")
    likely = scratch.materialize(signs.select("x", "y", "p", "q").mapInArrow(_agreeing(differ), "x long, y long"), "likely")
    scratch.release(pairs)
    ends = scratch.materialize(likely.select(F.explode(F.array("x", "y")).alias("t")).distinct(), "ends")
    # One record of each text that is left; only these are cut into words again.
    one = scratch.materialize(scratch.join_checked(members, ends, ["t"], "left_semi", "id").groupBy("t").agg(F.min("id").alias("id")).select(F.col("id").alias(ident)).distinct(), "readers")
    again = texts_of(scratch.join_checked(source, one, [ident], "left_semi", ident), ident, text)
    sets = scratch.materialize(again.join(ends, "t", "left_semi").groupBy("t").agg(F.min_by("h", "id").alias("h")), "sets")
    whole = likely.join(sets.select(F.col("t").alias("x"), F.col("h").alias("p")), "x").join(sets.select(F.col("t").alias("y"), F.col("h").alias("q")), "y")
    links = scratch.materialize(whole.select("x", "y", "p", "q").mapInArrow(_verifier(width, num, den), "x long, y long, common int, united int"), "similar")
    scratch.release(likely, ends, one, sets)
    return links, members


def near_duplicate_classes(df: DataFrame, ident: str, text: Column, width: int = 5, threshold: float = 0.8, **hashing: int) -> DataFrame:
    """(ident, class_id, links): each record's class of transitively similar records, and its number of links.

    ``class_id`` is the least ident of the class; ``links`` counts the other texts (not copies) the record's text is
    similar to. Records with the same words are always of one class, also empty ones and those with fewer than
    ``width`` words. NULL texts count as empty, NULL idents are dropped, repeated rows of one ident count once (with the
    text that sorts first by its hash), an empty table gives none.
    """
    links, members = similar_texts(df, ident, text, width, threshold, **hashing)
    members = members.groupBy("id").agg(F.min("t").alias("t"))
    classes = connected_components(links, "x", "y").select(F.col("node").alias("t"), "component")
    degree = links.select(F.explode(F.array("x", "y")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("links"))
    known = scratch.materialize(classes.join(degree, "t", "left"), "classes")
    named = scratch.join_checked(members, known, ["t"], "left", "id").select("id", F.coalesce("component", "t").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    named = scratch.materialize(named, "named")
    least = scratch.materialize(named.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    return scratch.join_checked(named, least, ["component"], "inner", "id").select(F.col("id").alias(ident), "class_id", F.col("links").cast("int").alias("links"))


def near_duplicate_pairs(df: DataFrame, ident: str, text: Column, width: int = 5, threshold: float = 0.8, **hashing: int) -> DataFrame:
    """All pairs (id_a, id_b) with id_a < id_b of different idents whose texts are similar, copies included.

    As :func:`near_duplicate_classes`, but records of fewer than ``width`` words take no part. The number of rows is
    that of the similar pairs; use classes where groups of copies may be large.
    """
    links, members = similar_texts(df, ident, text, width, threshold, **hashing)
    members = scratch.materialize(members.where("enough").groupBy("id").agg(F.min("t").alias("t")), "members")
    a = members.select(F.col("id").alias("id_a"), F.col("t").alias("x"))
    b = members.select(F.col("id").alias("id_b"), F.col("t").alias("y"))
    across = links.select("x", "y").join(a, "x").join(b, "y").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return across.unionByName(_copies(members))


def _copies(members: DataFrame) -> DataFrame:
    """All pairs of records (id, t) of one text. Records of a text are cut into hashed blocks of about ``BLOCK`` and two
    blocks meet in a task, so the task of a text with very many copies has no more to do than others."""
    copied = scratch.materialize(members.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("t", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "copied")
    several = scratch.join_checked(members, copied, ["t"], "inner", "id").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = several.select("t", F.col("id").alias("p"), F.col("i").alias("bi"), F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("bj"))
    right = several.select("t", F.col("id").alias("q"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("bi"), F.col("i").alias("bj"))
    met = left.join(right, ["t", "bi", "bj"]).where((F.col("bi") != F.col("bj")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))

"""Filling fixed-capacity containers by harmonic packing.

Lengths are cut into reciprocal-capacity classes: an item of class k has at most capacity / k tokens, so k of them
always fit in one container. Each class fills its containers with a fixed number of items, independently on every
worker; what a worker has left of a class is filled up with what ``FAN_IN`` workers have left, and so on up a tree, and the few
items left at its root (fewer than k of each class, a number that doesn't grow with the data) are packed by first fit.

Large items leave room: a container of one item of 60 % wastes 40. Before the small classes are packed, the room left in
containers of the large classes is offered to them in slots of capacity / k, again a fixed number by class and
worker; slot n of a class takes its item n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Items that a worker ranks together; the number of workers follows from it and the number of items.
WORKER_ITEMS = 200_000
#: Workers whose leftovers are filled up together: a task has fewer than FAN_IN * k items of a class.
FAN_IN = 64
#: Classes up to this one have room to fill; later ones fill it.
LARGE = 6


def token_counts(df: DataFrame, ident: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, tokens) of whole texts by a public tokenizer file; special tokens' strings are ordinary text, NULL has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.encode_special_tokens = True
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [len(e) for i in range(0, len(texts), 256) for e in model.encode_batch_fast(texts[i : i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], [ident, "tokens"])

    kind = df.select(ident).schema[0].dataType.simpleString()
    return df.select(ident, text).mapInArrow(count, f"`{ident}` {kind}, tokens int")


def grid(capacity: int) -> list[int]:
    """The numbers of items per container: 1 to 40, then in steps of about a twentieth, at most ``capacity``."""
    ks, k = [], 1
    while k <= capacity:
        ks.append(k)
        k = k + 1 if k < 40 else max(k + 1, k * 21 // 20)
    return ks


def _class_of(size: Column, capacity: int) -> Column:
    """The greatest number of the grid of items of this size that fit together; empty items are of the last class."""
    fits = F.floor(F.lit(capacity) / F.greatest(size, F.lit(1))).cast("int")
    ks = grid(capacity)
    # 1 to 40 stand for themselves; beyond, the last step of the grid that is not greater
    beyond = F.array_max(F.filter(F.array(*[F.lit(k) for k in ks if k >= 40]), lambda k: k <= fits)) if capacity >= 40 else fits
    return F.when(fits <= 40, F.least(fits, F.lit(ks[-1]))).otherwise(beyond)


def _first_fit(capacity: int):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "_tm_id", "piece"], ascending=[False, True, True], kind="stable")
        free: list[int] = []
        at = []
        for n in items["tokens"]:
            for i, room in enumerate(free):
                if room >= n:
                    break
            else:
                i = len(free)
                free.append(capacity)
            free[i] -= n
            at.append(f"rest/{i}")
        return items.assign(container=at)[["_tm_id", "piece", "tokens", "container"]]

    return pack


def pack(sizes: DataFrame, ident: str, tokens: str, capacity: int, workers: int | None = None) -> DataFrame:
    """Each item's container: (ident, ``piece``, ``token_from``, ``token_to``, ``tokens``, ``container``).

    An item of at most ``capacity`` tokens is one piece 0. A longer one is cut into consecutive pieces of ``capacity``
    tokens, each a container of its own, and a last piece that is packed like an item. NULL sizes count as 0; empty
    items are packed too (up to ``capacity`` of them fill a container). ``ident`` must be unique and not NULL, other
    rows raise. An empty table gives none. The same input gives the same containers whatever the partitioning.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    items = scratch.materialize(sizes.select(F.col(ident).alias("_tm_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("int").alias("_tm_all")), "sizes")
    counted = items.agg(F.count(F.lit(1)).alias("n"), F.count("_tm_id").alias("k"), F.coalesce(F.min("_tm_all"), F.lit(0)).alias("low")).first()
    if counted.n != counted.k or counted.low < 0:
        raise ValueError("idents must not be NULL, sizes not negative")
    if items.groupBy("_tm_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count():
        raise ValueError("idents must be unique")
    workers = workers or max(8, -(-counted.n // WORKER_ITEMS))
    last = F.floor(F.greatest(F.col("_tm_all") - 1, F.lit(0)) / capacity).cast("int")
    pieces = items.select("_tm_id", "_tm_all", F.explode(F.sequence(F.lit(0), last)).alias("piece")).withColumn("tokens", F.least(F.lit(capacity), F.col("_tm_all") - F.col("piece") * capacity))
    k = _class_of(F.col("tokens"), capacity)
    pieces = pieces.withColumn("k", k).withColumn("w", F.pmod(F.xxhash64("_tm_id", "piece"), F.lit(workers)).cast("int")).drop("_tm_all")
    pieces = scratch.materialize(pieces, "pieces")
    order = [F.col("tokens").desc(), F.col("_tm_id"), F.col("piece")]

    def fill(rows: DataFrame, where: list[str], label: Column) -> DataFrame:
        """Full containers of k items within each group ``where``; NULL container for the items left."""
        group = W.partitionBy(*where)
        rows = rows.withColumn("r", F.row_number().over(group.orderBy(*order)) - 1).withColumn("full", F.floor(F.count(F.lit(1)).over(group) / F.col("k")) * F.col("k"))
        return rows.withColumn("container", F.when(F.col("r") < F.col("full"), F.concat(label, F.lit("/"), F.floor(F.col("r") / F.col("k")).cast("string")))).drop("r", "full")

    local = F.concat_ws("/", F.lit("class"), F.col("k").cast("string"), F.col("w").cast("string"))
    large = fill(pieces.where(F.col("k") <= LARGE), ["k", "w"], local)
    large = scratch.materialize(large, "large")

    # Slots: the room of every full container goes to one small class, drawn by that class's share of the small items.
    small = pieces.where(F.col("k") > LARGE)
    supply = [(r.k, r.n) for r in small.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").collect()]  # as many rows as the grid has
    boxes = large.where(F.col("container").isNotNull()).groupBy("container").agg((F.lit(capacity) - F.sum("tokens")).alias("room"))
    drawn = _drawn_class(F.col("room"), F.col("container"), supply, capacity)
    slots = boxes.withColumn("k", drawn).where(F.col("k").isNotNull()).withColumn("w", F.pmod(F.xxhash64("container"), F.lit(workers)).cast("int"))
    slots = slots.select("k", "w", "container", F.explode(F.sequence(F.lit(1), F.floor(F.col("room") * F.col("k") / capacity).cast("int"))).alias("s"))
    slots = slots.select("k", "w", "container", (F.row_number().over(W.partitionBy("k", "w").orderBy("container", "s")) - 1).alias("r"))
    placed = small.withColumn("r", F.row_number().over(W.partitionBy("k", "w").orderBy(*order)) - 1).join(slots, ["k", "w", "r"], "left").drop("r")
    placed = scratch.materialize(placed, "placed")

    filled = scratch.materialize(fill(placed.where(F.col("container").isNull()).drop("container"), ["k", "w"], local), "filled")
    left = large.where(F.col("container").isNull()).unionByName(filled.where(F.col("container").isNull())).drop("container")
    # Up the tree: fewer than k items per class and worker are left.
    levels, number, level = [], workers, 0
    while number > 1 or level == 0:
        number, level = -(-number // FAN_IN), level + 1
        joint = fill(left.withColumn("w", F.floor(F.col("w") / FAN_IN).cast("int")), ["k", "w"], F.concat_ws("/", F.lit(f"joint{level}"), F.col("k").cast("string"), F.col("w").cast("string")))
        levels.append(scratch.materialize(joint, "joint"))
        left = levels[-1].where(F.col("container").isNull()).drop("container")
    rest = left.select("_tm_id", "piece", "tokens", F.lit(0).alias("all")).groupBy("all").applyInPandas(_first_fit(capacity), levels[-1].select("_tm_id", "piece", "tokens", "container").schema)
    parts = [x.where(F.col("container").isNotNull()).select("_tm_id", "piece", "tokens", "container") for x in (large, placed, filled, *levels)] + [rest]
    scratch.release(items, pieces)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    start = (F.col("piece") * capacity).cast("long")
    return out.select(F.col("_tm_id").alias(ident), "piece", start.alias("token_from"), (start + F.col("tokens")).alias("token_to"), "tokens", "container")


def _drawn_class(room: Column, container: Column, supply: list[tuple[int, int]], capacity: int) -> Column:
    """A small class whose items fit into the room, drawn by the container's hash in proportion to the tokens each holds."""
    if not supply:
        return F.lit(None).cast("int")
    steps, total = [], 0.0
    for k, n in sorted(supply):
        total += n / k
        steps.append(F.struct(F.lit(k).alias("k"), F.lit(total).alias("upto")))
    table = F.array(*steps)
    # The classes that fit are those from some k on, since larger k are smaller items.
    before = F.coalesce(F.array_max(F.transform(F.filter(table, lambda x: x.k * room < capacity), lambda x: x.upto)), F.lit(0.0))
    target = before + F.pmod(F.xxhash64(container, F.lit("slot")), F.lit(1_000_000)) / 1_000_000 * (F.lit(total) - before)
    # Bound to a variable, or the target would be computed anew for every class.
    drawn = F.transform(F.array(target), lambda t: F.get(F.filter(table, lambda x: (x.upto > t) & (x.k * room >= capacity)), F.lit(0)).k)
    return F.get(drawn, F.lit(0))

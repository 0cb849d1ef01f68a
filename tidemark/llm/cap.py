"""Capping the records of dominant contributors with an incremental state table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import scratch

SALTS = 16
#: Batches after which all top lists are written together.
COMPACT = 4


def ranking(df: DataFrame, score: str, ident: str) -> Column:
    """A struct that sorts ascending in keeping order: highest score first, NULL and NaN last, then ``ident``."""
    kind = dict(df.dtypes)[score]
    if kind in ("double", "float"):
        value, zero = F.nanvl(F.col(score), F.lit(None)).cast("double"), F.lit(0.0)
    else:
        value, zero = F.col(score).cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")
    return F.struct(value.isNull().alias("absent"), (-F.coalesce(value, zero)).alias("down"), F.col(ident).alias("tie"))


class CapState:
    """Keeps the best ``limit`` records of each contributor group over any number of batches.

    The state lies under ``path`` as one generation per batch: rows of fate "kept" hold the complete top list of every group the
    batch changed (``place`` = ``limit`` is the group's cutoff), those of fate "displaced" log the records that came out. A
    group's latest generation is its state. Every ``COMPACT`` batches all top lists are written together, so a batch reads
    one such table and fewer than ``COMPACT`` generations, however many came before. Applying a batch again under its number replaces it.

    Records have unique ``ident`` within a group. A record may come any number of times, in one batch or several: it counts
    once, with the best score it has come with, so one that comes again with a better score may enter. A record that is kept is
    never in the log's result. A NULL group value or ident forms no group: such rows are neither kept nor logged. NULL and NaN
    scores rank last.
    """

    def __init__(self, spark: SparkSession, groups: list[str], ident: str, score: str, limit: int, path: str | None = None):
        if limit < 1:
            raise ValueError("limit must be positive")
        self.spark, self.groups, self.ident, self.score, self.limit = spark, groups, ident, score, limit
        self.path = path or scratch.new_path(spark, "cap")
        self.generations: list[int] = []
        while scratch.exists(spark, f"{self._at(len(self.generations))}/_SUCCESS"):
            self.generations.append(len(self.generations))
        whole = len(self.generations) // COMPACT * COMPACT
        if whole and not scratch.exists(spark, f"{self._at(whole, 'whole')}/_SUCCESS"):
            self._compact(whole)  # the run ended between the two writes

    def _at(self, generation: int, of: str = "batches") -> str:
        return f"{self.path}/{of}/gen={generation:06d}"

    def _read(self, paths: list[str], of: str, fate: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{of}").parquet(*paths).where(F.col("fate") == fate)

    def kept(self) -> DataFrame | None:
        """The state: groups, ident, score, ``place`` 1..limit."""
        n = len(self.generations)
        if not n:
            return None
        whole = n // COMPACT * COMPACT
        columns = [*self.groups, self.ident, self.score, "place"]
        later = [self._at(g) for g in range(whole, n)]
        rows = self._read(later, "batches", "kept").select("gen", *columns) if later else None
        if whole:
            base = self._read([self._at(whole, "whole")], "whole", "kept").select(F.lit(-1).alias("gen"), *columns)
            rows = base if rows is None else base.unionByName(rows)
        if not later:
            return rows.select(columns)
        # No more rows a group than COMPACT top lists have.
        latest = rows.withColumn("_tm_latest", F.rank().over(W.partitionBy(*self.groups).orderBy(F.col("gen").desc())))
        return latest.where(F.col("_tm_latest") == 1).select(columns)

    def displaced(self) -> DataFrame | None:
        """The log: every record that is out, once."""
        if not self.generations:
            return None
        key = [*self.groups, self.ident]
        rows = self._read([self._at(g) for g in self.generations], "batches", "displaced").select(key).distinct()
        return rows.join(self.kept().select(key), key, "left_anti")

    def _salted(self, rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
        """Rows with their group's cutoff ``_tm_cut``, NULL if it has none; a hot group is spread over ``SALTS`` tasks."""
        copies = cutoffs.withColumn("_tm_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return rows.withColumn("_tm_s", F.pmod(F.xxhash64(self.ident), F.lit(SALTS))).join(copies, [*self.groups, "_tm_s"], "left").drop("_tm_s")

    def apply(self, batch: DataFrame) -> None:
        """Filter the batch against the cutoffs, merge the rest with the top lists, log what is displaced."""
        g, keys, number = self.groups, [F.col(c) for c in self.groups], len(self.generations)
        key = [*g, self.ident]

        def best(rows: DataFrame) -> DataFrame:
            """Each record once, with its best score."""
            one = rows.groupBy(*key).agg(F.min(F.struct("_tm_o", self.score)).alias("_tm_x"))
            return one.select(*key, F.col(f"_tm_x.{self.score}").alias(self.score), F.col("_tm_x._tm_o").alias("_tm_o"))

        rows = batch.select(*key, self.score)
        for c in key:
            rows = rows.where(F.col(c).isNotNull())
        rows = best(rows.withColumn("_tm_o", ranking(rows, self.score, self.ident)))
        state = self.kept()
        beaten = None
        contenders = rows
        if state is not None:
            state = state.withColumn("_tm_o", ranking(state, self.score, self.ident))
            judged = scratch.materialize(self._salted(rows, state.where(F.col("place") == self.limit).select(*g, F.col("_tm_o").alias("_tm_cut"))), "cap-judged")
            out = F.col("_tm_cut").isNotNull() & (F.col("_tm_o") > F.col("_tm_cut"))
            beaten = judged.where(out).select(key)
            fresh = judged.where(~out).drop("_tm_cut")
            old = state.drop("place").join(fresh.select(*g).distinct(), g, "left_semi")
            contenders = best(fresh.unionByName(old.select(fresh.columns)))
        contenders = scratch.materialize(contenders, "cap-contenders")
        salted = contenders.withColumn("_tm_s", F.pmod(F.xxhash64(self.ident), F.lit(SALTS)))
        first = salted.withColumn("_tm_rn", F.row_number().over(W.partitionBy(*keys, "_tm_s").orderBy("_tm_o"))).where(F.col("_tm_rn") <= self.limit)
        top = first.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("_tm_o"))).where(F.col("place") <= self.limit)
        top = scratch.materialize(top.select(*key, self.score, "_tm_o", "place"), "cap-top")
        lost = self._salted(contenders, top.where(F.col("place") == self.limit).select(*g, F.col("_tm_o").alias("_tm_cut"))).where(F.col("_tm_o") > F.col("_tm_cut")).select(key)
        gone = lost if beaten is None else lost.unionByName(beaten)
        columns = [*key, self.score, "place", "fate"]
        result = top.withColumn("fate", F.lit("kept")).select(columns)
        result = result.unionByName(gone.withColumn("fate", F.lit("displaced")), allowMissingColumns=True)
        result.write.mode("overwrite").parquet(self._at(number))
        scratch.release(contenders, top, *([judged] if state is not None else []))
        if (number + 1) % COMPACT == 0:
            self._compact(number + 1)
        self.generations.append(number)

    def _compact(self, upto: int) -> None:
        before = upto - COMPACT
        paths = [self._at(g) for g in range(before, upto)]
        columns = [*self.groups, self.ident, self.score, "place"]
        rows = self._read(paths, "batches", "kept").select("gen", *columns)
        if before:
            rows = rows.unionByName(self._read([self._at(before, "whole")], "whole", "kept").select(F.lit(-1).alias("gen"), *columns))
        latest = rows.withColumn("_tm_latest", F.rank().over(W.partitionBy(*self.groups).orderBy(F.col("gen").desc()))).where(F.col("_tm_latest") == 1)
        latest.select(*columns, F.lit("kept").alias("fate")).write.mode("overwrite").parquet(self._at(upto, "whole"))


def cap_share(df: DataFrame, scope: list[str], contributor: str, ident: str, score: str, share: float, least: int = 1) -> DataFrame:
    """Mark the records beyond each contributor's share of its scope: ``df`` with ``place`` and boolean ``kept``.

    A contributor may keep max(``least``, floor(``share`` x records of the scope)) records, best first; records without
    contributor count towards the scope. The limit
    grows with the scope, so no fixed top list decides; places come from a range sort over all rows, and only
    the counts of (range, group) pieces are summed up, so a hot group spreads over as many tasks as it needs.
    Rows with a NULL scope or contributor value are kept (``place`` NULL). Repeated rows each count.
    """
    if not 0 < share <= 1:
        raise ValueError("share must lie in (0, 1]")
    if not scope:
        df, scope = df.withColumn("_tm_all", F.lit(0)), ["_tm_all"]
    g = [*scope, contributor]
    names = [f"_tm_g{i}" for i in range(len(g))]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_tm_row"), *[F.col(c).alias(n) for c, n in zip(g, names)], ranking(df, score, ident).alias("_tm_o"))
    absent = F.greatest(*[F.col(n).isNull().cast("int") for n in names]) == 1
    ranged = rows.where(~absent).repartitionByRange(*[F.col(n) for n in names], F.col("_tm_o")).sortWithinPartitions(*names, "_tm_o")
    # Written before it is counted, so that a task that runs again can't move a row to another range.
    ranged = scratch.materialize(ranged.withColumn("_tm_p", F.spark_partition_id()), "share")
    pieces = ranged.groupBy(*names, "_tm_p").agg(F.count(F.lit(1)).alias("_tm_n"))
    before = W.partitionBy(*names).orderBy("_tm_p").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_tm_before", F.coalesce(F.sum("_tm_n").over(before), F.lit(0))).drop("_tm_n")
    scoped = rows.where(F.greatest(*[F.col(n).isNull().cast("int") for n in names[: len(scope)]]) == 0) if len(scope) > 1 else rows.where(F.col(names[0]).isNotNull())
    limits = scoped.groupBy(*names[: len(scope)]).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * F.lit(share))).alias("_tm_limit"))
    local = ranged.withColumn("_tm_rn", F.row_number().over(W.partitionBy(*names, "_tm_p").orderBy("_tm_o")))
    placed = local.join(pieces, [*names, "_tm_p"])
    placed = placed.join(limits, names[: len(scope)])
    place = (F.col("_tm_before") + F.col("_tm_rn")).alias("place")
    done = placed.select("_tm_row.*", place, (F.col("_tm_before") + F.col("_tm_rn") <= F.col("_tm_limit")).alias("kept"))
    return done.unionByName(rows.where(absent).select("_tm_row.*", F.lit(None).cast("long").alias("place"), F.lit(True).alias("kept"))).drop("_tm_all")

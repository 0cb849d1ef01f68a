"""Keyed writes to Parquet tables: upsert, insert if absent, replace.

Parquet has no keys, so a table is a set of folders, each the rows of one write, hashed by key into buckets: plain rows, whose
keys stand nowhere else, and *changes*, whose rows take the place of older ones of their key or delete them. A write
adds what it inserts and changes, reads only the buckets its keys lie in, and rewrites nothing; when the changes have grown to a
share of the table, the table is written anew. What belongs to the table stands in a manifest, and a write takes effect when its
manifest gets its name, in one rename: a write that fails anywhere before leaves the table as it was. The folders of the
last version but one stay for readers that have begun. A table has one writer at a time.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.schemas import KEYS, empty_table, schema

#: Changes are merged into the table when there are so many folders of them, or rows for each plain row.
MERGE_FOLDERS, MERGE_SHARE = 16, 0.5
#: Bytes that a bucket shall have when a table is written anew.
BUCKET_BYTES = 256 << 20


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests -----------------------------------------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifests(self, name: str) -> list[str]:
        return [f"{self.root}/{name}/manifest/{x}" for x in self._names(f"{self.root}/{name}/manifest") if x.startswith("v") and x.endswith(".json")]

    def _load(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self, name: str) -> dict:
        found = self._manifests(name)
        return self._load(found[-1]) if found else {"version": 0, "buckets": self.buckets, "parts": []}

    def _publish(self, name: str, manifest: dict) -> None:
        folder = f"{self.root}/{name}/manifest"
        staged, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/v{manifest['version']:012d}.json")
        stream = self._fs.create(staged)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"{name}: another writer has published version {manifest['version']}")
        self._sweep(name)

    def _sweep(self, name: str) -> None:
        """Delete manifests before the last two and folders that neither names."""
        manifests = self._manifests(name)
        for path in manifests[:-2]:
            scratch.remove(self.spark, path)
        used = {p["folder"] for path in manifests[-2:] for p in self._load(path)["parts"]}
        for folder in self._names(f"{self.root}/{name}/data"):
            if folder not in used:
                scratch.remove(self.spark, f"{self.root}/{name}/data/{folder}")

    # -- reading and writing -------------------------------------------------------------------------------------

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(KEYS[name][0])), F.lit(buckets)).cast("int")

    def _rows(self, name: str, manifest: dict, kind: str) -> DataFrame | None:
        paths = [f"{self.root}/{name}/data/{p['folder']}" for p in manifest["parts"] if p["kind"] == kind]
        if not paths:
            return None
        kinds = f"{schema(name).toDDL()}, _tm_gone boolean, _tm_version bigint, _tm_part string, _tm_bucket int"
        return self.spark.read.schema(kinds).option("basePath", f"{self.root}/{name}/data").parquet(*paths)

    def read(self, name: str, within: list[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        manifest, columns, key = self._current(name), schema(name).names, KEYS[name]
        plain, changes = (self._rows(name, manifest, kind) for kind in ("plain", "change"))
        if plain is None and changes is None:
            return empty_table(self.spark, name)
        if within is not None:
            plain, changes = (x if x is None else x.where(F.col("_tm_bucket").isin(within)) for x in (plain, changes))
        if changes is None:
            return plain.select(columns)
        newest = changes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.max_by(F.struct(*columns, "_tm_gone"), "_tm_version").alias("r"))
        keys = newest.select(*[F.col(f"_k_{k}").alias(k) for k in key])
        many = [p for p in manifest["parts"] if p["kind"] == "change"]
        if sum(p["rows"] for p in many) <= scratch.BROADCAST_ROWS and sum(p["bytes"] for p in many) <= scratch.BROADCAST_BYTES:
            keys = F.broadcast(keys)
        else:
            keys = keys.hint("merge")  # Spark would go by the compressed bytes
        changed = newest.where(~F.col("r._tm_gone")).select("r.*").select(columns)
        return changed if plain is None else plain.join(keys, key, "left_anti").select(columns).unionByName(changed)

    def _commit(self, name: str, plain: DataFrame | None = None, change: DataFrame | None = None, anew: bool = False) -> None:
        """Publish the next version: the parts so far (none if ``anew``) and these rows; ``change`` may have a column _tm_gone."""
        manifest = self._current(name)
        version = manifest["version"] + 1
        size = sum(p["bytes"] for p in manifest["parts"])
        buckets = max(self.buckets, -(-size // BUCKET_BYTES)) if anew else manifest["buckets"]
        parts = [] if anew else list(manifest["parts"])
        for kind, rows in (("plain", plain), ("change", change)):
            if rows is None:
                continue
            folder = f"_tm_part={version:012d}-{kind}-{uuid.uuid4().hex[:8]}"
            path = f"{self.root}/{name}/data/{folder}"
            gone = F.coalesce(F.col("_tm_gone"), F.lit(False)) if "_tm_gone" in rows.columns else F.lit(False)
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name)]
            rows = rows.select(*columns, gone.alias("_tm_gone"), F.lit(version).cast("long").alias("_tm_version")).withColumn("_tm_bucket", self._bucket(name, buckets))
            rows.repartition("_tm_bucket").write.partitionBy("_tm_bucket").parquet(path)
            n = self.spark.read.schema("_tm_version long").parquet(path).count()
            if n:
                parts.append({"folder": folder, "kind": kind, "rows": n, "bytes": self._fs.getContentSummary(self._path(path)).getLength()})
        self._publish(name, {"version": version, "buckets": buckets, "parts": parts})
        scratch.tidy(self.spark)
        changes = [p for p in parts if p["kind"] == "change"]
        if not anew and (len(parts) > 4 * MERGE_FOLDERS or len(changes) > MERGE_FOLDERS or sum(p["rows"] for p in changes) > MERGE_SHARE * sum(p["rows"] for p in parts if p["kind"] == "plain")):
            self.replace(name, self.read(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table becomes these rows. ``rows`` may come from the table itself."""
        self._commit(name, plain=rows, anew=True)

    def _merge(self, name: str, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame] | None) -> tuple[int, int]:
        """Insert the rows of a batch with unique keys whose key is new; known ones become what ``merged`` makes of the old
        rows and the batch, or stay if it is None. Returns how many were new and known."""
        key = KEYS[name]
        buckets = self._current(name)["buckets"]
        touched = [r.b for r in batch.select(self._bucket(name, buckets).alias("b")).distinct().collect()]  # no more than there are buckets
        old = scratch.join_checked(self.read(name, touched), batch.select(*key), key, "left_semi", key[-1])
        old = scratch.materialize(old.select(schema(name).names), "known")
        known = old.count()
        new = batch.join(old.select(*key), key, "left_anti")
        self._commit(name, plain=new, change=merged(old, batch.join(old.select(*key), key, "left_semi")) if merged and known else None)
        scratch.release(old)
        return batch.count() - known, known

    # -- rules of the tables -------------------------------------------------------------------------------------

    def upsert_posts(self, batch: DataFrame, order: Column | None = None) -> tuple[int, int]:
        """Insert new posts; of known ones refresh engagement (also to NULL), and age and karma where the batch has them.

        Text and times keep their first values. Of several rows of one id in the batch the last by ``order`` (default
        collected_at) counts. Returns how many were inserted and updated.
        """
        new = scratch.materialize(last_per_key(batch, KEYS["posts"], order if order is not None else F.col("collected_at")).select(schema("posts").names), "batch")
        done = self._merge("posts", new, merge_posts)
        scratch.release(new)
        return done

    def insert_absent(self, name: str, rows: DataFrame, order: Column | None = None) -> int:
        """Insert rows whose key isn't there; existing ones stay. Of several in the batch the last by ``order`` counts, else
        by all columns. Returns how many were stored."""
        new = scratch.materialize(last_per_key(rows.select(schema(name).names) if order is None else rows, KEYS[name], order if order is not None else F.lit(0)).select(schema(name).names), "batch")
        done, _ = self._merge(name, new, None)
        scratch.release(new)
        return done

    def upsert(self, name: str, rows: DataFrame, order: Column) -> None:
        """Rows replace those of their key; of several in the batch the last by ``order`` counts."""
        new = scratch.materialize(last_per_key(rows, KEYS[name], order).select(schema(name).names), "batch")
        self._merge(name, new, lambda old, batch: batch)
        scratch.release(new)

    def upsert_prices(self, bars: DataFrame, order: Column) -> None:
        """As :meth:`upsert`, with volumes rounded half to even; bars without close are dropped."""
        kept = bars.where(F.col("close").isNotNull() & ~F.isnan("close")).withColumn("volume", F.bround("volume").cast("long"))
        self.upsert("prices_daily", kept, order)

    def replace_post_tickers(self, touched: DataFrame, matches: DataFrame) -> int:
        """New matches for the touched posts (post_id); tags given by the source survive and win. Returns rows stored."""
        posts = scratch.materialize(touched.select("post_id").distinct(), "touched")
        buckets = self._current("post_tickers")["buckets"]
        within = [r.b for r in posts.select(self._bucket("post_tickers", buckets).alias("b")).distinct().collect()]
        old = scratch.join_checked(self.read("post_tickers", within), posts, ["post_id"], "left_semi", "ticker")
        old = scratch.materialize(old.select(schema("post_tickers").names), "tagged")
        new = scratch.materialize(retag(old, posts, matches.join(posts, "post_id", "left_semi")), "tags")
        key = KEYS["post_tickers"]
        gone = old.join(new.select(*key), key, "left_anti").withColumn("_tm_gone", F.lit(True))
        fresh = new.join(old.select(*key), key, "left_anti")
        kept = new.join(old.select(*key), key, "left_semi").withColumn("_tm_gone", F.lit(False))
        self._commit("post_tickers", plain=fresh, change=kept.unionByName(gone))
        stored = new.where(F.col("match_type") != "source").count()
        scratch.release(posts, old, new)
        return stored

    def add_source_tags(self, posts: DataFrame, confidence: float, universe: DataFrame | None, now: Column) -> None:
        """Tickers the source itself names, and its stated mood as a score of the model ``<source>_tag``."""
        tags = source_tags(posts, universe)
        matches = tags.select("post_id", "ticker", F.lit("source").alias("match_type"), F.lit(confidence).alias("confidence"))
        self.upsert("post_tickers", matches, F.lit(0))
        scored = tags.where(F.col("mood").isNotNull())
        label = F.when(F.col("mood") > 0, "pos").when(F.col("mood") < 0, "neg").otherwise("neu")
        self.insert_absent("post_scores", scored.select("post_id", "ticker", F.concat("source", F.lit("_tag")).alias("model"), label.alias("label"), F.col("mood").cast("double").alias("score"), now.alias("scored_at")))

    def replace_guarded(self, name: str, rows: DataFrame, known: str, least: float) -> None:
        """Full replace, refused when the rows are empty or too few have the column ``known``."""
        rows = scratch.materialize(rows, "guarded")
        share = rows.agg(F.avg(F.col(known).isNotNull().cast("double"))).first()[0]
        if share is None or share < least:
            raise ValueError(f"{name}: share of rows with {known} is {share}, {least} are needed")
        self.replace(name, rows)
        scratch.release(rows)

    def write_week(self, week_start, signals: DataFrame) -> None:
        """Replace one week's signals; NaN and empty events become NULL."""
        rows = signals.withColumn("week_start", F.lit(week_start))
        doubles = [f.name for f in schema("weekly_signals") if f.dataType.simpleString() == "double" and f.name in rows.columns]
        rows = rows.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in doubles})
        for f in schema("weekly_signals"):
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        rows = rows.withColumn("events", F.nullif(F.col("events"), F.lit("")))
        new = scratch.materialize(last_per_key(rows.select(schema("weekly_signals").names), KEYS["weekly_signals"], F.lit(0)), "week")
        old = scratch.materialize(self.read("weekly_signals").where(F.col("week_start") == F.lit(week_start)), "week-before")
        known = new.select("ticker")
        gone = old.join(known, "ticker", "left_anti").select(old.columns).withColumn("_tm_gone", F.lit(True))
        kept = new.join(old.select("ticker"), "ticker", "left_semi").select(new.columns).withColumn("_tm_gone", F.lit(False))
        self._commit("weekly_signals", plain=new.join(old.select("ticker"), "ticker", "left_anti").select(new.columns), change=kept.unionByName(gone))
        scratch.release(new, old)


def last_per_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key: the last by ``order``, ties by all columns."""
    everything = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.max(F.struct(order.alias("o"), everything.alias("r"))).alias("m")).select("m.r.*")


def merge_posts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge by id, column by column."""
    o, n = old.alias("o"), new.alias("n")
    seen, fresh = F.col("o.id").isNotNull(), F.col("n.id").isNotNull()
    columns = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "engagement":
            value = F.when(fresh, b).otherwise(a)
        elif c in ("author_age_days", "author_karma"):
            value = F.coalesce(b, a)
        else:
            value = F.when(seen, a).otherwise(b)
        columns.append(value.alias(c))
    return o.join(n, F.col("o.id") == F.col("n.id"), "full_outer").select(*columns)


def absent_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, one per key (the last by all columns), whose key isn't in ``old``."""
    return last_per_key(new, key, F.lit(0)).join(old.select(*key), key, "left_anti").select(new.columns)


def overwrite_rows(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.join(new.select(*key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def retag(old: DataFrame, touched: DataFrame, matches: DataFrame) -> DataFrame:
    given = F.col("match_type") == "source"
    kept = old.where(given).unionByName(old.where(~given).join(touched.select("post_id").distinct(), "post_id", "left_anti").select(old.columns))
    best = last_per_key(matches.select(old.columns), ["post_id", "ticker"], F.col("confidence"))
    return kept.unionByName(best.join(kept.select("post_id", "ticker"), ["post_id", "ticker"], "left_anti").select(old.columns))


def source_tags(posts: DataFrame, universe: DataFrame | None) -> DataFrame:
    """(post_id, ticker, source, mood) of ``source_tickers``, distinct, only those of the universe if given."""
    tags = posts.select(F.col("id").alias("post_id"), "source", F.col("source_sentiment").alias("mood"), F.explode(F.array_distinct("source_tickers")).alias("ticker"))
    return tags if universe is None else tags.join(universe.select("ticker").distinct(), "ticker", "left_semi").select(tags.columns)


def report_json(parts: dict) -> str:
    """A report of scalars, rows and small DataFrames; NaN becomes null. Frames must be summaries: they come to the driver."""

    def plain(x):
        if isinstance(x, DataFrame):
            return [plain(r.asDict(True)) for r in x.collect()]
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and math.isnan(x) else x

    return json.dumps({k: plain(v) for k, v in parts.items()}, default=str, indent=2)


def report_table(table: DataFrame, rows: str, columns: str, values: list[str], value: str) -> DataFrame:
    """One row per ``rows`` value, one column per value of ``columns``."""
    return table.groupBy(rows).pivot(columns, values).agg(F.first(value))



"""The pN_ queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.keys import canonical_ticker, community_key, current_rows, folded, table
from tidemark.llm.cap import CapState, cap_share
from tidemark.llm.leakage import leaked_passages, leaked_runs
from tidemark.llm.lines import frequent_lines, remove_lines
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from tidemark.llm.packing import pack, token_counts
from tidemark.llm.sentences import sentences
from tidemark.llm.topn import top_n

#: Posts of one author on one ticker in one week that may stay, and the batches in which posts arrive.
AUTHOR_LIMIT, ARRIVAL_BATCHES = 5, 3


def ticker_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (post_id, canonical ticker)."""
    return table(spark, sf_dir, "post_tickers").select("post_id", canonical_ticker("ticker").alias("ticker")).distinct()


def _authored(spark: SparkSession, sf_dir: str, known: bool = True) -> DataFrame:
    posts = current_rows(table(spark, sf_dir, "posts"), "id", "collected_at", ["author_id", "created_at", "engagement", "collected_at"])
    # A week runs from Saturday to Saturday; it is named by its Saturday.
    saturday = F.date_sub(F.next_day(F.to_date("created_at"), "SAT"), 7)
    posts = posts.select(F.col("id").alias("post_id"), folded("author_id").alias("author"), saturday.alias("week"), "engagement", "collected_at")
    return ticker_pairs(spark, sf_dir).join(posts.where(F.col("author").isNotNull()) if known else posts, "post_id")


def _capped(spark: SparkSession, sf_dir: str) -> CapState:
    """Posts arrive in batches by collection time; each batch runs against the state of the earlier ones."""
    rows = scratch.materialize(_authored(spark, sf_dir).withColumn("_tm_at", F.unix_micros(F.col("collected_at").cast("timestamp"))), "arrivals")
    shares = [i / ARRIVAL_BATCHES for i in range(1, ARRIVAL_BATCHES)]
    bounds = rows.select(F.percentile_approx("_tm_at", shares, 1000)).first()[0] or []
    state = CapState(spark, ["author", "ticker", "week"], "post_id", "engagement", AUTHOR_LIMIT)
    at, edges = F.coalesce(F.col("_tm_at"), F.lit(0)), [None, *sorted(set(bounds)), None]
    for low, high in zip(edges, edges[1:]):
        batch = rows
        batch = batch if low is None else batch.where(at > low)
        batch = batch if high is None else batch.where(at <= high)
        state.apply(batch)
    return state


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).displaced().select("post_id", "ticker").distinct()


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).kept().select("author", "ticker", F.date_format("week", "yyyy-MM-dd").alias("week"), "post_id", "place")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of one author beyond a tenth of a ticker's posts, those without author counted."""
    marked = cap_share(_authored(spark, sf_dir, known=False), ["ticker"], "author", "post_id", "engagement", 0.1)
    return marked.where(~F.col("kept")).select("post_id", "ticker", F.col("place").cast("long").alias("place"))


def _repeated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    posts = table(spark, sf_dir, "posts")
    return posts, frequent_lines(posts, "id", community_key("community"), "body", min_docs=10)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeated(spark, sf_dir)[1].select(F.col("id").alias("post_id"), F.col("line_no").cast("int").alias("line_no"))


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand in a twentieth of their community's posts, and in three at least."""
    hits = frequent_lines(table(spark, sf_dir, "posts"), "id", community_key("community"), "body", min_docs=3, min_share=0.05)
    return hits.select(F.col("id").alias("post_id"), F.col("line_no").cast("int").alias("line_no"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, hits = _repeated(spark, sf_dir)
    return remove_lines(posts.select("id", "collected_at", "body"), hits, "id", "body").select("id", "collected_at", "body")


def usable_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (ticker, date) with a close that is not NULL, not NaN and above 0, and the time the bar stands at."""
    bars = table(spark, sf_dir, "prices_daily").where(F.col("close").isNotNull() & ~F.isnan("close") & (F.col("close") > 0))
    bars = bars.select(canonical_ticker("ticker").alias("ticker"), "date").distinct()
    return bars.withColumn("bar_at", (F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 21 HOURS")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "sec_filings").where(F.col("accepted_at").isNotNull())
    filings = filings.select("accession", canonical_ticker("ticker").alias("ticker"), "accepted_at").distinct()
    pairs = nearest_in_time(filings, usable_bars(spark, sf_dir), "ticker", "accepted_at", "bar_at", 48 * 3600)
    return pairs.where(F.col("matched").isNotNull()).select("accession", "ticker", F.date_format("matched.date", "yyyy-MM-dd").alias("bar_date")).distinct()


def post_text():
    """Title, line break, body; NULL as empty."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, sf_dir, "posts"), "id", post_text(), width=3, threshold=0.6)


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "posts"), "id", post_text(), width=3, threshold=0.6)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "weekly_signals")
    monday = F.date_sub(F.next_day("week_start", "MON"), 7)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"composite_{s}").alias("value")) for s in ("bull", "bear")]))
    rows = rows.select(monday.alias("week"), canonical_ticker("ticker").alias("ticker"), sides.alias("s")).select("week", "ticker", "s.side", (F.col("s.value") + F.lit(0.0)).alias("value"))
    best = rows.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("week", "side", "ticker").agg(F.max("value").alias("value"))
    top = top_n(best, ["week", "side"], "value", "ticker", 10)
    return top.select(F.date_format("week", "yyyy-MM-dd").alias("week_start"), "side", "ticker")


#: Tokens per container.
CAPACITY = 2048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens", CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the least possible number, and the share of room used."""
    packed = p7_containers(spark, sf_dir)
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.max("t").cast("long").alias("fullest"), F.sum("n").cast("long").alias("pieces"), F.sum("t").cast("long").alias("tokens"), F.ceil(F.sum("t") / CAPACITY).alias("least_containers"), F.round(F.sum("t") / (F.count(F.lit(1)) * CAPACITY), 4).alias("used"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document packed by its number of characters: its pieces, their sum, and whether none of their containers is
    overfull and all of them follow one another."""
    packed = scratch.materialize(pack(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 2 * CAPACITY), "packed")
    full = packed.groupBy("container").agg((F.sum("tokens") <= 2 * CAPACITY).alias("fits"))
    per = packed.join(full, "container").groupBy("doc_id")
    chain = F.sum("token_to") - F.sum("token_from") == F.max("token_to")
    return per.agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").cast("long").alias("tokens"), (F.bool_and("fits") & chain & (F.countDistinct("piece") == F.count(F.lit(1)))).alias("right"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and reworded passages with what was measured on each."""
    rows = leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return rows.select("doc_id", "item_id", "run", *[F.round(c, 4).alias(c) for c in ("cosine", "common", "answer")])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("sent_start", "sent_end")])


def p9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "sent_no", "sentence")


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_share, p3_found, p3_share, p3_cleaned, p4_found, p5_found, p5_classes, p6_found, p7_containers, p7_fill, p7_whole, p8_found, p8_paraphrases, p9_found, p9_sentences)}

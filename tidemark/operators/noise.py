"""Noise filters over mention rows (one row per post and ticker)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.text import classify, hamming, headline_key, matches_any, mentions_name, simhash, simhash_words

# Kinds of headline and the patterns that tell them, in the order in which they are tried.
MOVE = r"(soar|jump|plunge|plummet|tumble|surge|sink|sank|slump|fall|fell|rise|rose|rall(y|ie)|drop|climb|gain|slide|slid|spike|crash|pop|rocket|skyrocket|dip|rebound|tripl|doubl|halv)\w*"
PRESS_RELEASE = [
    r"^(?!.*\bamong\b).{0,60}\bannounces?\b", r"\bdeclares?\b.{0,40}\bdividend\b", r"\bto (report|release|announce)\b.{0,60}\b(results|earnings)\b", r"\b(conference call|earnings call|webcast)\b",
    r"\bto (participate|present) (in|at)\b", r"\bprices?\b.{0,30}\b(offering|notes)\b", r"\bcompletes? (acquisition|merger|offering)\b", r"\bappoints?\b",
]
PROMO = [
    r"^\s*\d+\s+\S+.{0,40}\b(stocks?|etfs?|reasons)\b", r"\b(stocks?|etfs?) to (buy|own|hold|sell|avoid|watch)\b", r"\bis (it )?.{0,50}\ba (buy|sell|smart buy|good buy)\b", r"\bshould you (buy|sell)\b",
    r"\bbetter\b.{0,40}\b(buy|bet|stock|pick)\b", r"\bbetter than\b", r"\bbuy\b.{0,30}\binstead\b", r"\b(buy|own|hold)\b.{0,15}\b(forever|for the next|through the next|for decades|never sell)\b",
    r"\bmillionaire\b", r"\bmake you rich\b", r"\bset you up for life\b", r"\bi'?d\b", r"\bi'?m (still )?(buying|selling|adding)\b", r"\bmy (top|favorite|favourite|best)\b", r"\bdon'?t (sell|buy)\b",
    r"\bshould own\b", r"\baway from this stock\b", r"\bjim cramer\b", r"\bhistory says\b", r"\btoo late to buy\b", r"\b(with|invest(ing)?|invested|split) \$[\d,]+\b", r"\btime to (buy|sell)\b",
    r"\byou'?d need\b", r"\$[\d,]+ investment\b", r"\b(no-brainer|screaming buy|unstoppable|magnificent seven stocks?)\b", r"\b(here'?s|the) (1 |one )?reason\b", r"\b(trade|opportunity) of the (decade|century)\b", r"\bignore them\b",
]
PRICE_RECAP = [
    rf"\bwhy\b.{{0,80}}\b(stock|shares|stocks)\b.{{0,60}}\b{MOVE}", rf"\b{MOVE}\b.{{0,40}}\b\d+(\.\d+)?\s?%", r"\b(is|are|was|were)\s+(up|down)\s+\d+(\.\d+)?\s?%", r"\b\d+(\.\d+)?\s?%\s+(below|above|off)\s+(its|their)\s+(high|low|peak)",
    r"\b52-week (high|low)s?\b", r"\bwhat'?s going on with\b", r"\b(stock|shares) (is|are) (moving|trading (higher|lower))\b", r"\bhow (they'?re|it'?s) performing\b", r"\b(biggest|top) (gainers|losers|movers)\b",
    r"\b(climbed|jumped|dropped|fell|surged|rose|soared|plunged|slid|tumbled|sank|rallied)\b,?\s+(what|why|here'?s)\b",
]
FORECAST = [r"\b(could|may|might|will|predicts?|forecasts?|before it|set to|poised to|expects?)\b"]
RELEASE_OUTLETS = ["business wire", "businesswire", "pr newswire", "prnewswire", "globenewswire", "accesswire", "newsfile", "accesswire.com", "globe newswire"]
SPAM = [r"join (my|our) (discord|telegram)", r"t\.me/", r"discord\.gg/", r"free (stock )?signals", r"\bdm me\b", r"whatsapp", r"guaranteed (gains|returns|profit)"]


#: Rows up to which what the filters have found is broadcast; the driver holds it several times over while it does so.
FEW = 20_000


def headline_kind(title: Column, outlet: Column | None = None) -> Column:
    """press_release, promo, price_recap or news, judged from the headline (and the outlet)."""
    rules = [("press_release", PRESS_RELEASE), ("promo", PROMO), ("price_recap", PRICE_RECAP)]
    return classify(title, rules, "news", outlet, {"press_release": RELEASE_OUTLETS}, {"price_recap": FORECAST})


def _first_per_key(df: DataFrame, key: Column, by: list[str]) -> DataFrame:
    """Rows without a key, and all rows of the earliest post of each key within ``by``.

    The earliest is found by aggregation (one row per key and task moves) and joined back, so a key with a third of
    all rows isn't gathered in one task; ties by post_id.
    """
    df = df.withColumn("_tm_key", key)
    first = df.where(F.col("_tm_key").isNotNull()).groupBy(*by, "_tm_key").agg(F.min(F.struct("created_at", "post_id")).alias("_tm_first"))
    winners = first.select(*by, F.col("_tm_first.post_id").alias("post_id"), "_tm_key")
    kept = df.where(F.col("_tm_key").isNotNull()).join(winners, [*by, "post_id", "_tm_key"], "left_semi")
    columns = df.drop("_tm_key").columns
    return kept.select(columns).unionByName(df.where(F.col("_tm_key").isNull()).select(columns))


def _shared_only(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``key`` NULL where only one post has it. Such a post is the earliest of its key in every group, so
    :func:`_first_per_key` keeps its rows either way, but needn't move them."""
    posts = df.where(F.col(key).isNotNull()).groupBy(key).agg((F.min("post_id") != F.max("post_id")).alias("_tm_shared"))
    shared = scratch.materialize(posts.where("_tm_shared"), "shared")
    marked = scratch.join_checked(df, shared, [key], "left", "post_id", FEW).withColumn(key, F.when(F.col("_tm_shared"), F.col(key))).select(df.columns)
    out = scratch.materialize(marked, "marked")
    scratch.release(shared)
    return out


def drop_reposts(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Only the earliest post of each content hash (within ``by``), with all its rows; rows without a hash stay."""
    return _first_per_key(df, F.col("content_hash"), by)


def drop_syndicated(df: DataFrame, sources: list[str], unicode: bool = False, by: list[str] = []) -> DataFrame:
    """Only the earliest post of each headline among ``sources``; rows of other sources or without headline stay.

    Headlines are compared by their ASCII letters and digits, or with ``unicode`` by all letters and digits.
    """
    return _first_per_key(df, F.when(F.col("source").isin(sources), headline_key(F.col("title"), unicode)), by)


def drop_spam(df: DataFrame, patterns: list[str] = SPAM) -> DataFrame:
    return df.where(~matches_any(patterns, F.col("title"), F.col("body")))


def similar_hash_pairs(hashes: DataFrame, column: str, max_hamming: int, pieces: int | None = None) -> DataFrame:
    """Pairs (x, y), x < y as longs, of distinct hashes at most ``max_hamming`` bits apart; exact.

    Two such hashes agree in all but ``max_hamming`` of ``pieces`` slices, so they share one combination of the rest.
    More pieces make longer keys: with 6 and a distance of 3 a key has 32 bits, so buckets stay small at any size
    that matters, for 20 entries a hash; with 4 it has 16 bits and 4 entries. Never broadcast: Spark takes the entries for
    as few as the hashes.
    """
    pieces = pieces or max_hamming + 3
    width = 64 // pieces
    edges = [(i * width, 64 - (pieces - 1) * width if i == pieces - 1 else width) for i in range(pieces)]
    h = F.col(column)
    slices = [F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in edges]
    keys = [F.struct(F.lit(n).alias("band"), F.xxhash64(*[slices[i] for i in keep]).alias("key")) for n, keep in enumerate(combinations(range(pieces), pieces - max_hamming))]
    entries = hashes.select(h.alias("h")).distinct().select("h", F.explode(F.array(*keys)).alias("e")).select("h", "e.band", "e.key")
    a, b = entries.withColumnRenamed("h", "x"), entries.withColumnRenamed("h", "y")
    near = a.join(b.hint("merge"), ["band", "key"]).where((F.col("x") < F.col("y")) & (hamming(F.col("x"), F.col("y")) <= max_hamming))
    return near.select("x", "y").distinct()


def post_hashes(posts: DataFrame, min_words: int = 12, algorithm: str = "blake2b") -> DataFrame:
    """(post_id, h): the SimHash of every text of ``min_words`` words or more, each post's text hashed once; materialised."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    one = posts.select("post_id", text.alias("t")).groupBy("post_id").agg(F.min("t").alias("t")).where(F.size(simhash_words(F.col("t"))) >= min_words)
    return scratch.materialize(one.select("post_id", simhash(F.col("t"), algorithm=algorithm).alias("h")).where(F.col("h").isNotNull()), "hashes")


def near_copies(posts: DataFrame, hashes: DataFrame, max_hamming: int = 3, by: list[str] = []) -> DataFrame:
    """post_ids (with ``by``) that are near copies of an earlier kept post, by the distance of their ``hashes`` (post_id, h).

    A post is dropped if a *kept* earlier one (by created_at, then post_id) is near; near posts that were dropped
    themselves don't count. All later posts of one hash are dropped at once; of the rest, those without undecided
    earlier neighbours are kept, their neighbours dropped, and so on until none is undecided: as many rounds as the
    longest chain of near posts has, each over what is still undecided. Posts without hash take no part; repeated rows of a post
    count once. Within each value of ``by`` for itself; hashes are compared once all the same.
    """
    # Only hashes that several posts share or that have a near one can drop or be dropped.
    near = scratch.materialize(similar_hash_pairs(hashes, "h", max_hamming), "near")
    shared = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h")
    involved = shared.unionByName(near.select(F.explode(F.array("x", "y")).alias("h"))).distinct()
    some = scratch.materialize(hashes.join(involved, "h", "left_semi").select("post_id", "h"), "involved")
    hashed = scratch.materialize(scratch.join_checked(posts.select(*by, "post_id", "created_at"), some, ["post_id"], "inner", "created_at", FEW).distinct(), "hashed")
    firsts = scratch.materialize(hashed.groupBy(*by, "h").agg(F.min(F.struct("created_at", "post_id")).alias("at")), "firsts")
    later = hashed.join(firsts, [*by, "h"]).where(F.col("post_id") != F.col("at.post_id")).select(*by, "post_id")
    ordered = near.join(firsts.select(*by, F.col("h").alias("x"), F.col("at").alias("p")), "x").join(firsts.select(*by, F.col("h").alias("y"), F.col("at").alias("q")), [*by, "y"])
    edges = scratch.materialize(ordered.select(*by, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")), "edges")
    dropped, steps = later, [near, some, hashed, firsts]
    while not edges.isEmpty():
        kept = edges.select(*by, "a").distinct().join(edges.select(*by, F.col("b").alias("a")).distinct(), [*by, "a"], "left_anti")
        gone = scratch.materialize(edges.join(kept, [*by, "a"], "left_semi").select(*by, "b").distinct(), "gone")
        dropped, steps = dropped.unionByName(gone.select(*by, F.col("b.post_id").alias("post_id"))), [*steps, gone]
        rest = edges.join(gone, [*by, "b"], "left_anti").join(gone.select(*by, F.col("b").alias("a")), [*by, "a"], "left_anti")
        before, edges = edges, scratch.materialize(rest.select(*by, "a", "b"), "edges")
        scratch.release(before)
    out = scratch.materialize(dropped.distinct(), "copies")
    scratch.release(edges, *steps)
    return out


def near_duplicate_posts(posts: DataFrame, max_hamming: int = 3, min_words: int = 12, algorithm: str = "blake2b") -> DataFrame:
    """:func:`near_copies` of posts with title and body; posts of fewer than ``min_words`` words take no part."""
    hashes = post_hashes(posts, min_words, algorithm)
    out = near_copies(posts, hashes, max_hamming)
    scratch.release(hashes)
    return out


def drop_near_duplicates(df: DataFrame, max_hamming: int = 3, min_words: int = 12, algorithm: str = "blake2b") -> DataFrame:
    return df.join(near_duplicate_posts(df, max_hamming, min_words, algorithm), "post_id", "left_anti").select(df.columns)


def lookup(key: Column, values: dict, default: float) -> Column:
    """A literal dictionary as an expression."""
    if not values:
        return F.lit(float(default))
    table = F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default)))


def author_weights(df: DataFrame, rules: dict[str, dict], bots: dict | None = None, by: list[str] = []) -> DataFrame:
    """Add ``author_weight``: lower for new or little followed accounts of a source, and for authors of very many posts in a
    period (``block``, within ``by``). Missing age or karma lowers nothing.

    ``rules[source]``: min_age_days, new_account_weight, min_karma, low_karma_weight. ``bots``: sources, max_posts, weight.
    """
    weight = F.lit(1.0)
    for source, r in rules.items():
        mine = F.col("source") == source
        weight = weight * F.when(mine & (F.col("author_age_days") < r["min_age_days"]), r["new_account_weight"]).otherwise(1.0)
        weight = weight * F.when(mine & (F.col("author_karma") < r["min_karma"]), r["low_karma_weight"]).otherwise(1.0)
    if bots:
        watched = F.col("source").isin(bots["sources"]) & F.col("author_id").isNotNull()
        # Distinct posts first: two partial aggregations instead of one set per author.
        busy = df.where(watched).select(*by, "block", "author_id", "post_id").distinct().groupBy(*by, "block", "author_id").agg(F.count(F.lit(1)).alias("_tm_n")).where(F.col("_tm_n") > bots["max_posts"])
        df = df.join(busy, [*by, "block", "author_id"], "left")
        weight = weight * F.when(watched & F.col("_tm_n").isNotNull(), bots["weight"]).otherwise(1.0)
    return df.withColumn("author_weight", weight).drop("_tm_n")


def post_weight(engagement: Column, source: Column, author_weight: Column, quality: Column, floors: dict[str, float], source_weights: dict[str, float]) -> Column:
    """log(1 + engagement) times the weights; engagement is at least 0 and at least the source's floor."""
    amount = F.greatest(F.greatest(F.coalesce(engagement.cast("double"), F.lit(0.0)), F.lit(0.0)), lookup(source, floors, 0.0))
    return F.log1p(amount) * author_weight * quality * lookup(source, source_weights, 1.0)


def news_quality(df: DataFrame, sources: list[str], kind_weights: dict[str, float], off_topic_weight: float, named: Column) -> DataFrame:
    """Add ``news_kind`` (NULL outside ``sources``) and ``quality``: the kind's weight, lower where ``named`` is false."""
    news = F.coalesce(F.col("source").isin(sources), F.lit(False))
    df = df.withColumn("news_kind", F.when(news, headline_kind(F.col("title"), F.col("community"))))
    return df.withColumn("quality", F.when(news, lookup(F.col("news_kind"), kind_weights, 1.0) * F.when(named, 1.0).otherwise(off_topic_weight)).otherwise(1.0))


def cap_per_author(df: DataFrame, k: int, period: str, sources: list[str] | None = None, salts: int = 16, by: list[str] = []) -> DataFrame:
    """At most ``k`` rows per (``by``, period, ticker, author), greatest weight first, ties by post_id.

    Rows of other sources and without author stay. Ranked in two stages, so that a hot author is spread over tasks.
    """
    capped = F.col("author_id").isNotNull()
    if sources is not None:
        capped = capped & F.col("source").isin(sources)
    capped = F.coalesce(capped, F.lit(False))
    keys, order = [*by, period, "ticker", "author_id"], [F.col("weight").desc_nulls_last(), F.col("post_id")]
    salted = df.where(capped).withColumn("_tm_s", F.pmod(F.xxhash64("post_id"), F.lit(salts)))
    first = salted.withColumn("_tm_r", F.row_number().over(W.partitionBy(*keys, "_tm_s").orderBy(*order))).where(F.col("_tm_r") <= k)
    top = first.withColumn("_tm_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_tm_r") <= k)
    return top.select(df.columns).unionByName(df.where(~capped))


def filtered_mentions(
    df: DataFrame, keys: DataFrame, author_rules: dict[str, dict], bots: dict | None, news: dict, floors: dict[str, float], source_weights: dict[str, float], cap: int, capped_sources: list[str] | None,
    spam: list[str] = SPAM, max_hamming: int = 3, min_words: int = 12, algorithm: str = "blake2b", spread: Callable[[DataFrame], DataFrame] | None = None, by: list[str] = [], consume: bool = False,
) -> DataFrame:
    """All filters over mention rows with ``block``, in their fixed order: reposts, near copies, spam, syndicated headlines, news
    quality, post weight, rows of weight factor 0, author cap per ticker and block. Adds ``weight`` and what it is made of.

    ``keys`` has one row per ticker with ``keys``, the forms of its name; ``news``: sources, kind_weights, off_topic_weight.
    ``spread`` may put a row into several groups ``by`` (each week whose window it lies in, which gives it its block), kept apart in
    every step. Whatever is judged by a text is judged before that, once, and the texts stay behind, and then the content hashes
    as well. ``consume`` deletes ``df``, a scratch table, as soon as its texts are judged.
    """
    about_news = F.coalesce(F.col("source").isin(news["sources"]), F.lit(False))
    hashes = post_hashes(df, min_words, algorithm)
    names = scratch.materialize(keys.select("ticker", F.col("keys").alias("_tm_keys")), "names")
    marked = scratch.join_checked(df, names, ["ticker"], "left", "post_id").withColumns({
        "_tm_spam": matches_any(spam, F.col("title"), F.col("body")),
        "_tm_head": F.when(about_news, headline_key(F.col("title"), unicode=False)),
        "news_kind": F.when(about_news, headline_kind(F.col("title"), F.col("community"))),
        "_tm_named": F.when(about_news, mentions_name(F.col("ticker"), F.col("title"), F.col("body"), F.col("_tm_keys"))),
    })
    judged = scratch.materialize(marked.withColumn("_tm_same", F.col("content_hash")).drop("title", "body", "_tm_keys", *["content_hash"] * bool(spread)), "judged")
    scratch.release(names, *[df] * consume)
    same = _shared_only(judged, "_tm_same")
    scratch.release(judged)
    marked = _shared_only(same, "_tm_head")
    scratch.release(same)
    rows = spread(marked) if spread else marked
    first = scratch.materialize(_first_per_key(rows, F.col("_tm_same"), by).drop("_tm_same"), "firsts")
    scratch.release(marked)
    copies = near_copies(first, hashes, max_hamming, by)
    clean = scratch.join_checked(first, copies, [*by, "post_id"], "left_anti", "ticker", FEW).where(~F.col("_tm_spam")).select(first.columns)
    clean = scratch.materialize(clean, "clean")
    scratch.release(first, copies, hashes)
    df = _first_per_key(clean, F.col("_tm_head"), by)
    quality = lookup(F.col("news_kind"), news["kind_weights"], 1.0) * F.when(F.col("_tm_named"), 1.0).otherwise(news["off_topic_weight"])
    df = df.withColumn("quality", F.when(about_news, quality).otherwise(1.0)).drop("_tm_spam", "_tm_head", "_tm_named")
    judged = scratch.materialize(df, "judged")
    scratch.release(clean)
    df = author_weights(judged, author_rules, bots, by)
    df = df.withColumn("weight", post_weight(F.col("engagement"), F.col("source"), F.col("author_weight"), F.col("quality"), floors, source_weights))
    df = scratch.materialize(df.where(F.col("author_weight") * F.col("quality") > 0), "weighted")
    scratch.release(judged)
    return cap_per_author(df, cap, "block", capped_sources, by=by)

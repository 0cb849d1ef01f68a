"""Entities named in free text, as relations: candidate symbols and word groups are taken out of the texts by expressions
and joined to the tables of known entities and of their names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scratch

# How sure each kind of mention is, and words that tell that a text is about markets.
CONFIDENCE = {"cashtag": 0.95, "alias": 0.75, "bare": 0.5}
CONTEXT_WORDS = [
    "stock", "stocks", "share", "shares", "calls", "puts", "call", "put", "options", "option", "strike", "expiry", "earnings", "revenue", "guidance", "eps", "dividend", "buy", "bought",
    "sell", "sold", "selling", "buying", "short", "shorts", "long", "position", "portfolio", "bull", "bullish", "bear", "bearish", "price", "target", "valuation", "ticker", "market",
    "rally", "dip", "squeeze", "ipo", "analyst", "upgrade", "downgrade", "chart", "support", "resistance", "hold", "holding", "invest", "investing", "trade", "trading", "yolo", "dd",
]

#: Characters of a word, and of a name (which may be joined by & and -).
WORD = r"\p{L}\p{M}\p{N}_"
NAME = rf"{WORD}&-"


@dataclass(frozen=True)
class Rules:
    """Confidence by kind; words and sums that open the gate for bare symbols; the least letters of a bare symbol without dot;
    the number of other words in capitals that makes a line one of shouting."""

    confidence: dict[str, float] = field(default_factory=lambda: dict(CONFIDENCE))
    context_words: tuple[str, ...] = tuple(CONTEXT_WORDS)
    bare_min_length: int = 2
    shouting_words: int = 3


def plain_text(title: Column, body: Column) -> Column:
    """Title and body on lines of their own, web addresses and references to boards and users blanked; NULL as empty."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))
    return F.regexp_replace(F.regexp_replace(text, r"https?://\S+|www\.\S+", " "), rf"(?<![{WORD}/])/?[ru]/[{WORD}]+", " ")


def _dollar_symbols(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(rf"(?<![{WORD}$])\$([A-Za-z]{{1,5}}(?:\.[A-Za-z])?)(?![{WORD}])"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda s: F.upper(s)))


def cashtags(title: Column, body: Column) -> Column:
    """Distinct upper-case symbols written with $."""
    return _dollar_symbols(plain_text(title, body))


def about_markets(text: Column, rules: Rules = Rules()) -> Column:
    """Does the text hold a sum of money, a percentage or one of the context words?"""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return text.rlike(r"\$\s?[0-9]|[0-9]\s?%") | F.arrays_overlap(words, F.array(*[F.lit(w) for w in rules.context_words]))


def _pieces(text: Column) -> Column:
    """A text as names and single other characters."""
    return F.regexp_extract_all(text, F.lit(rf"[{NAME}]+|[^{NAME}]"), F.lit(0))


def alias_mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(post_id, ticker) of the aliases that stand in ``text``, not as part of a longer name (``texts``: post_id, text).

    ``aliases``: alias, ticker, exact (is case kept?). Every place where the first piece of an alias stands is joined to the
    aliases that begin so. Of matches that overlap the one that begins first counts, then the longest; exact aliases and others
    don't stand in each other's way. An alias of several tickers stands for the least.
    """
    own = aliases.where(F.col("alias").isNotNull() & (F.trim("alias") != "")).select(F.trim("alias").alias("alias"), "ticker", F.coalesce("exact", F.lit(False)).alias("exact"))
    own = own.withColumn("alias", F.when(F.col("exact"), F.col("alias")).otherwise(F.lower("alias"))).groupBy("alias", "exact").agg(F.min("ticker").alias("ticker"))
    own = own.withColumn("p", _pieces(F.col("alias"))).withColumn("n", F.size("p")).withColumn("head", F.lower(F.get("p", F.lit(0))))
    heads = scratch.materialize(own.groupBy("head").agg(F.collect_list(F.struct("alias", "n", "ticker", "exact")).alias("known"), F.max("n").alias("n")), "aliases")
    longest = heads.agg(F.max("n")).first()[0]
    if longest is None:
        return texts.select("post_id", F.lit(None).cast("string").alias("ticker")).limit(0)
    cut = texts.select("post_id", _pieces(F.col("text")).alias("p"))
    names = F.filter(F.transform("p", lambda x, i: F.struct(i.alias("at"), F.lower(x).alias("head"))), lambda s: F.trim(s["head"]) != "")
    place = lambda s: F.struct(s["at"].alias("at"), s["head"].alias("head"), F.array_join(F.slice("p", s["at"] + 1, longest + 1), "").alias("here"), F.get("p", s["at"] - 1).alias("before"))
    places = cut.select("post_id", F.explode(F.transform(names, place)).alias("s")).select("post_id", "s.*")
    near = scratch.join_checked(places, heads.drop("n"), ["head"], "inner", "post_id").select("post_id", "at", "here", "before", F.explode("known").alias("k")).select("post_id", "at", "here", "before", "k.*")
    here = F.when(F.col("exact"), F.col("here")).otherwise(F.lower("here"))
    inside = lambda c: F.coalesce(c.rlike(f"[{NAME}]$"), F.lit(False))
    alone = ~inside(F.substring(here, F.length("alias") + 1, F.lit(1))) & ~(inside(F.col("before")) & ~F.col("alias").rlike(f"^[{NAME}]"))
    hits = near.where(here.startswith(F.col("alias")) & alone).groupBy("post_id", "exact").agg(F.sort_array(F.collect_set(F.struct("at", (-F.col("n")).alias("less"), "ticker"))).alias("hits"))
    begin = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("tickers"))
    step = lambda acc, h: F.when(h["at"] >= acc["upto"], F.struct((h["at"] - h["less"]).alias("upto"), F.array_append(acc["tickers"], h["ticker"]).alias("tickers"))).otherwise(acc)
    return hits.select("post_id", F.explode(F.aggregate("hits", begin, step, lambda acc: acc["tickers"])).alias("ticker")).distinct()


def bare_mentions(texts: DataFrame, known: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(post_id, ticker, gate) of known symbols that stand alone in capitals on a line that isn't shouting.

    ``texts``: post_id, text, gate (carried along); ``known``: ticker, materialised. A line is shouting when it has ``shouting_words`` words of two capitals or
    more that aren't known. Words are joined to the known symbols, never the other way round, and counted by line.
    """
    capitals, symbol = rf"(?<![{WORD}$])[A-Z]{{2,}}(?![{WORD}])", rf"(?<![{WORD}$.])[A-Z]{{1,5}}(?:\.[A-Z])?(?![{WORD}])"
    as_kind = lambda pattern, bare: F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(0)), lambda w: F.struct(w.alias("ticker"), F.lit(bare).alias("bare")))
    lines = texts.select("post_id", "gate", F.posexplode(F.split("text", r"\R")).alias("row", "line")).where(F.col("line").rlike("[A-Z]"))
    words = lines.select("post_id", "gate", "row", F.explode(F.concat(as_kind(capitals, False), as_kind(symbol, True))).alias("w")).select("post_id", "gate", "row", "w.*")
    judged = scratch.join_checked(words, known.withColumn("real", F.lit(True)), ["ticker"], "left", "post_id")
    long_enough = F.length(F.translate("ticker", ".", "")) >= rules.bare_min_length
    found = F.collect_set(F.when(F.col("bare") & F.col("real") & long_enough, F.col("ticker")))
    per_line = judged.groupBy("post_id", "row").agg(F.count_if(~F.col("bare") & F.col("real").isNull()).alias("loud"), found.alias("tickers"), F.bool_or("gate").alias("gate"))
    return per_line.where(F.col("loud") < rules.shouting_words).select("post_id", F.explode("tickers").alias("ticker"), "gate").distinct()


def extract_tickers(posts: DataFrame, universe: DataFrame, aliases: DataFrame | None = None, blocklist: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(post_id, ticker, match_type, confidence) of every entity of ``universe`` (ticker) named in title or body of ``posts`` (id).

    Cashtags and aliases (alias, ticker, exact) always count. Bare symbols count if they aren't in ``blocklist`` (word) and
    the text is about markets or has a cashtag or alias. One row per post and entity, of the surest kind (of equally sure ones the
    first of cashtag, alias, bare). NULL texts are empty, posts without id are dropped, repeated posts count once. No table is
    collected, and one is broadcast only below the bound of :func:`scratch.join_checked`.
    """
    known = scratch.materialize(universe.where(F.col("ticker").isNotNull()).select("ticker").distinct(), "known")
    texts = posts.where(F.col("id").isNotNull()).select(F.col("id").alias("post_id"), plain_text(F.col("title"), F.col("body")).alias("text"))
    dollar = texts.select("post_id", F.explode(_dollar_symbols(F.col("text"))).alias("ticker"))
    parts = [("cashtag", scratch.join_checked(dollar, known, ["ticker"], "left_semi", "post_id"))]
    if aliases is not None:
        parts.append(("alias", alias_mentions(texts, aliases.join(known, "ticker", "left_semi"))))
    plausible = known if blocklist is None else scratch.materialize(known.join(blocklist.select(F.col("word").alias("ticker")), "ticker", "left_anti"), "plausible")
    parts.append(("bare", bare_mentions(texts.withColumn("gate", about_markets(F.col("text"), rules)), plausible, rules)))
    rows = None
    for order, (kind, part) in enumerate(parts):
        gate = F.col("gate") if kind == "bare" else F.lit(True)
        part = part.select("post_id", F.struct((-F.lit(rules.confidence[kind])).alias("doubt"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), "ticker", gate.alias("gate")).alias("m"))
        rows = part if rows is None else rows.unionByName(part)
    gathered = rows.groupBy("post_id").agg(F.bool_or(F.col("m.kind") != "bare").alias("named"), F.collect_set("m").alias("all"))
    sure = gathered.select("post_id", "named", F.explode("all").alias("m")).where((F.col("m.kind") != "bare") | F.col("m.gate") | F.col("named"))
    best = sure.groupBy("post_id", F.col("m.ticker").alias("ticker")).agg(F.min("m").alias("m"))
    return best.select("post_id", "ticker", F.col("m.kind").alias("match_type"), (-F.col("m.doubt")).alias("confidence"))

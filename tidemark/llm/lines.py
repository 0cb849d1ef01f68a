"""Lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import scratch


def line_form(line: Column) -> Column:
    """The form two lines must share to be the same: lower case, digit runs as ``0``, white-space runs as one blank,
    everything but letters and digits removed from both ends."""
    line = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    line = F.regexp_replace(line, r"(?U) \s+|[\s&&[^ ]]\s*", " ")  # single blanks stay as they are
    return F.regexp_extract(line, r"(?s)^[^\p{L}\p{N}]*+(.*[\p{L}\p{N}])?", 1)


def _lines(df: DataFrame, ident: str, source: Column, text: str) -> DataFrame:
    """Every countable line: ident, line_no and two hashes (96 bits) of source and form.

    Forms are made inside the array, before it is exploded, so that each is computed once.
    """
    forms = F.transform(F.split(F.col(text), "\r?\n"), line_form)
    cut = df.where(source.isNotNull() & F.col(text).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("_tm_id"), source.alias("_tm_s"), F.posexplode(forms).alias("line_no", "_tm_f"))
    return cut.where(F.col("_tm_f") != "").select("_tm_id", "line_no", "_tm_s", F.xxhash64("_tm_s", "_tm_f").alias("_tm_k"), F.hash("_tm_f", "_tm_s").alias("_tm_k2"))


def frequent_lines(df: DataFrame, ident: str, source: Column, text: str, min_docs: int | None = 10, min_share: float | None = None) -> DataFrame:
    """(ident, line_no) of every line whose form occurs in many different documents of its source.

    A form is frequent in a source when it occurs in at least ``min_docs`` documents, or in at least ``min_share`` of the
    source's documents, or both when both are given. Lines are separated by LF or CR LF and numbered from 0, empty
    ones included; lines whose form is empty don't count. NULL source, ident or text: no part. Repeated rows of one
    ident count once. An empty table gives none.

    Distinct (form, document) pairs are made first, so one line held by a third of all documents spreads over all
    tasks; its count is then pre-aggregated; the frequent forms are joined back by broadcast only when counted small.
    """
    if min_docs is None and min_share is None:
        raise ValueError("give min_docs or min_share")
    lines = _lines(df, ident, source, text)
    lines = scratch.materialize(lines if min_share is not None else lines.drop("_tm_s"), "lines")
    per_form = lines.select("_tm_k", "_tm_k2", "_tm_id").distinct().groupBy("_tm_k", "_tm_k2").agg(F.count(F.lit(1)).alias("_tm_docs"))
    if min_docs is not None:
        per_form = per_form.where(F.col("_tm_docs") >= min_docs)
    if min_share is not None:
        sources = df.where(source.isNotNull() & F.col(ident).isNotNull()).select(source.alias("_tm_s"), F.col(ident).alias("_tm_id")).distinct().groupBy("_tm_s").agg(F.count(F.lit(1)).alias("_tm_all"))
        owner = lines.select("_tm_k", "_tm_k2", "_tm_s").distinct()
        per_form = per_form.join(owner, ["_tm_k", "_tm_k2"]).join(sources, "_tm_s").where(F.col("_tm_docs") >= F.col("_tm_all") * F.lit(min_share))
    frequent = scratch.materialize(per_form.select("_tm_k", "_tm_k2"), "frequent")
    hits = scratch.join_checked(lines.select("_tm_id", "line_no", "_tm_k", "_tm_k2"), frequent, ["_tm_k", "_tm_k2"], "inner", "_tm_id")
    return hits.select(F.col("_tm_id").alias(ident), "line_no").distinct()


def remove_lines(df: DataFrame, hits: DataFrame, ident: str, text: str) -> DataFrame:
    """``df`` with the lines named in ``hits`` (ident, line_no) cut out of ``text``; other separators stay as they are.

    Every row of an ident is cleaned, also repeated ones; texts without hits are unchanged; a text of which every
    line goes is ''; NULL stays NULL.
    """
    drop = hits.groupBy(F.col(ident).alias("_tm_id")).agg(F.collect_set("line_no").alias("_tm_drop"))
    joined = df.join(drop, F.col(ident) == F.col("_tm_id"), "left")
    pieces = F.split(F.col(text), "(?<=\n)")  # each piece keeps its own line break
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col("_tm_drop"), i)), "")
    return joined.withColumn(text, F.when(F.col("_tm_drop").isNull(), F.col(text)).otherwise(kept)).drop("_tm_id", "_tm_drop")

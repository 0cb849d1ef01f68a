"""Regulatory filings: symbol map, columnar submission lists, XML transaction reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import scratch
from tidemark.functions.calendar import from_iso
from tidemark.functions.text import dotted_symbol
from tidemark.operators.sinks import Store

SYMBOLS = "map<string, struct<cik_str: int, ticker: string, title: string>>"
RECENT = "struct<filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, items: array<string>, primaryDocument: array<string>>>>"
TRANSACTION = "transactionCoding struct<transactionCode: string>, transactionAmounts struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>, transactionAcquiredDisposedCode: struct<value: string>>"
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, company_name)."""
    doc = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", SYMBOLS)).alias("k", "v"))
    return doc.select(dotted_symbol(F.col("v.ticker")).alias("ticker"), F.col("v.cik_str").alias("cik"), F.col("v.title").alias("company_name"))


def read_submissions(spark: SparkSession, path: str, cik: int, ticker: str, forms: list[str], since: date, until: date) -> DataFrame:
    """Filings of one company's columnar list with a form of ``forms`` and a date in [since, until].

    Columns are zipped to rows up to the shortest of those present; missing ones (acceptance time, items, document) are NULL.
    """
    doc = spark.read.option("wholetext", True).text(path).select(F.lit(cik).alias("cik"), F.lit(ticker).alias("ticker"), F.from_json("value", RECENT)["filings"]["recent"].alias("r"))
    return _filings(doc, forms, since, until)


def _filings(doc: DataFrame, forms: list[str], since: date, until: date) -> DataFrame:
    """Rows of columnar lists ``r`` of companies (cik, ticker)."""
    n = F.least(F.size("r.form"), F.size("r.accessionNumber"), F.size("r.filingDate"))
    at = lambda c: F.nullif(F.get(F.col(f"r.{c}"), F.col("i")), F.lit(""))
    rows = doc.where(n > 0).select("cik", "ticker", "r", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    rows = rows.select(at("accessionNumber").alias("accession"), "ticker", at("form").alias("form"), "cik", F.try_to_date(at("filingDate")).alias("filing_date"), from_iso(at("acceptanceDateTime")).alias("accepted_at"), at("items").alias("items"), at("primaryDocument").alias("document"))
    folder = F.concat(F.lit(f"{ARCHIVE}/"), F.col("cik").cast("string"), F.lit("/"), F.translate("accession", "-", ""), F.lit("/"))
    index = F.concat(folder, F.col("accession"), F.lit("-index.htm"))
    document = F.concat(folder, F.regexp_replace("document", r"^xslF345X\d+/", ""))
    return rows.where(F.col("form").isin(forms) & F.col("filing_date").between(F.lit(since), F.lit(until))).withColumn("url", index).withColumn("document_url", document).drop("document")


def read_submissions_folder(spark: SparkSession, path: str, companies: DataFrame, forms: list[str], since: date, until: date, number: str = r"(\d+)\D*$") -> DataFrame:
    """:func:`read_submissions` for a folder of lists in one read: the company's number is what ``number`` finds in the
    file's path (by default its last digits), its ticker comes from ``companies`` (cik, ticker; one ticker a number, else the least)."""
    files = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), number, 1).try_cast("int").alias("cik"), F.from_json("value", RECENT)["filings"]["recent"].alias("r"))
    one = scratch.materialize(companies.groupBy("cik").agg(F.min("ticker").alias("ticker")), "companies")
    return _filings(scratch.join_checked(files, one, ["cik"], "inner", "cik"), forms, since, until)


def read_purchases(spark: SparkSession, path: str) -> DataFrame:
    """(path, purchase_count, purchase_value) of XML reports: open-market purchases (code P, acquired) that aren't derivatives.

    A transaction with an unreadable or empty number counts, with value 0. A report without such transactions has 0 of both.
    """
    rows = spark.read.format("xml").option("rowTag", "nonDerivativeTransaction").schema(TRANSACTION).load(path).withColumn("path", F.input_file_name())
    bought = (F.col("transactionCoding.transactionCode") == "P") & (F.col("transactionAmounts.transactionAcquiredDisposedCode.value") == "A")
    number = lambda c: F.coalesce(F.expr(f"try_cast(transactionAmounts.{c}.value AS double)"), F.lit(0.0))
    value = number("transactionShares") * number("transactionPricePerShare")
    found = rows.groupBy("path").agg(F.count_if(F.coalesce(bought, F.lit(False))).cast("int").alias("n"), F.coalesce(F.sum(F.when(bought, value)), F.lit(0.0)).alias("v"))
    files = spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("path"))
    return files.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("purchase_count"), F.coalesce("v", F.lit(0.0)).alias("purchase_value"))


def update_insider_cache(store: Store, reports: DataFrame, read: Callable[[DataFrame], DataFrame], now: datetime) -> int:
    """Read the reports (accession, ticker, filing_date, path) that aren't stored yet and store them; returns how many.

    ``read`` makes (path, purchase_count, purchase_value) of the paths asked for, such as :func:`read_purchases` of those
    files; what is stored isn't read again.
    """
    known = store.read("insider_filings").select("accession")
    todo = scratch.materialize(reports.where(F.col("accession").isNotNull()).join(known, "accession", "left_anti"), "reports")
    if todo.isEmpty():
        return 0
    rows = todo.join(read(todo.select("path").distinct()), "path").withColumn("fetched_at", F.lit(now).cast("timestamp_ntz"))
    return store.insert_absent("insider_filings", rows)

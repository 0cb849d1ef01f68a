from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.llm.lines import frequent_lines, remove_lines


def test_found_and_removed(spark):
    data = [(f"d{n}", "s", f"Own line {chr(97 + n)}\r\n-- Rule {n * 37}  APPLIES! --\n\nEnd {n}x{chr(97 + n)}") for n in range(3)]
    data += [("d9", "other", "rule 5 applies"), ("d8", None, "rule 5 applies"), ("d7", "s", None), ("d6", "s", ""), ("d5", "s", "--\n..."), ("d0", "s", data[0][2])]
    df = spark.createDataFrame(data, "id string, source string, body string")
    hits = frequent_lines(df, "id", F.col("source"), "body", min_docs=3)
    assert rows(hits) == [("d0", 1), ("d1", 1), ("d2", 1)]
    assert rows(frequent_lines(df, "id", F.col("source"), "body", min_docs=4)) == []
    clean = {r.id: r.body for r in remove_lines(df, hits, "id", "body").collect()}
    assert clean["d1"] == "Own line b\r\n\nEnd 1xb"
    assert clean["d6"] == "" and clean["d7"] is None and clean["d9"] == "rule 5 applies"
    assert remove_lines(df, hits, "id", "body").count() == len(data)


def test_share_and_empty(spark):
    df = spark.createDataFrame([("1", "s", "a\nx"), ("2", "s", "b\nx"), ("3", "s", "c"), ("4", "t", "x")], "id string, source string, body string")
    assert rows(frequent_lines(df, "id", F.col("source"), "body", None, 0.6)) == [("1", 1), ("2", 1), ("4", 0)]
    assert rows(frequent_lines(df.limit(0), "id", F.col("source"), "body", 1)) == []


def test_repeated_row_counts_once_and_long_text(spark):
    df = spark.createDataFrame([("1", "s", "x")] * 5 + [("2", "s", "y\n" * 20000 + "z")], "id string, source string, body string")
    hits = frequent_lines(df, "id", F.col("source"), "body", 2)
    assert rows(hits) == []

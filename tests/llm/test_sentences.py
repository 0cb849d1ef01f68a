import pytest

from tidemark.llm.sentences import sentences

# Sentences as a reader cuts them; joined by the separator to make the text.
CASES = [
    (" ", ["Dr. Arno met Mrs. Bell at 9:30 a.m. on Friday.", "They sat!", "Did it rain?!", "the rest was quiet."]),
    (" ", ["It fell 3.5% to $4.20.", "See https://a.example/q.html?v=1.2 for more.", "Version 2.0.1 came out."]),
    (" ", ["J. R. Smith of Acme Inc. and its peers left the U.S. market.", "Sales rose by 5 p.m.", "The end."]),
    (" ", ['"That was never the plan!" said one holder.', 'The chair said, "Nobody buys this."', "Nothing moved.", "He waited... and left."]),
    ("", ["Costs fell.", "Rents rose.", "Done"]),
    (" ", ["Das sank z. B. am 3. Mai um ca. 2,5 Mio. Euro.", "„Bleibt alles beim Alten?“, fragte der Vorstand.", "Ende usw.", "Gut."]),
    (" ", ["Las ventas en EE. UU. y fuera bajan p. ej. aquí.", "«¿Quién compra?», preguntó el Sr. Ruiz.", "Nada."]),
    (" ", ["M. Duval arrive, cf. p. 4 du texte.", "« Rien ne change ! », lance un courtier.", "Fin."]),
    (" ", ["Рост в 2024 г. по плану и т. д.", "По словам г. Иванова, всё верно.", "«Кто купит?», спросил банк."]),
    ("", ["“没有变化。”董事会说。", "收盘前，股价涨了28.6%。", "为什么……而且还会继续？"]),
    ("", ["「誰が買うのか！」と声が上がった。", "Acme Inc.と同様に上がった。"]),
    (" ", ["बैंक ने रु. 38.2 दिए।", "“क्या यही सब है?” बैंक ने पूछा।", "हाँ!"]),
    (" ", ['"هل هذا كل شيء؟" سأل البنك.', "لا شيء."]),
    (" ", ["ราคาขึ้น 223 หุ้นวันนี้", "เงินปันผลลดลงตาม Acme Inc. ประกาศเมื่อวาน", "จบ"]),
    ("\n\n", ["A headline without stop", "Text wrapped\nover lines. 📈📈".replace(". 📈📈", ". 📈📈"), "End (see p. 4)."]),
    ("\r\n  \r\n", ["First", "Second."]),
]


@pytest.mark.parametrize("glue, want", CASES, ids=range(len(CASES)))
def test_cases(spark, glue, want):
    text = glue.join(want)
    got = sentences(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("sent_no").collect()
    assert [text[r.sent_start : r.sent_end] for r in got] == want
    assert [r.sentence for r in got] == want


def test_places_count_code_points(spark):
    text = "  😀 Up! \n\n 💎💎 Down. 🚀 \t"
    got = sentences(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()
    assert sorted(text[r.sent_start : r.sent_end] for r in got) == ["💎💎 Down. 🚀", "😀 Up!"]


def test_nulls_empty_repeated_and_long(spark):
    long = "Word after word goes on. " * 20_000
    data = [(1, None), (2, ""), (3, " \n\t \n"), (None, "A b."), (4, "Same. Same."), (4, "Same. Same."), (5, long), (6, "." * 5000), (7, '"' * 3001), (8, "no stop " * 20_000)]
    df = spark.createDataFrame(data, "id long, text string").withColumn
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "id long, text string, sent_no int")
    n = {r.id: r["count"] for r in sentences(df, "id", "text").groupBy("id").count().collect()}
    assert n == {None: 1, 4: 4, 5: 20_000, 6: 1, 7: 1, 8: 1}
    assert sentences(df.limit(0), "id", "text").count() == 0

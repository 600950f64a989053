import json

from pyspark.sql import functions as F

from foliant.sources import sinks, texts


def test_text_pages(spark):
    files = spark.createDataFrame([("a", "{1}---\nfirst\n{2}---\nsecond\n"), ("b", "one\ftwo\fthree"), ("c", ("line of text\n" * 30 + "\n") * 20), ("d", None), ("e", "")], "book string, text string")
    got = texts.text_pages(files)
    assert [(r.label, r.text.strip()) for r in got.where("book = 'a' AND label IS NOT NULL").orderBy("page_index").collect()] == [("1", "first"), ("2", "second")]
    assert [r.text for r in got.where("book = 'b'").orderBy("page_index").collect()] == ["one", "two", "three"]
    sizes = [r.n for r in got.where("book = 'c'").select(F.char_length("text").alias("n"), "page_index").orderBy("page_index").collect()]
    assert len(sizes) > 1 and sum(sizes) > 7000


def test_results_and_pictures(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text("﻿" + json.dumps({"course": "c", "results": [{"id": "q1", "correct": True, "at": "2026-09-27T10:00:00"}]}), encoding="utf-8")
    row = texts.read_results(spark, str(tmp_path / "r")).first()
    assert (row.course, row.id, row.correct, row["at"].hour) == ("c", "q1", True, 10)
    (tmp_path / "p").mkdir()
    for name in ("page10.png", "page9.png", "notes.txt"):
        (tmp_path / "p" / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in texts.page_pictures(spark, str(tmp_path / "p")).orderBy("place").collect()] == ["page9.png", "page10.png"]
    new = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "c", "failed"), (3, "d", None)], "page_index int, text string, error string")
    assert {r.page_index for r in texts.salvaged(new, spark.createDataFrame([(3,)], "page_index int")).collect()} == {1}


def test_bold_ranges(spark):
    df = spark.createDataFrame([("heat and flow", [[9, 13], [0, 4], [2, 6]]), ("x", None), ("ab", [[1, 9]])], "t string, r array<array<int>>")
    assert [r.x for r in df.select(sinks.marked_bold(F.col("t"), F.col("r")).alias("x")).collect()] == ["**heat** and **flow**", "x", "ab"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a\tb", "c"), (None, "d")], "front string, back string")
    sinks.write_deck(df, str(tmp_path / "deck"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "deck")).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    events = spark.createDataFrame([("u1", "2026-10-01", "Learn; heat, " + "größe " * 20)], "uid string, date string, title string").withColumn("date", F.to_date("date"))
    text = sinks.calendar(events)
    assert "DTSTART;VALUE=DATE:20261001" in text and "Learn\\; heat\\," in text
    assert all(len(x.encode()) <= 75 for x in text.split("\r\n"))

from pyspark.sql import functions as F

from foliant.operators import lint

SCHEMA = "block_no long, course string, kind string, id string, fields array<struct<key: string, value: string, line: int, raw: string>>, key string, value int"


def blocks(spark, rows):
    return spark.createDataFrame([(n, course, kind, id_, None if fs is None else [(k, v, 1, "") for k, v in fs], "clash", 0) for n, course, kind, id_, fs in rows], SCHEMA)


def test_fields(spark):
    fields = [
        ("Type", "essay"), ("type", "MCQ"), ("bloom", "UNSURE: not stated anywhere"), ("why", "UNSURE: no"), ("why", "unsure: the book is silent here"), ("definition", "It lets ions pass."),
        ("definition", 'It lets ions pass. [p.3: "lets ions"]'), ("covers", "T-1, LO-2"), ("covers", "T-1, the second"), ("misconception", "It grows."), ("misconception", "Wrong: it grows | Right: it falls"), ("why", None), ("step", "  "), (None, None),
    ]
    got = {(r.field_no, r.code) for r in lint.field_issues(blocks(spark, [(1, "c", "concept", "T-1", fields), (2, None, None, None, None), (3, "c", "figure", "F-1", [])])).collect()}
    assert got == {(0, "bad-value"), (2, "unsure-not-allowed"), (3, "unsure-reason"), (5, "no-citation"), (8, "bad-id"), (9, "no-pair")}


def test_blocks(spark):
    same = 'Ions pass through the membrane [p.3: "ions pass through the membranes"]'
    rows = [
        (1, "c", "question", "Q-1", [("type", "mcq"), ("option a", "5 V"), ("option b", "6 V")]), (2, "c", "question", "Q-2", [("type", "mcq"), ("option a", "5 V"), ("option b", "6 V"), ("option c", "5  v")]),
        (3, "c", "question", "Q-3", [("type", "tf")]), (4, "c", "concept", "T-1", [("definition", same), ("plain", "Ions pass through the membrane.")]), (5, "c", "concept", "T-2", [("definition", same), ("plain", "It is a door for ions.")]),
        (6, "c", "concept", "T-3", [("definition", None), ("plain", "x")]), (7, None, None, None, None), (1, "c", "question", "Q-1", [("type", "mcq"), ("option a", "5 V"), ("option b", "6 V")]),
    ]
    got = sorted((r.block_no, r.code) for r in lint.block_issues(blocks(spark, rows)).collect())
    assert got == [(1, "few-choices"), (1, "few-choices"), (2, "same-choices"), (4, "plain-copies-definition")]
    assert lint.block_issues(blocks(spark, rows).where(F.lit(False))).count() == 0


def test_links(spark):
    rows = [(1, "c", "concept", "T-1", []), (2, "c", "question", "Q-1", [("covers", "T-1, T-2,x y")]), (3, "d", "question", "Q-2", [("Covers", "T-1")]), (4, None, "question", "Q-3", [("covers", "T-9")]), (5, "c", "question", "Q-4", [("covers", None)])]
    got = {(r.block_no, r.id) for r in lint.dead_links(blocks(spark, rows)).collect()}
    assert got == {(2, "T-2"), (3, "T-1")}

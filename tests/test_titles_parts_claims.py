import pytest
from pyspark.sql import functions as F

from foliant.functions import titles as ti
from foliant.operators import claims, parts


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize(
    ("title", "number", "bare"),
    [
        ("Chapter 12: Heat", 12, "Heat"), ("Kapitel IV · Wärme", 4, "Wärme"), ("第三章 热", 3, "热"), ("7 Flow", 7, "Flow"), ("Глава 2. Тепло", 2, "Тепло"), ("Heat and flow", None, "Heat and flow"), ("3.2 Flow", None, "Flow"), (None, None, None), ("", None, ""),
    ],
)
def test_chapter_titles(spark, title, number, bare):
    assert one(spark, ti.chapter_number, title) == number
    assert one(spark, ti.without_number, title) == bare


def test_sections_and_introductions(spark):
    assert one(spark, ti.cjk_section, "第十二节 水") == 12
    assert one(spark, ti.is_introduction, "Chapter 1: Introduction to heat")
    assert not one(spark, ti.is_introduction, "Introductory heat")
    assert one(spark, ti.bare_number, " p. 12 ") and one(spark, ti.bare_number, "xiv") and not one(spark, ti.bare_number, "Heat 3")


def test_words_of_claims(spark):
    assert set(one(spark, ti.content_units, "The heat is 4.18 水的密度")) == {"the", "heat", "4.18", "水的", "的密", "密度"}
    assert one(spark, ti.shares_words, "densities vary", "the density") and not one(spark, ti.shares_words, "heat", "flow")
    assert one(spark, ti.says_nothing, "This is very important.") and not one(spark, ti.says_nothing, "Heat moves water.")
    assert one(spark, ti.long_enough, "the membrane lets ions") and not one(spark, ti.long_enough, "a b c d") and one(spark, ti.long_enough, "水的密度不会变化")
    assert one(spark, ti.is_verbatim, "The membrane lets ions pass.", "the membrane lets ions pass") and not one(spark, ti.is_verbatim, "The membrane", "the membrane lets ions pass")


@pytest.mark.parametrize(
    ("kind", "mine", "key", "want"),
    [("mcq", "b) heat", "B", True), ("mcq", "c", "B", False), ("tf", "True", "true", True), ("numeric", "10.05", "10", True), ("numeric", "11", "10", False), ("numeric", "x", "10", None), ("cloze", "The Heat!", "heat", True), ("short", "a", "b", None)],
)
def test_answers(spark, kind, mine, key, want):
    assert one(spark, ti.same_answer, kind, mine, key) is want


def test_repairs_and_mutations(spark):
    for text in ("(p. 3: “it falls”)", '[page 3 "it falls"]', '[S. 3: "it falls"]', '[p.3: "it falls"]'):
        assert one(spark, ti.fixed_citations, text) == '[p.3: "it falls"]'
    assert one(spark, ti.wrong_formula, "a + b") == "a - b"
    assert one(spark, ti.wrong_formula, r"v = \frac{s}{t}") == r"v = \frac{t}{s}"
    assert one(spark, ti.wrong_formula, "E = m v^{2}") == "E = m v^{3}"
    assert one(spark, ti.wrong_formula, "p V = n R T") == "p V = 2 n R T"
    assert one(spark, ti.card_math, "so $x$ is") == r"so \(x\) is"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, book string, page_index int, label string, text string, flags array<string>")


def test_pages_by_label(spark):
    pages = pages_of(spark, [(1, "b", 0, "i", "x", None), (2, "b", 1, "I", "x", None), (3, "b", 2, "1", "x", None), (4, "b", 3, "A2", "x", None), (5, "b", 9, "3", "x", None), (6, "b", 4, "1", "x", None), (7, "b", None, "7", "x", None)])
    cites = spark.createDataFrame([(1, "b", "i"), (2, "b", "a2"), (3, "b", "1 – A2"), (4, "b", "1-3"), (5, "b", "99"), (6, "b", None), (7, "c", "1"), (8, "b", "7")], "k long, book string, page string")
    got = {r.k: (r.first_page, r.last_page) for r in parts.find_pages(cites, pages, "k").collect()}
    assert got == {1: (0, 0), 2: (3, 3), 3: (2, 3)}


def test_parts_by_size(spark):
    df = spark.createDataFrame([([500, 500, 500, 500],), ([10],), ([],), ([0, 0],)], "s array<long>")
    assert [r.x for r in df.select(parts.book_parts(F.col("s"), 1000).alias("x")).collect()] == [[0, 0, 1, 1], [0], [], [0, 0]]


def test_questions_ids_ranges_and_boxes(spark):
    texts = spark.createDataFrame([(1, "Head\n1. What?\nmore\n2) Why?\n9. no\n4. How?"), (2, None), (3, "12. x")], "k long, text string")
    assert [(r.number, r.question) for r in parts.split_questions(texts, "k").orderBy("number").collect()] == [(1, "1. What? more"), (2, "2) Why? 9. no"), (4, "4. How?")]
    ids = spark.createDataFrame([("c", "x", 1), ("c", "x", 2), ("d", "x", 3)], "g string, id string, n long")
    assert [r.unique_id for r in parts.unique_ids(ids, ["g"], "id", [F.col("n")]).orderBy("n").collect()] == ["x", "x-2", "x"]
    pages = pages_of(spark, [(i, "b", n, None, "t", ["ocr"]) for i, n in enumerate((0, 1, 2, 2, 7, 9, 10, 13))] + [(99, "b", None, None, None, None)])
    assert parts.range_texts(pages).first().ranges == "0-2, 7, 9-10, 13"
    assert [(r.part, r.first_page, r.last_page) for r in parts.fallback_sections(pages).orderBy("part").collect()] == [(1, 0, 5), (2, 6, 11), (3, 12, 13)]
    look = parts.probe(pages).first()
    assert (look.pages, look.without_text, look.scans) == (8, 8, 8)
    box = spark.createDataFrame([([[3.0, 1.0], [0.0, 5.0], [2.0, 2.0]],)], "p array<array<double>>").select(parts.boxes_of_polygons(F.col("p")).alias("b")).first().b
    assert tuple(box) == (0.0, 1.0, 3.0, 5.0)


def test_trust_of_blocks(spark):
    f = lambda *kv: [(k, v, 1, "") for k, v in kv]
    quote = "the membrane lets all the ions pass"
    rows = [(1, "concept", "a", f(("definition", f'{quote} [p.3: "{quote}"]'))), (2, "concept", "b", f(("definition", f'Ions cross it. [p.3: "{quote}"]'), ("why", "This is important."))), (3, "concept", "c", f(("definition", "UNSURE: no"), ("term", "x"))), (4, "concept", "d", None), (5, "concept", "e", f(("plain", f'Ions cross. [p.3: "{quote}"]')))]
    blocks = spark.createDataFrame(rows, "block_no long, kind string, id string, fields array<struct<key: string, value: string, line: int, raw: string>>")
    c = claims.claims(blocks)
    assert {(r.block_no, r.status, r.claims) for r in claims.block_trust(c, claims.claim_issues(c)).collect()} == {(1, "ok", 1), (2, "warn", 2), (5, "pending", 1)}
    assert {r.code for r in claims.claim_issues(c).collect()} == {"no-citation", "says-nothing"}
    assert c.select("claim_id").distinct().count() == c.count()

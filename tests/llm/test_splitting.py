import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm.splitting import all_items, cut_points, split_items


@settings(deadline=None, max_examples=150)
@given(st.text(alphabet="ab .\n。é‍", max_size=400), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover_the_text_within_the_limit(text, most, overlap):
    if overlap >= most:
        with pytest.raises(ValueError):
            cut_points(text, most, overlap)
        return
    cuts = cut_points(text, most, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= most for a, b in cuts)
    assert all(c == max(0, b - overlap) and d > b for (_, b), (c, d) in zip(cuts, cuts[1:]))


def test_cut_falls_where_the_topic_changes():
    one = "The membrane lets ions pass. Ions cross the membrane by channels. " * 9
    two = "Prices rise when demand grows. Demand for wheat moves prices. " * 9
    text = one + "\n" + two
    (_, cut), *_ = cut_points(text, len(one) + 200, 0)
    assert cut == len(one) + 1


def test_large_overlaps_are_kept():
    assert [(b - a) for a, b in cut_points("y" * 500, 100, 80)][:3] == [100, 100, 100]
    assert cut_points("y" * 130, 100, 80) == [(0, 100), (20, 120), (40, 130)]


def test_limits_with_too_large_an_overlap_are_refused(spark):
    items = spark.createDataFrame([("page", 1, 0, "any", "z" * 50)], "item_kind string, item_id long, read_no int, tier string, text string")
    limits = spark.createDataFrame([("page", "any", 10, 10)], "item_kind string, tier string, max_chars int, overlap_chars int")
    with pytest.raises(ValueError):
        split_items(items, limits)


def test_no_boundary_at_all():
    assert cut_points("x" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]


def test_table(spark):
    pages = spark.createDataFrame([(1, "w " * 60, 5), (2, None, 5), (3, "", 5), (4, "short", 5), (1, "w " * 60, 5), (5, "z" * 100_000, 5)], "page_id long, text string, max_chars int")
    tasks = spark.createDataFrame([(7, "Strict ", [("p", "w", "a b " * 30), ("p", "w", None)]), (8, None, [("p", "w", "a b " * 30)]), (9, "other", None)], "task_id long, tier string, read array<struct<path: string, why: string, text: string>>")
    limits = spark.createDataFrame([("page", "any", 50, 5), ("task", "strict", 40, None), ("task", "strict", 60, 0), ("task", None, 10, 0)], "item_kind string, tier string, max_chars int, overlap_chars int")
    got = split_items(all_items(pages, tasks), limits)
    assert got.select("item_kind", "item_id", "read_no").distinct().count() == 3
    assert got.where("item_id = 1 AND piece_no = 0").count() == 2
    assert got.where(F.char_length("piece") > F.when(F.col("item_kind") == "page", 50).otherwise(40)).count() == 0
    assert got.where("n_pieces < 2").count() == 0
    assert split_items(all_items(pages, tasks).where(F.lit(False)), limits).count() == 0
    assert split_items(all_items(pages, tasks), limits.where(F.lit(False))).count() == 0

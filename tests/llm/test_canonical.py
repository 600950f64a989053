import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm.canonical import MappingConflict, _rules, canonical, canonical_text, hidden_quotes, transducer

SAME = [
    ("ｔｈｅ　ｌａｙｏｕｔ", "the layout"), ("ﬁnd the ﬂow", "find the flow"), ("café", "café"), ("th‍e sam\xadple﻿", "the sample"), ("a\xa0b c d", "a b c d"), ("Ρrüfung vіѕ", "Prüfung vis"),
    ("виднo", "видно"), ("Ω K Å", "Ω K Å"), ("μm", "µm"), ("⼈⼤", "人大"), ("が", "が"), ("well‑known", "well-known"), ("e‌́", "é"),
]
DIFFERENT = [("Rate", "rate"), ("resume", "résumé"), ("m2", "m²"), ("4.9", "1.9"), ("−5", "5"), ("rn", "m"), ("a–b", "a-b")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look_same_form(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look_different_form(a, b):
    assert canonical(a) != canonical(b)


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=40))
def test_form_is_settled(text):
    once = canonical(text)
    assert canonical(once) == once


def test_table_is_free_of_conflicts():
    table = _rules()
    assert all(table.get(c, c) == c for target in table.values() for c in target)
    assert issubclass(MappingConflict, ValueError)


def test_quotes(spark):
    page = "First line here.\nThe ｆｉｎａｌ оffset of the sample falls.\nLast."
    pages = spark.createDataFrame([(1, "b", 0, page, 1), (2, "b", 0, page, 2), (3, "b", 1, None, 3), (4, None, 0, page, 4), (5, "b", 2, "word " * 90000 + "ﬁn", 5)], "page_id long, book string, page_index int, text string, quote int")
    rows = [(1, "b", 0, "final offset of"), (2, "b", 0, "First line"), (3, "b", 0, "here. The final"), (4, "b", 0, None), (5, "b", 0, "   "), (6, "b", 1, "x"), (7, None, 0, "final offset"), (8, "b", 0, "Final offset"), (9, "b", 2, "word fin"), (1, "b", 0, "final offset of")]
    checks = spark.createDataFrame(rows, "check_id long, book string, page_index int, quote string").withColumn("page_id", F.lit(0)).withColumn("text", F.lit("clash"))
    got = sorted((r.check_id, r.page_id) for r in hidden_quotes(checks, pages).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2), (9, 5)]
    assert hidden_quotes(checks.where(F.lit(False)), pages).count() == 0
    assert [r[0] for r in pages.select(canonical_text(F.col("text"))).where("page_id = 3").collect()] == [None]


def settled_by_brute_force(text):
    """Whole passes over the text until nothing changes, where the transducer reads it once."""
    single, before = transducer().single, None
    while text != before:
        before = text
        text = "".join(single.get(c, c) for c in unicodedata.normalize("NFC", text))
    return re.sub(" {2,}", " ", text)


CLUSTERS = "ab eéÅА\u0301\u0302\u0308 ё\u0327\u200b\u200d\xa0\u3000  \nｅﬁ\tй\u1100\u1161\u11a8각\u0902\u0947\u093cनक़\u0327\u0316ＡＫаοꓮ"


@settings(deadline=None, max_examples=600)
@given(st.text(alphabet=CLUSTERS, max_size=24))
def test_one_pass_equals_brute_force(text):
    assert canonical(text) == settled_by_brute_force(text)


def test_conflicting_rules_are_refused(monkeypatch):
    from foliant.llm import canonical as module

    monkeypatch.setitem(module.SAME_SIGN, "\uff21", "B")  # a full-width A
    with pytest.raises(MappingConflict):
        _rules()

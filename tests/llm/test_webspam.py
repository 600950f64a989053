import os

import pytest
from pyspark.sql import functions as F

from foliant.llm.webspam import find_spam, language_limits, spam_share

DATA = "/root/testdata/sf0.1/documents.parquet"
with_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")

SPAM = [
    "mutation rate. " * 40, "food chain " * 30, "récolte " * 20,
    "\n".join(f'<a href="http://x{i}.example/a">flux</a><br>' for i in range(20)), "\n".join(f"[torque notes pdf](https://x{i}.example/b)" for i in range(20)),
    " ".join(f"#flux{w}" for w in ("buy", "cheap", "pdf", "top10") * 6), "density discount, density cheap, enzyme free pdf, enzyme buy, density near me, enzyme discount, density best price, enzyme test bank",
    "\n".join(f"membrane PDF – SKU X{i} – 30.99 – ★★★★☆ – promo" for i in range(10)), "Flux (3) | Torque notes pdf | Enzyme | Membrane (8) | Census | Tariff buy | Treaty | Profile (2) | Flux | Torque",
    "Everybody wants molar mass, so get molar mass notes pdf with molar mass answer key. " * 5, "限界費用 激安, 限界費用 ダウンロード, 電場 激安, 電場 解答, 限界費用 最新, 電場 無料, 限界費用 解答",
]
REAL = [
    "The membrane depends on the pressure more than on the sample, as Section 5.1 shows. Students often confuse them.", "flux, 3, 7\ntorque, 18\nenzyme, 4, 9, 120\nmolar mass, 5\nfood chain, 7, 8\ncensus, 12",
    "1.1 Flux ........ 3\n1.2 Torque ........ 7\n1.3 Enzyme ........ 11\n1.4 Census ........ 15", "Kazin, D. (1991). Flux. Tamela Press, pp. 56–48. https://x.example/a\nGarel, E. (1905). Torque. Tamela Press, pp. 38–10. https://x.example/b",
    "t / s\tv / (m/s)\n0.0\t3.5\n0.5\t2.5\n1.0\t8.8\n1.5\t0.4", "1) Flux? a) torque b) enzyme c) flux d) 17 J\n2) Torque? a) flux b) census c) torque d) 5 V\n3) Census? a) flux b) census c) torque d) 5 V",
    "Week 1: flux; reading pp. 18–59; hand in sheet 1.\nWeek 2: torque; reading pp. 32–38; hand in sheet 2.\nWeek 3: enzyme; reading pp. 1–8; hand in sheet 3.",
    "The torque depends on the pressure of the sample in most textbooks, and the census was taken twice by the clerk of the guild before the treaty. " * 3 + "\n#flux #torque #enzyme",
    "学生常把人口数量和电场强度混为一谈。边际成本主要取决于动量，而不是热容量。考试时只要写出定义即可。", "ในการสอบเพียงแค่อธิบายความดันอากาศก็พอแล้ว เมื่อเยื่อหุ้มเซลล์เพิ่มขึ้น", "", "  \n ", None,
]


@pytest.fixture(scope="module")
def found(spark):
    """Reasons by id: SPAM from 1,000,000 on and REAL from 2,000,000 on, among the documents of a test table."""
    corpus = spark.read.parquet(DATA).select("doc_id", "text", "lang")
    own = [(1_000_000 + i, x, None) for i, x in enumerate(SPAM)] + [(2_000_000 + i, x, None) for i, x in enumerate(REAL)]
    both = corpus.unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string"))
    return {r.doc_id: r.reason for r in find_spam(both, lang_col="lang").collect()}


@with_data
@pytest.mark.parametrize("i", range(len(SPAM)))
def test_spam(found, i):
    assert 1_000_000 + i in found


@with_data
@pytest.mark.parametrize("i", range(len(REAL)))
def test_real(found, i):
    assert 2_000_000 + i not in found


def test_lines_of_spam_are_told_without_a_corpus():
    assert all(spam_share(x) > 0.5 for x in SPAM[:6]) and spam_share(SPAM[7]) > 0.5
    assert all(spam_share(x) <= 0.5 for x in REAL)


def test_limits_are_those_of_the_language(spark):
    rows = [(lang, 100, pair + i / 1000, 0.6, 0.3) for lang, pair in (("en", 0.05), ("hi", 0.2)) for i in range(60)] + [("th", 100, 0.9, 0.1, 0.0)]
    numbers = spark.createDataFrame(rows, "lang string, words int, pair double, variety double, joiners double")
    got = {r.lang: r for r in language_limits(numbers).collect()}
    assert set(got) == {"en", "hi", None}
    assert abs(got["en"].most_pair - (0.0795 + 2 * 0.0295)) < 1e-6 and abs(got["hi"].most_pair - got["en"].most_pair - 0.15) < 1e-6


def test_words_of_lists_are_learned(spark):
    terms = ["flux", "torque", "enzyme", "census", "treaty", "tariff", "profile", "membrane", "inflation", "catalyst"]
    ads = ["zorbig", "quaxel", "pluvit"]
    seeds = [(i, "flux " + ads[i % 3] + ", flux " + ads[i % 3] + ", " * 1 + ", ".join(f"flux {ads[j % 3]}" for j in range(40)), "en") for i in range(12)]
    real = [(100 + i, " ".join(f"The {a} of the {b} is not in the {c} and it was the {d} that fell on day {i}." for a, b, c, d in zip(terms, terms[i % 7 :] + terms, terms[3:] + terms, terms[5:] + terms)), "en") for i in range(60)]
    asked = [(200, "\n".join(f"{x} {ads[i % 3]}" for i, x in enumerate(terms)), "en"), (201, "\n".join(f"{x} chapter" for x in terms), "en")]
    docs = spark.createDataFrame(seeds + real + asked, "doc_id long, text string, lang string")
    got = {r.doc_id: r.reason for r in find_spam(docs, lang_col="lang").collect()}
    assert got.get(200) == "listed" and 201 not in got and all(i in got for i in range(12)) and not any(100 <= i < 160 for i in got)


def test_table(spark):
    rows = [(1, SPAM[0], 0.1), (1, SPAM[0], 0.1), (2, None, 0.1), (3, "", 0.1), (4, REAL[0], 0.9), (None, SPAM[1], 0.1), (5, (SPAM[5] + "\n") * 2000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spam_share double")
    got = find_spam(docs)
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 1, 5]
    assert find_spam(docs.where(F.lit(False))).count() == 0

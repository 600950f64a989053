import os

import pytest
from pyspark.sql import functions as F

from foliant.llm import encodings
from foliant.llm.encodings import repair, wrongly_decoded

GERMAN = "Die Größe der Oberfläche ändert sich, außerdem fällt die Übertragung für die Prüfung."
FRENCH = "L’énergie d’activation reste constante même après 12 répétitions, très légèrement."
RUSSIAN = "Когда меняется скорость реакции, обычно меняется и денежная реформа."
ARABIC = "يكفي في الامتحان ذكر التكلفة الحدية مع مثال واحد"
CHINESE = "实验中测得动量为12，与课本上的数值接近。考试时只要写出细胞膜的定义即可。"
JAPANESE = "実験では熱容量が大きくなると、人口は小さくなる。試験では定義を書けばよい。"
HINDI = "छात्र अक्सर सक्रियण ऊर्जा और कोशिका झिल्ली में भ्रम करते हैं।"


def misread(text, was, read_as):
    return text.encode(was).decode(read_as)


@pytest.mark.parametrize(
    ("text", "was", "read_as"),
    [
        (GERMAN, "utf-8", "cp1252"), (GERMAN, "utf-8", "mac_roman"), (GERMAN, "utf-8", "cp437"), (GERMAN, "cp1252", "cp850"), (GERMAN, "cp1252", "mac_roman"), (GERMAN, "mac_roman", "cp1252"),
        (FRENCH, "utf-8", "latin-1"), (FRENCH, "cp1252", "mac_roman"), (RUSSIAN, "utf-8", "cp1251"), (RUSSIAN, "utf-8", "latin-1"), (RUSSIAN, "cp1251", "latin-1"), (RUSSIAN, "utf-8", "cp866"),
        (ARABIC, "cp1256", "cp1252"), (ARABIC, "utf-8", "latin-1"), (CHINESE, "gb18030", "latin-1"), (CHINESE, "utf-8", "latin-1"), (JAPANESE, "cp932", "latin-1"), (HINDI, "utf-8", "latin-1"),
    ],
)
def test_whole_lines_come_back(text, was, read_as):
    wrong, restored = repair(misread(text, was, read_as))
    assert wrong
    assert restored == text


def test_koi8_read_as_cp1251():
    wrong, restored = repair(misread(RUSSIAN, "koi8_r", "cp1251"))
    assert wrong
    assert sum(a == b for a, b in zip(restored, RUSSIAN)) > 0.9 * len(RUSSIAN)


def test_twice_and_in_passages_only():
    twice = misread(misread(FRENCH, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert repair(f"Sauber.\n{twice}\n{FRENCH}") == (True, f"Sauber.\n{FRENCH}\n{FRENCH}")


@pytest.mark.parametrize(
    "text",
    [
        GERMAN, FRENCH, RUSSIAN, ARABIC, CHINESE, JAPANESE, HINDI, "The letters Æ, Ø and Å close the alphabet; ð and þ are older.", "In the notation of X the set Ã contains every Â and no Ä.",
        "Old price marks ¤ 12 and § 4 were kept, ¶ by the printer.", "Se escribe NÃO, SÃO y CORAÇÃO.", "The symbols √, ÷, ± and Σ", "whеn thе ѕаmple іѕ small", "glyphs (cid:12) and  remain", "5 cm³, 3 m², 20 °C, 4 µm, 7 kΩ",
        "виднo, чтo cкopocть peaкции", "f0llows the membrane", "", "   ", "plain ascii",
    ],
)
def test_right_text_stays(text):
    assert repair(text) == (False, text)


@pytest.mark.parametrize("text", ["Die H�he des Druckes", "so the learnerâ??s sketch", "was 17Â kJ in the GrÃ¶Ã?e"])
def test_lost_bytes_are_found(text):
    assert repair(text)[0]


def test_null():
    assert repair(None) == (False, None)


def test_table(spark):
    bad = misread(GERMAN, "utf-8", "cp1252")
    rows = [(1, bad, "x", True), (1, bad, "x", True), (2, None, "x", None), (3, "", "x", False), (4, GERMAN, None, True), (None, bad, "y", None), (5, (bad + "\n") * 3000, "x", False)]
    pages = spark.createDataFrame(rows, "page_id long, text string, restored string, wrong boolean")
    found = wrongly_decoded(pages)
    assert found.columns == ["page_id", "restored"]
    got = sorted((r.page_id or 0, r.restored[:20]) for r in found.collect())
    assert got == sorted([(1, GERMAN[:20])] * 2 + [(0, GERMAN[:20]), (5, GERMAN[:20])])
    assert wrongly_decoded(pages.where(F.lit(False))).count() == 0


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no test tables here")
def test_gates_change_nothing(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("text IS NOT NULL").select("text").collect()]
    lines = {line for text in texts for line in text.split("\n")}
    assert all(encodings.repair_line(x) == encodings.repair_line(x, gates=False) for x in lines)


def test_any_number_of_rounds():
    text = "Größe und Übung"
    for _ in range(6):
        text = text.encode().decode("cp1252", "strict") if all(b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) for b in text.encode()) else text
    assert encodings.repair(text)[1] == "Größe und Übung"

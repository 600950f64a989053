import pytest
from pyspark.sql import functions as F

from foliant.llm.sentences import sentence_spans, sentences


def units(text, lang=None):
    return [text[a:b] for a, b in sentence_spans(text, lang)]


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("en", ["Dr. Mertam measured 4.9 V, cf. Eq. (2.1) and Tab. 3.", "It grew by .8 V per step.", "Wait … the value needs time.", "mRNA carries it.", "i.e. the flux is lost."]),
        ("en", ["The clerk answered “no.” and closed the file.", "Who wrote “Is it real?” in 1875?", "“It is never zero.”", "Strictly speaking, it is.", "(It is treated in Ch. 2.)", "By 3 p.m. it fell."]),
        ("en", ["A. B. Niskos calls it “a quiet flux. Nothing more.” in a note on p. 3.", "The run began at 2 a.m.", "The value was 53.6 m/s.", "Heating changes it."]),
        ("de", ["Am 3. Oktober 1892 maß Dr. Undmiba genau 10,23 Volt.", "Salze, Säuren u. a. Stoffe verändern sie, z. B. bei 260 m².", "„Sie ist nie null. Das ist alles.“, schrieb er.", "Im 19. Jahrhundert galt das."]),
        ("fr", ["M. Kaqui cite « la densité. Rien de plus. » dans sa préface.", "Vers 1914 av. J.-C., elle est inconnue.", "Quelle réussite !", "Voir chap. 4, éq. 8 et p. 206."]),
        ("es", ["La Sra. Orvka dijo: «Es así. Nada más.» y cerró.", "Vive en EE. UU. desde 1882.", "¿Por qué varía?", "¡Nunca!", "A las 2 p. m. empezó."]),
        ("ru", ["А. В. Торванов писал: «Это всё. Да.» и ставил дату.", "Соли и т. д. здесь не рассмотрены.", "См. табл. 11 и стр. 37.", "Опыт начат в 1843 г. в городе.", "«Нет!» — сказал он."]),
        ("ar", ["سجل المعلم: «القيمة ثابتة. هذا كل شيء.» ثم أغلق الدفتر.", "لماذا تتغير القيمة؟", "انظر الشكل 2.7."]),
        ("hi", ["शिक्षक ने कहा, “ऊर्जा नष्ट नहीं होती। रूप बदलती है।” और पाठ समाप्त किया।", "रुको!", "डॉ. कोलम ने 2.1 मापा।"]),
    ],
)
def test_units_of_languages(lang, parts):
    assert units(" ".join(parts), lang) == parts
    assert units(" ".join(parts)) == parts  # the language is told from the text


@pytest.mark.parametrize(
    ("lang", "parts"),
    [
        ("zh", ["老师说：“动量不会消失。它只会改变形式。”然后擦掉了黑板。", "“动量在哪里？”学生问道。", "（反应速率将在第3章讨论。）", "从1853年到1877年，它下降。"]),
        ("ja", ["先生は「物価は消えない。形を変えるだけだ。」と言って消した。", "「人口は高い。」", "試験では定義を書けばよい。"]),
    ],
)
def test_scripts_without_spaces(lang, parts):
    assert units("".join(parts), lang) == parts


def test_thai_units_part_at_spaces():
    assert units("การทดลองนี้วัดได้6.032หน่วย ในการสอบเพียงแค่อธิบายก็พอแล้ว", "th") == ["การทดลองนี้วัดได้6.032หน่วย", "ในการสอบเพียงแค่อธิบายก็พอแล้ว"]


def test_lines_marks_and_captions():
    text = "3.2 Flow diagram\n1. In practice, it falls.\n• Is it? Yes.\nFigure 6.7  It falls. It rises.\nE = m c^2   (2.1)\n\n  a line that goes\non here."
    assert units(text, "en") == ["3.2 Flow diagram", "1. In practice, it falls.", "• Is it?", "Yes.", "Figure 6.7  It falls. It rises.", "E = m c^2   (2.1)", "a line that goes", "on here."]


def test_invisible_and_look_alike_characters_hide_no_abbreviation():
    assert units("D​r. Mertam came. Рrоf. X left.", "en") == ["D​r. Mertam came.", "Рrоf. X left."]


def test_table(spark):
    pages = spark.createDataFrame([(1, "It fell. We ran.", "en", 1), (2, None, "en", 2), (3, "", None, 3), (4, " \n ", "xx", 4), (1, "It fell. We ran.", None, 5), (5, "Go on. " * 20000, "EN", 6)], "page_id long, text string, lang string, start_char int")
    got = sentences(pages, lang_col="lang")
    assert got.columns == ["page_id", "start_char", "end_char"]
    assert sorted((r.page_id, r.start_char, r.end_char) for r in got.where("page_id = 1").collect()) == [(1, 0, 8), (1, 0, 8), (1, 9, 16), (1, 9, 16)]
    assert got.where("page_id = 5").count() == 20000
    assert got.where("page_id IN (2, 3, 4)").count() == 0
    assert sentences(pages.where(F.lit(False)), lang_col="lang").count() == 0
    assert sentences(pages, with_text=True).where("page_id = 1").first().sentence == "It fell."


def test_language_is_told_from_the_whole_text():
    from foliant.llm.sentences import language_of

    assert language_of("The end of the flux is in the book. " * 600 + "Der Strom ist von der Zeit und dem Weg. " * 3000) == "de"


def test_long_quotations_do_not_divide_a_sentence():
    for times in (3, 200):
        text = "She wrote: “" + "It rained. We stayed in. " * times + "Then we left” and closed the book. The end came soon."
        assert [text[a:b] for a, b in sentence_spans(text, "en")][-1] == "The end came soon."
        assert len(sentence_spans(text, "en")) == 2


def test_many_quotations_before_a_place_all_count():
    text = "(One. Two " + "(a. B) " * 20 + "three. Four) end. Next one."
    assert len(sentence_spans(text, "en")) == 2


def test_runs_of_marks_and_invisible_characters_are_no_bound():
    far = "\u200b" * 90
    assert len(sentence_spans(f"It weighed 5 kg. {far}The rest was lost.", "en")) == 2
    assert len(sentence_spans("So he waited" + "." * 90 + " and went on. Done.", "en")) == 2


def test_hours_and_etc():
    assert len(sentence_spans("The run began at 3 a.m. Gravel was found, etc. Nobody knew.", "en")) == 3
    assert len(sentence_spans("It opens at 9 a.m. Monday or 9 a.m. EST by choice.", "en")) == 1

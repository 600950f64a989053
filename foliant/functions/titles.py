"""Column functions on headings, claims and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import text as tx

#: Words before a chapter's number, and titles of introductions.
CHAPTER_WORDS = "chapter|kapitel|chapitre|capítulo|capitulo|capitolo|hoofdstuk|глава|rozdział|bölüm|chương|bab|part|unit|lesson|lektion|leçon|lección|урок"
INTRODUCTIONS = "introduction|einleitung|einführung|introducción|introduzione|introdução|inleiding|введение|wprowadzenie|giriş|giới thiệu|pendahuluan|引言|绪论|導入|はじめに|서론|مقدمة|परिचय|บทนำ"
META_WORDS = "important because this that the it is are was very matter matters key main idea concept topic section chapter learn understand know helps useful about explains describes shows point".split()
_NUMBER = rf"(?iu)^\s*(?:{CHAPTER_WORDS})\s*\.?\s*([0-9]{{1,3}}|[ivxlc]+)\b"


def chapter_number(title: Column) -> Column:
    """Number of a chapter title: after a chapter word, at its start, or between 第 and 章; roman and Chinese numerals count. Null without one."""
    named = F.regexp_extract(title, _NUMBER, 1)
    plain = F.regexp_extract(title, r"^\s*([0-9]{1,3})(?:\s|[.:)]\s)", 1)
    cjk = F.regexp_extract(title, r"第\s*([0-9]{1,3}|[一二三四五六七八九十]{1,3})\s*[章回课課]", 1)
    digits = F.when(named.rlike("^[0-9]+$"), named.cast("int")).when(named != "", tx.roman_value(named))
    return F.coalesce(digits, F.when(cjk.rlike("^[0-9]+$"), cjk.cast("int")).when(cjk != "", tx.chinese_value(cjk)), F.when(plain != "", plain.cast("int")))


def cjk_section(title: Column) -> Column:
    """Number of a 第N节 heading, null without one."""
    n = F.regexp_extract(title, r"^\s*第\s*([0-9]{1,3}|[一二三四五六七八九十]{1,3})\s*[节節]", 1)
    return F.when(n.rlike("^[0-9]+$"), n.cast("int")).when(n != "", tx.chinese_value(n))


def without_number(title: Column) -> Column:
    """A title without its chapter word and number."""
    bare = F.regexp_replace(title, rf"(?iu)^\s*(?:{CHAPTER_WORDS})\s*\.?\s*(?:[0-9]{{1,3}}|[ivxlc]+)\b\s*[.:·—–-]*\s*", "")
    bare = F.regexp_replace(bare, r"^\s*第\s*[0-9一二三四五六七八九十]{1,3}\s*[章节節回课課]\s*", "")
    return F.trim(F.regexp_replace(bare, r"^\s*[0-9]{1,3}(?:\.[0-9]{1,3})*\s*[.:)]?\s+", ""))


def is_introduction(title: Column) -> Column:
    """Whether a title names an introduction."""
    return F.lower(without_number(title)).rlike(rf"^(?:{INTRODUCTIONS})(?![\p{{L}}])")


def bare_number(title: Column) -> Column:
    """Whether a bookmark is a page number only."""
    return title.rlike(r"(?i)^\s*(?:p(?:age|\.)?\s*)?[0-9ivxlc]+\s*$")


def content_units(text: Column) -> Column:
    """Distinct words of three letters or more, numbers, and pairs of CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}&&[^\p{IsHan}]]{3,}|[0-9]+(?:[.,][0-9]+)*"), 0)
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([\p{IsHan}]{2}))"), 1)
    return F.array_distinct(F.concat(words, pairs))


def shares_words(a: Column, b: Column) -> Column:
    """Whether two texts share a unit, or long words of them begin with the same five letters."""
    x, y = content_units(a), content_units(b)
    stems = lambda u: F.array_distinct(F.transform(F.filter(u, lambda w: F.char_length(w) >= 5), lambda w: F.substring(w, 1, 5)))
    return F.arrays_overlap(x, y) | F.coalesce(F.arrays_overlap(stems(x), stems(y)), F.lit(False))


def says_nothing(claim: Column) -> Column:
    """An explanation with fewer than two words of content: one that only says that something matters."""
    units = F.filter(content_units(tx.strip_citations(claim)), lambda w: ~w.isin(*META_WORDS))
    return F.size(units) < 2


def long_enough(quote: Column, least_words: int = 4) -> Column:
    """Whether a quote marks one place: enough words and a key of twelve characters, eight where it is mostly CJK."""
    key = tx.letters_key(quote)
    wide = tx.count_of(quote, tx.CJK) * 2 > F.char_length(key)
    return ((tx.count_of(quote, r"\S+") >= least_words) & (F.char_length(key) >= 12)) | (wide & (F.char_length(key) >= 8))


def is_verbatim(claim: Column, quote: Column) -> Column:
    """Whether a claim says no more than its quote: its key lies in the quote's and is nine tenths of it, of twenty characters at least."""
    c, q = tx.letters_key(claim), tx.letters_key(quote)
    return F.coalesce((F.char_length(c) >= 20) & F.contains(q, c) & (F.char_length(c) >= F.char_length(q) * F.lit(0.9).cast("double")), F.lit(False))


def plain_answer(answer: Column) -> Column:
    """An answer without articles and case, as letters and digits."""
    return tx.letters_key(F.regexp_replace(F.lower(F.trim(answer)), r"^(?:the|a|an|der|die|das|le|la|les|el|los|las)\s+", ""))


def same_answer(kind: Column, mine: Column, key: Column) -> Column:
    """Whether two answers agree by type: a letter, true or false, a number within one per cent, words of a gap. Null where a reader has to judge."""
    a, b = mine.try_cast("double"), key.try_cast("double")
    return (
        F.when(kind == "mcq", F.upper(F.substring(F.trim(mine), 1, 1)) == F.upper(F.substring(F.trim(key), 1, 1)))
        .when(kind == "tf", F.lower(F.substring(F.trim(mine), 1, 1)) == F.lower(F.substring(F.trim(key), 1, 1)))
        .when(kind == "numeric", F.abs(a - b) <= F.abs(b) * 0.01)
        .when(kind == "cloze", plain_answer(mine) == plain_answer(key))
    )


def fixed_citations(value: Column) -> Column:
    """Other spellings of citations put into [p.N: "quote"]: (p. 3: “x”), [page 3 "x"], [S. 3: "x"]."""
    quotes = F.regexp_replace(F.regexp_replace(value, r"[“”„«»](?=[^\[\]()]*[\])])", '"'), r"\s+(?=\])", "")
    return F.regexp_replace(quotes, r'[\[(]\s*(?:p\.?|pp\.?|page|pg\.?|S\.?|Seite)\s*([0-9ivxlc]+(?:\s*[–-]\s*[0-9ivxlc]+)?)\s*[:,]?\s*"([^"]*)"\s*[\])]', '[p.$1: "$2"]')


def wrong_formula(latex: Column) -> Column:
    """A formula made false by the first change that fits: a sign, a fraction, an exponent, else a factor of two."""
    return (
        F.when(latex.rlike(r"\s\+\s"), F.regexp_replace(latex, r"^(.*?)\s\+\s", "$1 - "))
        .when(latex.rlike(r"[^\s=] - "), F.regexp_replace(latex, r"^(.*?[^\s=]) - ", "$1 + "))
        .when(latex.rlike(r"\\frac\{[^{}]*\}\{[^{}]*\}"), F.regexp_replace(latex, r"^(.*?)\\frac\{([^{}]*)\}\{([^{}]*)\}", r"$1\\frac{$3}{$2}"))
        .when(latex.rlike(r"\^\{?2\}?"), F.regexp_replace(latex, r"^(.*?)\^\{?2\}?", "$1^{3}"))
        .when(F.contains(latex, F.lit("=")), F.regexp_replace(latex, r"^(.*?)=\s*", "$1= 2 "))
    )


def card_math(value: Column) -> Column:
    """Dollar formulas in the form of card programs."""
    return F.regexp_replace(value, r"\$([^$]+)\$", r"\\($1\\)")

"""Column functions on texts. All stay in the JVM unless the docstring says otherwise; null in gives null out."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Joined letters and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]"
NO_SPACES = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
INDIC = r"[\x{0900}-\x{0DFF}\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}]"
SEMITIC = r"[\x{0590}-\x{06FF}\x{0750}-\x{077F}]"
CYRILLIC_GREEK = r"[\x{0370}-\x{03FF}\x{0400}-\x{052F}]"
CITATION = r'\[p\.?\s*([^:\]"]+):\s*"([^"]*)"\s*\]'
COVERS = r"\(covers:\s*([^)]*)\)"


def count_of(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern."""
    return F.regexp_count(text, F.lit(pattern))


def fix_ligatures(text: Column) -> Column:
    """Joined letters written out."""
    for joined, plain in LIGATURES.items():
        text = F.replace(text, F.lit(joined), F.lit(plain))
    return text


def one_line(text: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words by white space; a CJK character counts half a word, one of a script without spaces a third."""
    rest = F.regexp_replace(F.regexp_replace(text, CJK, " "), NO_SPACES, " ")
    return (count_of(rest, r"\S+") + count_of(text, CJK) / 2.0 + count_of(text, NO_SPACES) / 3.0).cast("double")


def estimate_tokens(text: Column) -> Column:
    """Rough number of model tokens by script."""
    cjk, indic, semitic, cyr = (count_of(text, p) for p in (CJK, INDIC, SEMITIC, CYRILLIC_GREEK))
    rest = F.char_length(text) - cjk - indic - semitic - cyr
    weighted = rest / F.lit(4.0) + cjk * F.lit(1.2) + indic * F.lit(0.5) + semitic * F.lit(0.4) + cyr * F.lit(0.33)
    return F.floor(weighted.cast("double")).cast("long") + 1


def letters_key(text: Column) -> Column:
    """Letters and digits in small letters: the plain form of the match key."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def short_hash(text: Column, n: int = 10) -> Column:
    """First n hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, n)


def slug(text: Column, most: int = 48) -> Column:
    """File-name form: small letters, no bracketed parts, runs of other characters as one hyphen; 'item' when nothing is left."""
    out = F.regexp_replace(F.lower(text), r"\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_]+", "-"), r"^[-_]+|[-_]+$", "")
    out = F.regexp_replace(F.substring(out, 1, most), r"^-+|-+$", "")
    return F.when(out == "", F.lit("item")).otherwise(out)


def citations(value: Column) -> Column:
    """Array of (page, quote) of all citations of a value."""
    pages = F.regexp_extract_all(value, F.lit(CITATION), 1)
    quotes = F.regexp_extract_all(value, F.lit(CITATION), 2)
    return F.transform(F.arrays_zip(pages.alias("page"), quotes.alias("quote")), lambda c: F.struct(F.trim(c["page"]).alias("page"), c["quote"].alias("quote")))


def strip_citations(value: Column) -> Column:
    """A value without its citations and cover lists."""
    return one_line(F.regexp_replace(F.regexp_replace(value, r"\[p\.?\s*[^\]]*\]", " "), COVERS, " "))


def covers(value: Column) -> Column:
    """Ids named in a value's cover list or, without one, in the value itself."""
    inner = F.regexp_extract(value, COVERS, 1)
    source = F.when(inner != "", inner).otherwise(value)
    return F.filter(F.transform(F.split(source, r"\s*,\s*"), F.trim), lambda x: x != "")


def is_unsure(value: Column) -> Column:
    """Whether a value says that the book does not tell."""
    return F.startswith(F.upper(F.trim(value)), F.lit("UNSURE"))


def normal_key(key: Column) -> Column:
    """Field names compare in small letters with single spaces; hyphens and underscores join like spaces do not."""
    return F.regexp_replace(F.lower(one_line(key)), r"\s*_\s*", "-")


def is_math_line(text: Column) -> Column:
    """A line of formulas: an equals sign in a short line, three mathematical signs, or an equation number at its end."""
    signs = count_of(text, r"[=+×÷∑∫√≈≠≤≥∞±^]")
    return (F.contains(text, F.lit("=")) & (F.char_length(text) < 90)) | (signs >= 3) | text.rlike(r"\(\d+\.\d+\)\s*$")


def garble_ratio(text: Column) -> Column:
    """How broken a text layer looks; above 0.01 counts as garbled.

    The largest of: codes without meaning beside letters or control characters by length, 0.05 for glyph codes, and half the share of
    Latin-1 letters where they are over 30 % of at least 40 letters.
    """
    bad = count_of(text, r"\p{L}[\x{FFFD}\x{E000}-\x{F8E4}]|[\x{FFFD}\x{E000}-\x{F8E4}]\p{L}") + count_of(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    length = F.nullif(F.char_length(text), F.lit(0)).cast("double")
    letters, latin1 = count_of(text, r"\p{L}"), count_of(text, r"[À-ÖØ-öø-ÿ]")
    foreign = F.when((letters >= 40) & (latin1 > letters * F.lit(0.3).cast("double")), latin1.cast("double") / letters / F.lit(2.0).cast("double")).otherwise(F.lit(0.0).cast("double"))
    glyphs = F.when(F.contains(text, F.lit("(cid:")), F.lit(0.05).cast("double")).otherwise(F.lit(0.0).cast("double"))
    return F.when(text.isNotNull(), F.coalesce(F.greatest(bad.cast("double") / length, glyphs, foreign), F.lit(0.0).cast("double")))


def braces_balanced(text: Column) -> Column:
    """Whether no brace closes before it opens and all are closed, as LaTeX needs."""
    marks = F.split(F.regexp_replace(text, r"\\[{}]|[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(marks, start, step, lambda acc: acc["ok"] & (acc["depth"] == 0))


def latex_ok(text: Column) -> Column:
    """No dollar signs, balanced braces, as many opening as closing round brackets."""
    return ~F.contains(text, F.lit("$")) & braces_balanced(text) & (count_of(text, r"\(") == count_of(text, r"\)"))


def split_cells(value: Column) -> Column:
    """Cells of a table row, parted by bars that stand outside citations."""
    masked = F.regexp_replace(value, r"\|(?=[^\[\]]*\])", "\u0001")
    return F.transform(F.split(masked, r"\|"), lambda c: F.trim(F.replace(c, F.lit("\u0001"), F.lit("|"))))


def natural_key(name: Column) -> Column:
    """Sort key in which page10 follows page9: every run of digits is padded to twelve."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(p)), "")


def to_roman(n: Column) -> Column:
    """Small roman numeral of a whole number from 1 to 3999."""
    out = F.lit("")
    for unit, letters in ((1000, " m mm mmm"), (100, " c cc ccc cd d dc dcc dccc cm"), (10, " x xx xxx xl l lx lxx lxxx xc"), (1, " i ii iii iv v vi vii viii ix")):
        table = F.array(*[F.lit(x) for x in letters.split(" ")])
        out = F.concat(out, F.element_at(table, (F.floor(n / unit) % 10 if unit < 1000 else F.floor(n / unit)).cast("int") + 1))
    return F.when((n >= 1) & (n <= 3999), out)


def roman_value(numeral: Column) -> Column:
    """Value of a roman numeral, null where it is none."""
    low = F.lower(F.trim(numeral))
    values = F.transform(F.split(low, ""), lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(
        F.reverse(values),
        start,
        lambda a, v: F.struct((a["sum"] + F.when(v >= a["last"], v).otherwise(-v)).alias("sum"), F.greatest(a["last"], v).alias("last")),
        lambda a: a["sum"],
    )
    return F.when(low.rlike(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (low != ""), total)


def chinese_value(numeral: Column) -> Column:
    """Value of a Chinese numeral up to 99, null where it is none."""
    text = F.trim(numeral)
    digit = lambda c: (F.instr(F.lit("一二三四五六七八九"), c)).cast("int")
    tens, ones = F.regexp_extract(text, "^([一二三四五六七八九]?)十", 1), F.regexp_extract(text, "([一二三四五六七八九])$", 1)
    with_ten = F.when(tens == "", 1).otherwise(digit(tens)) * 10 + F.when(ones == "", 0).otherwise(digit(ones))
    return F.when(text.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), with_ten).when(text.rlike("^[一二三四五六七八九]$"), digit(text))


#: Signs that match keys level, and signs that they keep beside letters and digits.
KEY_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁻": "-", "₋": "-", "⁄": "/", "∕": "/", "∆": "δ"}
_KEY_PART = regex.compile(r"[\p{L}\p{N}]|(?<=\d)\.(?=\d)|(?<![\p{L}\p{N}])-(?=\d)|[+=<>/%±√∑∫≈≠≤≥∞]")


def key_of(text: str | None) -> str | None:
    """Match key of a text: compatibility forms and case levelled; letters, digits, decimal points, minus signs and relations stay."""
    if text is None:
        return None
    signs = str.maketrans(KEY_SIGNS)
    plain = unicodedata.normalize("NFKC", text.translate(signs)).translate(signs).casefold()
    return "".join(_KEY_PART.findall(plain))


def match_key(text: Column) -> Column:
    """key_of() of a column, as an Arrow function: NFKC and full case folding have no form in the JVM."""

    @F.pandas_udf(T.StringType())
    def run(texts):
        import pandas as pd

        return pd.Series([key_of(x) for x in texts], dtype=object)

    return run(text)

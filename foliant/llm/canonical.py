"""One consistent form for texts that look the same.

The mapping is a transducer over grapheme clusters: a letter with the marks and invisible characters behind it, or a run of spaces. Its table is
compiled once from rules (widths, joined letters, spaces, invisible characters, look-alike letters, accents put together) and
checked for conflicts. A text is read in one pass: at every place the longest cluster that the rules touch is taken and its form from the table is
written; all else stays. Stacks of marks that the table does not list are compiled from the same rules when first met.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import broadcast_if_small

#: Letters of other scripts and the Latin letters they look like: Cyrillic, Greek, Armenian, Cherokee, Lisu, Latin letters of their own.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХЁЇԌԚԜҮ" "асеѕіјорухёїһԁԛԝӏү" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "ονϲϳ" "ՏԼՕօսոհցզ" "ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ" "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ" "ɡ",
        "ABESIJKMHOPCTYXËÏGQWY" "acesijopyxëïhdqwly" "ABEZHIKMNOPTYXCJ" "ovcj" "SLOounhgq" "ABCEHJKLMPSTVWZ" "ABCDEFGHIJKLMNOPRSTUVWXYZ" "g",
        strict=True,
    )
)
#: Hyphens and apostrophes that look alike, katakana that look like hiragana.
SAME_SIGN = {"‐": "-", "‑": "-", "﹣": "-", "ʼ": "’", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "℃": "°C"}
#: Invisible characters outside the class Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Compiled forms of clusters that are remembered; beyond it they are compiled each time (speed only, never the result).
KEPT_FORMS = 200_000
#: Compatibility forms that keep their look when written with plain characters.
PLAIN_FORMS = [
    (0x0132, 0x0133), (0x01C4, 0x01CC), (0x0E33, 0x0E33), (0x0EB3, 0x0EB3), (0x2126, 0x2126), (0x212A, 0x212B), (0x00B5, 0x00B5),
    (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFDFF), (0xFE30, 0xFE4F), (0xFE70, 0xFEFC), (0xFF01, 0xFFEF),
]


class MappingConflict(ValueError):
    """Two rules give one cluster different forms, or a form is changed again by another rule."""


def _rules() -> dict[str, str]:
    """Single characters and their forms. Rules are tried against each other: two that differ are a conflict."""
    table: dict[str, str] = {}

    def rule(source: str, target: str) -> None:
        if table.setdefault(source, target) != target:
            raise MappingConflict(f"{source!r}: {table[source]!r} and {target!r}")

    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Cf" and ch not in "\u0600\u0601\u0602\u0603\u06dd\u070f" or ch in INVISIBLE:
            rule(ch, "")
        elif kind in ("Zs", "Zl", "Zp") and ch != " " or ch in "\t\x0b\x0c\x85":
            rule(ch, " ")
        if (same := unicodedata.normalize("NFC", ch)) != ch and kind not in ("Zs", "Cf"):
            rule(ch, same)
    for first, last in PLAIN_FORMS:
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            blank = plain and all(table.get(c) == "" for c in plain)  # a wide form of an invisible character
            if plain != chr(code):
                rule(chr(code), "" if blank else _wide_or_composed(chr(code), plain))
    for ch, same in (LOOK_ALIKE | SAME_SIGN).items():
        rule(ch, same)
    for source in list(table):  # a form made of characters that have rules goes on to theirs
        while (again := "".join(table.get(c, c) for c in table[source])) != table[source]:
            table[source] = again
    return table


def _wide_or_composed(ch: str, plain: str) -> str:
    """The plain form of a compatibility character; one that is canonically another character alone keeps to that one."""
    same = unicodedata.normalize("NFC", ch)
    return same if same != ch else plain


def _class(some: set[str]) -> str:
    """The inside of a character class, as ranges."""
    out: list[list[int]] = []
    for code in sorted(map(ord, some)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Transducer:
    """The compiled mapping."""

    def __init__(self):
        self.single = _rules()
        self.forms: dict[str, str] = {}
        for ch in self.single:
            self.forms[ch] = self._compile(ch)
        for code in range(0x110000):  # letters with one mark: every canonical composition, as it is spelled apart
            parts = unicodedata.decomposition(chr(code))
            if parts and parts[0] != "<" and " " in parts and not 0xAC00 <= code < 0xD7A4:
                pair = "".join(chr(int(x, 16)) for x in parts.split())
                for spelled in {pair, unicodedata.normalize("NFD", chr(code)), *([chr(code)] if chr(code) in self.single else [])}:
                    self.forms[spelled] = self._compile(spelled)
        for source, form in self.forms.items():
            if form != self._compile(form):
                raise MappingConflict(f"the form of {source!r} is changed again")
        self.gone = frozenset(c for c, form in self.single.items() if form == "")
        self.space = frozenset(c for c, form in self.single.items() if form == " ") | {" "}
        marks = {chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M"} | {chr(c) for c in range(0x1160, 0x1200)}
        self.behind = frozenset(marks | self.gone)  # what belongs to the cluster of the character before
        # where a text is composed, only characters with a rule can start a change, else any mark can
        single = _class(set(self.single))
        self.starts = [re.compile(f"[{x}]{two}") for x in (single, single + _class(marks)) for two in ("", "| (?= )")]

    def _compile(self, cluster: str) -> str:
        """Form of a cluster: put together, mapped, and put together again where mapping made a new letter."""
        while True:
            joined = unicodedata.normalize("NFC", cluster)
            form = "".join(self.single.get(c, c) for c in joined)
            if form == joined:
                break
            cluster = form
        return " " if form and form.isspace() and form != "\n" else form

    def form(self, cluster: str) -> str:
        """Form of a cluster, compiled when first met if the table does not list it."""
        found = self.forms.get(cluster)
        if found is None:
            found = self._compile(cluster)
            if len(self.forms) < KEPT_FORMS:
                self.forms[cluster] = found
        return found

    def __call__(self, text: str) -> str:
        starts = self.starts[2 * (not unicodedata.is_normalized("NFC", text)) + ("  " in text)]
        gone, space, behind, n = self.gone, self.space, self.behind, len(text)
        out, done = [], 0
        for m in starts.finditer(text):
            at = m.start()
            if at < done:
                continue
            first, end = at, at + 1
            while end < n and text[end] in gone:
                end += 1
            if text[at] in space or end < n and text[end] in space and all(c in gone for c in text[at:end]):
                while first > done and (text[first - 1] in space or text[first - 1] in gone):
                    first -= 1
                while end < n and (text[end] in space or text[end] in gone):
                    end += 1
            else:
                if text[at] in behind:
                    while first > done and text[first - 1] in behind:
                        first -= 1
                    if first > done and text[first - 1] != "\n":
                        first -= 1
                while end < n and text[end] in behind:
                    end += 1
            out.append(text[done:first])
            out.append(self.form(text[first:end]))
            done = end
        out.append(text[done:])
        return "".join(out)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The transducer, compiled once in a process."""
    return Transducer()


def canonical(text: str | None) -> str | None:
    """The consistent form of a text; line feeds stay. Null stays null, empty stays empty; applying it again changes nothing."""
    return transducer()(text) if text else text


def canonical_text(text: Column) -> Column:
    """canonical() of a column."""

    @F.pandas_udf(T.StringType())
    def run(texts):
        import pandas as pd

        return pd.Series([canonical(x) for x in texts], dtype=object)

    return run(text)


def _sees(text: Column, quote: Column) -> Column:
    """Whether the canonical quote lies within one line of the canonical text."""

    @F.pandas_udf(T.BooleanType())
    def run(texts, quotes):
        import pandas as pd

        out, last, lines = [], None, ""
        for text, quote in zip(texts, quotes):
            if text != last:  # the pages of one partition come with several quotes each
                last, lines = text, "\n".join(x.strip() for x in canonical(text).split("\n"))
            look = canonical(quote.replace("\n", " ")).strip()
            out.append(bool(look) and look in lines)
        return pd.Series(out, dtype=bool)

    return run(text, quote)


def hidden_quotes(checks: DataFrame, pages: DataFrame) -> DataFrame:
    """check_id and page_id of quotes that a reader sees on a row of their cited page but that differ in their characters.

    checks: check_id, book, page_index, quote. pages: page_id, book, page_index, text. Null and blank quotes and texts, and
    rows without book or page_index, find nothing. Quotes that are there character for character are left out. Every row of a page that was
    delivered several times is compared; repeated checks come out as often as they came in. Other columns are not read.
    """
    q = checks.select("check_id", "book", "page_index", "quote").where(F.trim(F.regexp_replace("quote", r"\s+", " ")) != "")
    p = pages.select("page_id", "book", "page_index", "text").where("text IS NOT NULL AND text != ''")
    cited = q.select("book", "page_index").distinct()
    if (few := broadcast_if_small(cited, rows=5_000)) is not cited:  # else many pages are cited, and the join below brings them together
        p = p.join(few, ["book", "page_index"], "left_semi")
    pairs = p.join(q, ["book", "page_index"]).where(~F.contains("text", "quote"))
    return pairs.where(_sees(F.col("text"), F.col("quote"))).select("check_id", "page_id")

"""Text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy encoding. An automaton of the byte structure of a multibyte encoding (compiled from
its lead and trail bytes) finds the maximal well-formed spans of those bytes, and only these spans are decoded. Encodings of single
bytes have no such structure; there a word is taken for wrong when it cannot be a word as it stands and is one in the other encoding.
Passages are taken line by line, so that a page may hold several encodings, and again until nothing changes, as a text may
have been decoded wrongly more than once.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.canonical import LOOK_ALIKE

#: Byte structure of the multibyte encodings (after the first byte the trail bytes).
STRUCTURE = {
    "utf-8": "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}",
    "gb18030": "[\x81-\xfe](?:[\x40-\x7e\x80-\xfe]|[0-9][\x81-\xfe][0-9])",
    "cp932": "[\x81-\x9f\xe0-\xef](?:[\x40-\x7e\x80-\xfc])|[\xa1-\xdf]",
    "euc_jp": "[\xa4-\xa5\xb0-\xf4][\xa1-\xfe]|\xa1[\xa1-\xfe]|\x8f[\xa1-\xfe]{2}",
}
#: Encodings that UTF-8 text is read as by mistake, the likelier first.
READ_AS = ["cp1252", "cp1251", "cp437", "mac_roman", "cp850", "cp1250", "cp866", "koi8_r", "mac_cyrillic", "cp1256", "cp1254", "cp1253"]
#: Fixed values: (read as, was) of single-byte encodings for words of Latin, Cyrillic and Arabic letters.
LATIN_PAIRS = [("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp866", "cp1252"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"), ("mac_roman", "cp850"), ("cp850", "mac_roman"), ("cp437", "mac_roman")]
SCRIPT_PAIRS = [
    ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "cp866"),
    ("cp1252", "mac_cyrillic"), ("cp1252", "iso8859_5"), ("cp1252", "cp1256"), ("cp1252", "iso8859_6"), ("mac_roman", "cp1251"), ("cp850", "cp1251"), ("cp437", "cp866"), ("cp850", "cp866"),
    ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"), ("cp1251", "cp1256"), ("koi8_r", "cp866"), ("cp866", "koi8_r"),
]
#: Letters of Latin languages here, and signs that may stand beside words.
LATIN = set("abcdefghijklmnopqrstuvwxyzäöüßéèêëàâîïôùûçœæáíóúñÿ" "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊËÀÂÎÏÔÙÛÇŒÆÁÍÓÚÑ")
RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяёАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ")
ARABIC = set("ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيًٌٍَُِّْ،؛؟ـ")
SIGNS = set("\xa0\xad\u2002\u2007\u2009\u202f" "–—‘’‚“”„•…‹›«»€™°±²³µ¶·¹º¼½¾¿×÷−≠≤≥≈√∞∆Ωμ¡§¬®©£¥→←″′★☆")
#: Letters without their like in the Latin alphabet; only these tell a Cyrillic reading of a Latin word from look-alike letters.
UNLIKE = set("бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯ")


def _reverse(encoding: str) -> dict[int, int]:
    """Code point to byte for the upper half of a single-byte encoding; bytes without a character pass through as controls."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[ord(bytes([byte]).decode(encoding))] = byte
        except UnicodeDecodeError:
            table[byte] = byte
    if encoding in ("cp1252", "cp1250", "cp1254", "cp1253", "cp1256", "cp1251"):
        for byte in range(0x80, 0xA0):  # the first halves of such texts are often read as Latin-1
            table.setdefault(byte, byte)
    return table


class _Bytes(dict):
    """Translation to bytes as Latin-1 text; what has no byte becomes U+FFFF, ASCII stays."""

    def __missing__(self, code: int) -> int:
        self[code] = got = code if code < 0x80 else 0xFFFF
        return got


@lru_cache(maxsize=64)
def _to_bytes(encoding: str) -> _Bytes:
    return _Bytes(_reverse(encoding))


@lru_cache(maxsize=64)
def _recode(read_as: str, was: str) -> dict[int, str]:
    """Code point to the character its byte has in the other encoding."""
    out = {}
    for code, byte in _reverse(read_as).items():
        try:
            out[code] = bytes([byte]).decode(was)
        except UnicodeDecodeError:
            continue
    return out


@lru_cache(maxsize=8)
def _automaton(encoding: str) -> regex.Pattern:
    return regex.compile(f"(?:{STRUCTURE[encoding]})+")


@lru_cache(maxsize=64)
def _span_automaton(read_as: str) -> regex.Pattern:
    """The automaton of UTF-8 with every byte written as the character that it is read as."""
    back: dict[int, str] = {}
    for code, byte in _reverse(read_as).items():
        back[byte] = back.get(byte, "") + regex.escape(chr(code))
    among = lambda first, last: "[" + "".join(back.get(b, "") for b in range(first, last + 1)) + "]"
    parts = [
        among(0xC2, 0xDF) + among(0x80, 0xBF),
        among(0xE0, 0xE0) + among(0xA0, 0xBF) + among(0x80, 0xBF),
        among(0xE1, 0xEF) + among(0x80, 0xBF) + "{2}",
        among(0xF0, 0xF4) + among(0x80, 0xBF) + "{3}",
    ]
    return regex.compile(f"(?:{'|'.join(parts)})+")


@lru_cache(maxsize=1)
def _any_pair() -> regex.Pattern:
    """A lead character followed by a trail character in any of the encodings: the sign that a closer look is due."""
    return regex.compile("|".join(sorted({p for r in READ_AS for p in _span_automaton(r).pattern[3:-2].split("|")[:3]})))


_UNIT = regex.compile(STRUCTURE["utf-8"])
_WORD = regex.compile(r"\S+")
_ASCII_LETTER = regex.compile(r"[A-Za-z]")


def _expected(ch: str) -> bool:
    """A character that texts of the ten languages are made of."""
    code = ord(ch)
    return (
        ch in LATIN or ch in SIGNS or ch in RUSSIAN or ch in ARABIC or ch in "ÅåÃãÕõØøÐðÞþŠšŽžŸÆæ¢¤¦¨ª¯´¸"
        or 0x0600 <= code < 0x0700 or 0x0900 <= code < 0x0980 or 0x0E00 <= code < 0x0E80
        or 0x3000 <= code < 0x3100 or 0x4E00 <= code < 0xA000 or 0xFF00 <= code < 0xFFF0 or 0x2000 <= code < 0x2070 or 0x2100 <= code < 0x2300
        or 0x0391 <= code <= 0x03C9 or 0xFB00 <= code < 0xFB07 or 0x0300 <= code < 0x0310 or 0x2F00 <= code < 0x2FE0 or code in (0xFEFF,)
    )


_CYRILLIC_READ = ("cp1251", "cp866", "koi8_r", "mac_cyrillic")


def _case_broken(word: str) -> bool:
    """A capital after a small letter that is no camel case of ASCII letters."""
    return any(a.islower() and b.isupper() and (ord(a) > 127 or ord(b) > 127) for a, b in zip(word, word[1:]))


def _utf8_spans(line: str, read_as: str) -> list[tuple[int, int, str]]:
    """Start, end and restored text of the spans of a line that are UTF-8 read as another encoding."""
    found = []
    table = _to_bytes(read_as)
    for m in _span_automaton(read_as).finditer(line):
        try:
            back = m.group().translate(table).encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        if all(map(_expected, back)) or (sum(map(_expected, back)) >= 0.9 * len(back) and len(back) > 12) or _automaton("utf-8").fullmatch(back) or _span_automaton(read_as).fullmatch(back):
            found.append((m.start(), m.end(), back))
    if not found:
        return []
    if read_as in _CYRILLIC_READ or read_as == "cp1256":
        # such bytes are letters themselves: a span counts when it cannot be words of its own script
        sure = [f for f in found if not _own_words(line[f[0] : f[1]], read_as)]
        if not sure:
            return []
        return [f for f in found if f in sure or f[1] - f[0] > 2 or len(sure) > 1 and not f[2].isascii()]
    if read_as in ("cp850", "mac_roman", "cp437", "cp1250", "cp1254", "cp1253"):
        han = [c for f in found for c in f[2] if "⺀" <= c <= "鿿"]
        if len(han) < 4 or sum(map(_level_one, han)) < 0.8 * len(han):
            found = [f for f in found if not any("⺀" <= c <= "鿿" for c in f[2])]
        return [f for f in found if not _plain_pair(line[f[0] : f[1]], f[2])]
    return found


def _own_words(span: str, read_as: str) -> bool:
    """Whether a span could be text of the script it is written in."""
    if read_as == "cp1256":
        return all(c in ARABIC or c in " \xa0«»،؛؟().:" for c in span)
    if any(c in "РСвЂ" for c in span[::2]) and len(span) > 2 and any(not c.isalpha() or c not in RUSSIAN for c in span[1::2]):
        return False
    if any(0x2500 <= ord(c) < 0x25A0 for c in span):
        return False
    if len(span) == 2 and span[0] in "РС" and span[1] in "ѓђѕіїјљњћќўџґєЃЂЅІЇЈЉЊЋЌЎЏҐЄё°±µ¶·":
        return False
    return not _case_broken(span) or all(c in RUSSIAN for c in span) and len(span) < 4


def _plain_pair(span: str, back: str) -> bool:
    """A lone pair of ordinary letters that happens to be well formed, as in ’é."""
    return len(span) == 2 and all(c in LATIN or c in "’“”–—«»" for c in span) or not all(map(_expected, back))


_HAN = regex.compile(r"[⺀-鿿豈-﫿-　-ヿ㄀-ㄯ︰-﹏＀-￯€℃№�一-鿿。-ﾟ]{2,}[?�]?")


def _wide_read(line: str) -> list[tuple[int, int, str]]:
    """Spans of UTF-8 that were read as a double-byte encoding of Chinese or Japanese."""
    found = []
    for m in _HAN.finditer(line):
        span = m.group()
        for read_as in ("gb18030", "cp932"):
            raw = span.replace("�", "").encode(read_as, "ignore").decode("latin-1")
            units = [u.group() for u in _UNIT.finditer(raw)]
            if len(units) >= 2 and sum(map(len, units)) >= 0.75 * len(raw):
                back = raw.encode("latin-1").decode("utf-8", "replace")
                good = sum(map(_expected, back))
                if good >= 0.7 * len(back) and back != span:
                    found.append((m.start(), m.end(), back))
                    break
    return found


_HIGH_RUN = regex.compile(r"[\x80-\xff–—‘-„†-•…‰‹›€ŒœŠšŸŽžƒˆ˜™]{4}|[\x80-\x9f‚ƒ„]\S")


def _level_one(ch: str) -> bool:
    """A frequent Chinese character: those in the first level of the national standard, or a mark or kana."""
    try:
        lead = ch.encode("gb2312")[0]
    except UnicodeEncodeError:
        return False
    return 0xB0 <= lead <= 0xD7 or 0xA1 <= lead <= 0xA5


def _level_one_japanese(ch: str) -> bool:
    """A frequent Japanese character: kana, marks and the first level of the national standard."""
    try:
        return 0x81 <= ch.encode("cp932")[0] <= 0x98
    except UnicodeEncodeError:
        return False


def _double_byte(line: str) -> list[tuple[int, int, str]]:
    """Spans of a double-byte encoding of Chinese or Japanese that were read as a Western one."""
    if not _HIGH_RUN.search(line):
        return []
    raw = line.translate(_to_bytes("cp1252"))
    best: list[tuple[int, int, str]] = []
    score = 0.0
    for was in ("gb18030", "cp932", "euc_jp"):
        found, good, total = [], 0, 0
        frequent = _level_one if was == "gb18030" else _level_one_japanese
        for m in _automaton(was).finditer(raw):
            if sum(ord(c) > 0x7F for c in m.group()) < 4:
                continue
            try:
                back = m.group().encode("latin-1").decode(was)
            except UnicodeDecodeError:
                continue
            wide = [c for c in back if ord(c) > 0x7F]
            fine = sum(("぀" <= c <= "ヿ" or frequent(c) and not 0x0370 <= ord(c) < 0x0460 or c in "µ³²°·−Å×") and not 0xFF61 <= ord(c) < 0xFFA0 for c in wide)
            if len(wide) >= 2 and fine >= 0.85 * len(wide) and (any("一" <= c <= "鿿" or "぀" <= c <= "ヿ" for c in wide)):
                found.append((m.start(), m.end(), back))
                good += fine
            total += len(wide)
        kana = sum("぀" <= c <= "ゟ" for f in found for c in f[2])
        rate = good / (total or 1) + (0.3 if kana else 0) if good >= 3 else 0.0
        if rate > score:
            best, score = found, rate
    return best if score >= 0.6 else []


_VOWELS = set("аеиоуыэюяёАЕИОУЫЭЮЯЁ")


_ALPHABETS = (regex.compile(f"[{''.join(RUSSIAN)}]"), regex.compile(f"[{''.join(ARABIC)}]"))
_HIGH_LETTER = regex.compile(r"[\x00-\x7f«»“”„–—…•’\xad\xa0]")


def _script_words(line: str) -> list[tuple[int, int, str]]:
    """Words of Cyrillic or Arabic letters in a single-byte encoding that were read as another one."""
    if not _ODD_SCRIPT.search(line):
        return []
    words = [m for m in _WORD.finditer(line) if not m.group().isascii() and not _ASCII_LETTER.search(m.group())]
    sample = _HIGH_LETTER.sub("", "".join(m.group() for m in words))
    best: tuple[float, list[tuple[int, int, str]]] = (0.0, [])
    for read_as, was in SCRIPT_PAIRS:
        table = _recode(read_as, was)
        alphabet = ARABIC if was in ("cp1256", "iso8859_6") else RUSSIAN
        if len(_ALPHABETS[was in ("cp1256", "iso8859_6")].findall(sample.translate(table))) < 0.6 * len(sample):
            continue
        found, doubtful, gain, strong = [], [], 0.0, 0
        for m in words:
            word = m.group()
            back = word.translate(table)
            letters = [c for c in back if ord(c) > 0x7F and (c.isalpha() or c in ARABIC)]
            old = [c for c in word if ord(c) > 0x7F and c not in "«»“”„–—…•­"]
            if all(c in LOOK_ALIKE for c in old):
                continue
            if not letters or not old or not all(c in alphabet for c in letters) or back == word or not all(ord(c) in table for c in old):
                continue
            fair = len(letters) >= 0.75 * len(old)
            if alphabet is RUSSIAN:
                body = "".join(letters)
                fair = fair and not _case_broken(body) and (len(body) < 4 or 0.15 <= sum(c in _VOWELS for c in body) / len(body) <= 0.75)
            if not fair:
                continue
            odd = _odd_word(word, read_as)
            if odd:
                strong += len(letters)
            elif read_as in _CYRILLIC_READ and all(c in RUSSIAN for c in old):
                doubtful.append((m.start(), m.end(), back))
                continue
            gain += len(letters) * (1.0 if odd else 0.2)
            found.append((m.start(), m.end(), back))
        if doubtful and found:  # words that could stand as they are go with their neighbours on both sides
            found = _with_neighbours(found, doubtful, line)
        common = _common_share("".join(f[2] for f in found), alphabet)
        if strong >= 4 and gain * common > best[0]:
            best = (gain * common, found)
    return best[1]


_ODD_SCRIPT = regex.compile(
    r"(?<![A-Za-z])[À-ÿ¸¨³¿ºª-]{3}|[а-яё][А-ЯЁ]|[ЀЂЃЄЇЉЊЋЌЍЎЏѐђѓєїљњќћѝўџҐґ]|[─-▟]|[ɐ-ʯ]|(?<!\S)[À-ÿ]{2}(?!\S)"
)


def _odd_word(word: str, read_as: str) -> bool:
    """A word that is none in the script it is written in: all accented Latin letters, or Cyrillic with broken case or foreign letters."""
    high = [c for c in word if ord(c) > 0x7F and c not in "«»“”„–—…•’­"]
    if len(high) < 2:
        return False
    if read_as in ("cp1252", "mac_roman", "cp850", "cp437"):
        return True
    return _case_broken("".join(high)) or high[0].islower() and all(c.isupper() for c in high[1:]) or sum(c not in RUSSIAN for c in high) >= 0.4 * len(high)


#: The most frequent letters of Russian and Arabic.
_FREQUENT = {"ru": set("оеаинтсрвлкмдпуя"), "ar": set("اليمونترةبع")}


def _with_neighbours(found: list, doubtful: list, line: str) -> list:
    """The found words, and those doubtful ones between them or, if written in capitals, next to them in an unbroken row."""
    inside = [d for d in doubtful if found[0][0] < d[0] < found[-1][0]]
    sure = {f[0] for f in found} | {d[0] for d in inside}
    row = sorted([*found, *doubtful])
    for order in (row, row[::-1]):
        last = False
        for f in order:
            if f[0] in sure:
                last = True
            elif last and (line[f[0] : f[1]].strip(".,;:!?«»").isupper() or f[1] - f[0] == 1):
                sure.add(f[0])
            else:
                last = False
    return [f for f in row if f[0] in sure]


def _common_share(text: str, alphabet: set[str]) -> float:
    letters = [c.lower() for c in text if c in alphabet]
    frequent = _FREQUENT["ar" if alphabet is ARABIC else "ru"]
    return sum(c in frequent for c in letters) / len(letters) if letters else 0.0


_INNER = regex.compile(r"[^\x00-\x7f]")


def _latin_words(line: str) -> list[tuple[int, int, str]]:
    """Words of accented Latin letters in a single-byte encoding that were read as another one."""
    if line.isascii():
        return []
    best: tuple[float, list[tuple[int, int, str]]] = (0.0, [])
    words = [m for m in _WORD.finditer(line) if not m.group().isascii()]
    oddness = {m.start(): _oddness(m.group()) for m in words}
    if not any(oddness.values()):
        return []
    cyrillic = sum(c in UNLIKE for c in line)
    mixed = cyrillic > 0.25 * sum(c.isascii() and c.isalpha() for c in line)  # Cyrillic with look-alike letters
    for read_as, was in LATIN_PAIRS:
        if mixed and read_as in _CYRILLIC_READ:
            continue
        table = _recode(read_as, was)
        found, doubtful, weight, spoiled, certain = [], [], 0.0, 0, 0
        for m in words:
            word = m.group()
            high = [c for c in word if ord(c) > 0x7F]
            if not any(ord(c) in table for c in high):
                continue
            back = word.translate(table)
            fit = all(c in LATIN or c in SIGNS for c in back if ord(c) > 0x7F)
            letters = [c for c in back if c.isalpha()]
            strength = oddness[m.start()]
            if fit and strength and not _case_broken(back) and _reads_better(word, back):
                if len(letters) >= 3 and any(c in LATIN and ord(c) > 0x7F for c in back) and any(c.isascii() and c.isalpha() for c in back):
                    weight += strength
                    certain += strength >= 1
                    found.append((m.start(), m.end(), back))
                elif len(back) <= 2 or not letters:
                    found.append((m.start(), m.end(), back))
            elif not strength and not fit:
                spoiled += 1
            elif fit and not strength and back != word and not _case_broken(back):
                doubtful.append((m.start(), m.end(), back))
        if weight - spoiled > best[0] and (certain >= 1 or len([f for f in found if f[1] - f[0] > 2]) >= 2):
            inside = [d for d in doubtful if found[0][0] < d[0] < found[-1][0]]
            best = (weight - spoiled, found + inside)
    return best[1]


def _reads_better(word: str, back: str) -> bool:
    """The word in the other encoding has its marks at the rim only, and fewer strange characters."""
    core = back.strip("".join(SIGNS) + ".,;:!?()[]\"'-/0123456789%$")
    if any(c in SIGNS and c not in "’‘-­²³°µ–·" for c in core):
        return False
    return not any(c in "²³°µ·±" for i, c in enumerate(core) if i + 1 < len(core) and core[i + 1].isalpha() and i and core[i - 1].isalpha())


def _oddness(word: str) -> float:
    """How surely a word with ASCII letters cannot be one: a sign between letters or a capital after a small letter; or a strange letter."""
    core = word.strip(".,;:!?()[]\"'“”„«»’-–—…•")
    strength = 0.0
    if core.isupper() and core.isalpha():
        return 0.0
    for i, c in enumerate(core):
        if ord(c) < 0x80:
            continue
        before, after = core[i - 1 : i], core[i + 1 : i + 2]
        near = (before.isalpha() and before.isascii()) or (after.isalpha() and after.isascii())
        if not near:
            continue
        if not c.isalpha():
            if c in "’‘‐‑–—·/­​‌‍⁠﻿°µ" or unformed(c) or c in "²³" and not after.isalpha() or c in " ":
                continue
            if c in "“”„«»…•¬":
                strength = max(strength, 1.0 if before.isalpha() and after.isalpha() and c in "„•…" and before.islower() and after.islower() else 0.0)
                continue
            strength = max(strength, 1.0 if before.isalpha() and (after.isalpha() or c in "│▓▀÷‰") or after.isalpha() and after.islower() else 0.0)
        elif before.islower() and c.isupper() and ord(c) > 0x7F and c not in "ΩÅ":
            strength = max(strength, 1.0 if after.islower() or not after else 0.5)
        elif c in UNLIKE and before.isascii() and before.isalpha() or c in UNLIKE and after.isascii() and after.isalpha():
            strength = max(strength, 1.0)
        elif c not in LATIN and c.isalpha() and not ("Ͱ" <= c <= "ӿ") and not ("＀" <= c <= "￯") and not ("ﬀ" <= c <= "ﬆ") and c not in "ÅåØøÆæ":
            strength = max(strength, 0.6)
        elif c in "ΣσφδεταΓΘΦπ" and (before.isascii() and before.islower() or after.isascii() and after.islower()):
            strength = max(strength, 0.8)
    return strength


def unformed(c: str) -> bool:
    return 0xE000 <= ord(c) < 0xF900


#: What remains of a wrongly decoded character when bytes were lost on the way.
_LOST = regex.compile(
    r"�|â[?�]{1,2}(?=\W|\w)|â[€\x80][?�]?|[ÃÂÐÑØÙ][?�](?![\w?])|(?<=\p{Ll})[ÃÂ]\?(?=\p{Ll})|(?<=\s|^)[ÃÂ]\?(?=\p{Ll})|(?<=[\p{L}\p{N}.,;:!?%)])Â(?=[\s\xa0]|$)|Â[ \xa0](?=[«»])|â[’\x80-\x9f]|Ã[\x80-\x9f\xad](?=\p{Ll})|[\x80-\x9f]"
)


def _apply(line: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, back in sorted(spans):
        if start < at:
            continue
        out += [line[at:start], back]
        at = end
    return "".join([*out, line[at:]])


_SAFE = regex.compile(r"[^\x00-\x7f\xa0\xad\u2002\u2007\u2009\u200b-\u200d\u202f\u2060\ufeffäöüßÄÖÜéèêëàâîïôùûçœáíóúñ¿¡’‘“”„«»–—…•°·−ΩµÅ²³]")
_CAPITAL_INSIDE = regex.compile(r"â[?€]|\p{Ll}[À-ÖØ-Þ]|[\p{Ll}\p{Lu}]„\p{Ll}|[a-z][«»²³°·…•][a-z]|[²³][a-z]|\s[²³·°…]\p{Ll}{2}")


_PLAIN_LINE = regex.compile(
    r"[\x00-\x7f\xa0\xad\u2002\u2007\u2009\u200b-\u200d\u202f\u2060\ufeffäöüßÄÖÜéèêëàîïôùûçœáíóúñ¿¡’‘“”„«»–—…•°·−ΩµÅ²³‐‑"
    r"а-яёА-ЯЁѕіјԁһѵΑ-ω\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u3000-\u30ff\u4e00-\u9fff\uff01-\uff5eﬀ-ﬄ\u0300-\u0308⼀-⿟]+"
)
_GLUED = regex.compile(f"[A-Za-z][{''.join(sorted(UNLIKE))}ΣσφδεταΓΘΦπ]|[{''.join(sorted(UNLIKE))}ΣσφδεταΓΘΦπ][A-Za-z]|(?:^|\\s)[α](?:\\s|$)")


def repair_line(line: str, gates: bool = True) -> tuple[str, bool]:
    """A line with its wrongly decoded passages restored, and whether it had any; decoded again as long as something changes.

    The gates pass lines of plain letters by, in which the stages find nothing or, rarely, take a line for wrong that is not; without them every stage reads every
    line that is not ASCII.
    """
    if line.isascii() or gates and not (_SAFE.search(line) or _CAPITAL_INSIDE.search(line)):
        return line, False
    wrong = False
    if gates and _PLAIN_LINE.fullmatch(line) and not (_ODD_SCRIPT.search(line) or _GLUED.search(line) or _CAPITAL_INSIDE.search(line)):
        # nothing but letters of the ten languages in good order; Chinese and Japanese may still be another reading of UTF-8
        spans = _wide_read(line) if any("⺀" <= c <= "鿿" for c in line) else []
        return (_apply(line, spans), True) if spans else (line, False)
    seen = {line}
    while True:
        spans_of = (_utf8_spans(line, r) for r in READ_AS) if _any_pair().search(line) else ()
        options = [(sum(e - s for s, e, _ in f), f) for f in spans_of if f]
        if any("⺀" <= c <= "鿿" for c in line):
            wide = _wide_read(line)
            options += [(2 * sum(e - s for s, e, _ in wide), wide)] * bool(wide)
        most = max(options, key=lambda o: o[0], default=(0, []))
        other = max((_double_byte(line), _script_words(line)), key=lambda f: sum(e - s for s, e, _ in f))
        spans = other if sum(e - s for s, e, _ in other) > 1.3 * most[0] else most[1]
        spans = spans or _latin_words(line)
        after = _apply(line, spans)
        if after in seen:  # settled, or back at an earlier reading
            break
        seen.add(after)
        line, wrong = after, True
    if wrong:  # a no-break space of such a passage may have become a plain one
        line = regex.sub(r"(?<=\s)Ã (?= )", "à", regex.sub(r"(?<=[\p{L}\p{N}.,;:!?%°)])Â(?=\s)", "", line))
    return line, wrong or bool(_LOST.search(line))


def repair(text: str | None) -> tuple[bool, str | None]:
    """(holds a wrongly decoded passage, restored text). Null, empty and blank texts hold none and stay."""
    if not text or text.isascii():
        return False, text
    lines, wrong = [], False
    for line in text.split("\n"):
        back, bad = repair_line(line)
        lines.append(back)
        wrong |= bad
    return wrong, "\n".join(lines) if wrong else text


def repaired(text: Column) -> Column:
    """Struct of wrong and restored for a column of texts."""
    kind = T.StructType([T.StructField("wrong", T.BooleanType()), T.StructField("restored", T.StringType())])

    @F.pandas_udf(kind)
    def run(texts):
        import pandas as pd

        done = [repair(x) for x in texts]
        return pd.DataFrame({"wrong": [d[0] for d in done], "restored": [d[1] for d in done]})

    return run.asNondeterministic()(text)  # else a filter on the result is computed a second time below an exchange


def wrongly_decoded(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """id and restored text of the rows that hold a wrongly decoded passage, restorable or not.

    Rows of ASCII text, null, empty and blank ones are passed over before Python; repeated rows come out as often as they came in; a null
    id stays null; an empty table gives an empty one. Flags and other columns are not read.
    """
    rows = pages.select(pages[id_col], pages[text_col].alias("__text")).where(F.col("__text").rlike(r"[^\x00-\x7F]"))
    done = rows.select(id_col, repaired(F.col("__text")).alias("r"))
    return done.where("r.wrong").select(id_col, F.col("r.restored").alias("restored"))

"""Sentence units of texts in any script, by cascading tables of break and no-break rules.

Every place where a sentence could end is a candidate: after a mark of ending, its closing quotes and brackets and the white
space behind, or after white space alone in Thai. The tables of the language are tried in order; the first rule whose patterns
fit the text before and after the candidate decides. Texts before and after are matched in their canonical form, so that invisible
and look-alike characters do not hide an abbreviation.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.arrow import emit_rows
from foliant.llm.canonical import canonical

#: Abbreviations before which a sentence goes on whatever follows, by language.
JOINING = {
    "en": "Dr Prof Mr Mrs Ms St Mt Rev Gen Col Lt Capt Hon cf viz approx vs esp al Fig Figs fig Eq Eqs eq Tab tab Sect Sec sect Ch ch Vol vol No Nos no nos pp p col cols Ref ref ed eds b d ca i.e e.g incl resp max min",
    "de": "Dr Prof Hr Fr St Dipl Ing Dipl.-Ing vgl Vgl Abb Tab Nr nr S Bd Kap Abs Art bzw bzgl ca evtl ggf inkl sog z.B d.h u.a u.U z.T i.d.R o.ä v.a s.o s.u Z.B D.h U.a f hrsg geb gest Jh zzgl",
    "fr": "M MM Dr Pr St Ste chap éq fig tab art p pp vol no n cf env ex p.ex c.-à-d av apr h Mgr Voir",
    "es": "Sr Sra Srta Sres D Dr Dra Prof Profa cap caps pág págs núm núms fig tab vol art p pp p.ej aprox EE Ud Uds Vd a.C d.C Véase",
    "ru": "см См рис Рис табл Табл стр гл Гл ср Ср т.е т.к т.н тыс млн млрд руб им ул проф акад др напр п",
    "ar": "د أ م ص ج هـ",
    "hi": "डॉ श्री प्रो पृ सं",
}
#: Abbreviations that may end a sentence; a capital letter after them starts a new one.
ENDING = {
    "en": "etc a.m p.m Inc Ltd Co Corp Jr Sr U.K U.S U.S.A B.C A.D Ph.D",
    "de": "usw etc u.s.w Chr v.Chr n.Chr a.M GmbH ff",
    "fr": "etc J.-C av.J.-C apr.J.-C",
    "es": "etc UU EE.UU p.m a.m J.C",
    "ru": "т.д т.п и.т.д г гг в вв н.э до.н.э",
}
#: Words that start sentences, by language: articles, pronouns, question words, prepositions and conjunctions. They part a sentence end from an
#: initial or an ordinal.
STARTERS = {
    "en": "The A An This That These Those It He She We They You There Here Who What Which Where When Why How Is Are Was Were Do Does Did In On At By For From To Of With Under Over Near After Before Between During Since Until If As While Although Because Unless Whoever And But Or So Then Both Every Each No Not All Some Many Most Much",
    "de": "Der Die Das Den Dem Ein Eine Einer Eines Dieser Diese Dieses Es Er Sie Wir Ich Man Wer Was Wo Wann Warum Wie Welche Ist Sind War In Im Am An Auf Aus Bei Mit Nach Von Vor Zu Zum Zur Zwischen Für Durch Über Unter Seit Während Wenn Als Weil Da Ob Und Aber Oder Doch Auch So Dann Hier Dort Jeder Jede Alle Viele Kein Keine",
    "fr": "Le La Les L’ Un Une Des Ce Cette Ces Il Elle Ils Elles On Nous Vous Je Qui Que Quoi Où Quand Pourquoi Comment Quel Quelle Quels Est En Dans Sur Sous Par Pour Avec Sans Entre Vers Chez Avant Après Depuis Pendant D’après Selon Si Comme Lorsque Mais Et Ou Donc Alors Ici Chaque Tous Toutes",
    "es": "El La Los Las Lo Un Una Unos Unas Este Esta Estos Estas Ese Esa Eso Esto Él Ella Ellos Se Quién Qué Dónde Cuándo Cómo Es Son En De Con Por Para Sin Sobre Entre Desde Hasta Según Tras Ante Antes Después Durante Si Cuando Como Aunque Porque Y Pero O Así Aquí Cada Todo Todos No",
    "ru": "В На Из С К О Об От До По При Про За Над Под Между Для Без После Перед Через Это Этот Эта Эти Тот Он Она Оно Они Мы Вы Я Кто Что Где Когда Почему Как Какой И А Но Или Если Чтобы Хотя Так Затем Здесь Там Каждый Все Не",
}
#: German words after an ordinal number.
ORDINAL_NOUNS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert Auflage Kapitel Klasse Band Teil Absatz Mal Grad Ordnung Stufe"
#: English words after an hour that carry on the sentence.
AFTER_HOURS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December GMT UTC EST EDT CST CDT MST MDT PST PDT BST CET CEST Eastern Central Mountain Pacific"
#: Chinese and Japanese words that carry on a sentence after a quotation.
CARRY_ON = {"zh": r"[^。！？“”]{0,8}?(?:说|问|答|道|喊|想|写|然后|并|便|就|这|，|、|的)", "ja": r"(?:と|って|、|，|の|は|が|を|に|で|も|など|という)"}

_OPEN = "“„«‹「『（([{¿¡‘\"【《〈"
_CLOSE = "”“»›」』）)\\]}’'\"】》〉"
_CF = r"[\p{Cf}]*"
_CANDIDATE = regex.compile(
    rf"(?P<end>(?:[.!?…؟۔।॥]{_CF})+(?:[{_CLOSE}]{_CF})*(?:[    ]»{_CF})?)(?P<gap>\s+)(?=\S)"
    rf"|(?P<wide>(?:[。！？｡．]{_CF})+(?:[”」』）)’】》]{_CF})*)(?P<room>\s*)(?=\S)"
)
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{M}\d.!?”\"’)ๆฯ])\s+(?=[\p{Thai}“\"‘(])|(?<=[\p{Thai}\p{M}][!?.])\s+(?=\S)")
_HEAD = regex.compile(
    r"\s*(?:[•▪◦‣·*§>#–—-]+\s+|\(?\p{N}{1,3}(?:\.\p{N}+)*[.)]\s+|\(?\p{L}[.)]\s+(?=\S)|\(?[IVXLCivxlc]{1,5}[.)]\s+|\p{Lu}\p{L}{0,12}\s\p{N}+(?:\.\p{N}+)*[.:]\s+)"
)
_ONE_UNIT = regex.compile(
    r"\s*(?:Figure|Fig\.|Table|Tab\.|Abbildung|Abb\.|Tabelle|Figura|Tabla|Tableau|Рис\.|Рисунок|Таблица|图|图表|図|表)\s?\p{N}+(?:[.–-]\p{N}+)*(?:\s{2,}|\s*[:：]\s)"
    r"|[^\n]*[=≈<>]\s[^\n]*\(\p{N}+\.\p{N}+\)\s*$"
)
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]"}


@dataclass(frozen=True)
class Rule:
    """Whether there is a break between texts that match before (at its end) and after (at its start)."""

    breaks: bool
    before: regex.Pattern
    after: regex.Pattern


def _rule(breaks: bool, before: str, after: str = "") -> Rule:
    return Rule(breaks, regex.compile(rf"(?:{before})$"), regex.compile(after))


def _words(table: dict[str, str], langs: list[str], spaced: bool = True) -> str:
    """Alternation of the table's words; points within them may have white space behind."""
    every = sorted({canonical(w) for lang in langs for w in table.get(lang, "").split()}, key=lambda w: (-len(w), w))
    return "|".join(regex.escape(w).replace(r"\.", r"\.\s?") if spaced else regex.escape(w) for w in every)


@lru_cache(maxsize=32)
def rules(lang: str) -> list[Rule]:
    """The cascade of one language: its own tables first, then what all languages share."""
    own = [lang] if lang in JOINING else ["en"]
    latin = [x for x in ("en", "de", "fr", "es")] if own[0] in ("en", "de", "fr", "es") else ["ru", "en"] if lang == "ru" else [*own, "en"]
    starters = rf"(?:{_words(STARTERS, latin, False)})(?![\p{{L}}\p{{M}}.])"
    close = rf"[{_CLOSE}]*"
    word = r"(?<![\p{L}\p{M}\p{N}])"
    low = r"[\p{Ll}]"
    table = [
        _rule(False, rf"[.!?…؟।]{close}", r"[,;:)\]»”—–-]"),
        _rule(False, r"[.!?…؟।][”»’“\"]+", r"\p{Ll}|(?:ثم|و|और|तो|तब)(?!\p{L})"),
        # small letters that start sentences, and abbreviations that do
        _rule(True, rf"(?<!\.\.)[.!?]{close}", r"i\.\s?e\.|e\.\s?g\.|\p{Ll}{1,3}\p{Lu}"),
    ]
    if lang == "de":
        table += [
            _rule(False, r"(?<![\p{L}\p{N}.,])\p{N}{1,2}\.", rf"(?:{'|'.join(ORDINAL_NOUNS.split())})(?!\p{{L}})"),
            _rule(True, r"\p{N}\.", starters),
            _rule(False, r"(?<![\p{L}\p{N}.,])\p{N}{1,2}\.", r"\p{Lu}"),
        ]
    if own[0] == "en":  # hours and "etc." end a sentence before any capital but that of a day, a month or a time zone
        table += [
            _rule(False, rf"{word}[ap]\.\s?m\.", rf"(?:{'|'.join(AFTER_HOURS.split())})(?![\p{{L}}\p{{N}}])"),
            _rule(True, rf"{word}(?:[ap]\.\s?m|etc)\.{close}", r"[\p{Ps}\p{Pi}\"]*\p{Lu}"),
        ]
    if lang == "fr":
        table.append(_rule(False, rf"{word}M{{1,2}}\.", r"\p{Lu}"))
    if lang == "ru":
        table.append(_rule(False, rf"{word}г\.", r"[\p{Ll}\p{N}]"))
    table += [
        _rule(False, rf"{word}(?:{_words(JOINING, own)})\.\s?", ""),
        _rule(False, rf"{word}(?:{_words(ENDING, [*own, 'en'])})\.{close}", rf"{low}|\p{{N}}"),
        _rule(True, rf"{word}(?:{_words(ENDING, [*own, 'en'])})\.{close}", starters if own[0] == "en" else r"[^\p{Ll}]"),
        _rule(False, rf"{word}(?:U\.\s?[KS]|Ph\.\s?D|Inc|Jr|Sr)\.", r"\p{Lu}(?!\p{Lu})\p{Ll}*") if own[0] == "en" else _rule(False, r"(?!)"),
        # a unit after a number ends a sentence, an initial or a letter of an abbreviation does not
        _rule(True, r"\p{N}\s?[\p{L}°/·]{1,7}[²³]?\.", r"[^\p{Ll}]"),
        _rule(False, r"(?<![\p{L}\p{M}\p{N}/°])\p{Ll}\.", r"\p{L}"),
        _rule(True, r"\p{N}\s?[\p{Lu}Å]\.", r"[^\p{Ll}]"),
        _rule(True, rf"{word}\p{{Lu}}\.", starters),
        _rule(False, rf"(?<![\p{{L}}\p{{M}}\p{{N}}°/])\p{{Lu}}\.", r"\p{L}"),
        _rule(False, rf"(?:\.\.+|…){close}\s*", rf"{low}"),
        _rule(True, rf"(?:\.\.+|…){close}", ""),
        _rule(False, rf"\p{{N}}\.{close}", low),
        _rule(False, rf"[!?؟]{close}", low),
        # a small letter after a whole word: misread capitals and lower-case openings
        _rule(True, r"\p{Ll}{4,}\)?\.", low) if own[0] in ("en", "de", "fr", "es", "ru") else _rule(False, r"(?!)"),
        _rule(False, rf"\.{close}", low),
        _rule(True, r"", ""),
    ]
    return table


@lru_cache(maxsize=8)
def _wide_rules(lang: str) -> list[Rule]:
    carry = CARRY_ON.get(lang, CARRY_ON["zh"])
    return [
        _rule(False, r"[。！？][”」』’]+", carry),
        _rule(False, r"[。！？][）)]", r"[，、；：。]"),
        _rule(False, r"[。！？]", r"[，、；：。！？”」』）]"),
        _rule(True, r"", ""),
    ]


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Insides of quotations and brackets; a pair may cross line feeds but no blank line."""
    spans, stack = [], []
    for m in regex.finditer(r"[“”„«»‹›「」『』（）()\[\]\"]|\n[^\S\n]*\n", text):
        ch = m.group()
        if ch[0] == "\n":
            stack.clear()
        elif ch == '"':
            if stack and stack[-1][1] == '"':
                spans.append((stack.pop()[0], m.start()))
            else:
                stack.append((m.end(), '"'))
        elif stack and any(ch in _PAIRS.get(o, "") for _, o in stack):
            while stack:
                start, opener = stack.pop()
                if ch in _PAIRS.get(opener, ""):
                    spans.append((start, m.start()))
                    break
        elif ch in _PAIRS:
            stack.append((m.end(), ch))
    return sorted(spans)


_STOP = {
    "en": {"the", "of", "and", "to", "in", "is", "was", "that", "for", "at"},
    "de": {"der", "die", "das", "und", "ist", "den", "von", "im", "zu", "wird"},
    "fr": {"le", "la", "les", "et", "des", "est", "une", "du", "pour", "de"},
    "es": {"el", "la", "los", "y", "que", "en", "una", "con", "del", "por"},
}


def language_of(text: str, hint: str | None = None) -> str:
    """Language whose tables fit: by script, and by frequent words where several languages share one."""
    counts = {
        "ja": len(regex.findall(r"[\p{Hiragana}\p{Katakana}]", text)) * 2,
        "zh": len(regex.findall(r"\p{Han}", text)),
        "th": len(regex.findall(r"\p{Thai}", text)),
        "hi": len(regex.findall(r"\p{Devanagari}", text)),
        "ar": len(regex.findall(r"\p{Arabic}", text)),
        "ru": len(regex.findall(r"\p{Cyrillic}", text)),
        "latin": len(regex.findall(r"\p{Latin}", text)),
    }
    if counts["ja"] * 3 > counts["zh"] and counts["ja"]:
        counts["ja"] += counts["zh"]
    best = max(counts, key=lambda k: counts[k])
    hint = (hint or "").strip().lower()[:2]
    if best != "latin":
        return hint if best == "zh" and hint == "ja" else best
    if hint in _STOP:
        return hint
    words = regex.findall(r"\p{L}+", canonical(text).casefold())
    votes = {lang: sum(w in stop for w in words) for lang, stop in _STOP.items()}
    return max(votes, key=lambda k: votes[k])


#: Characters before and after a candidate that the longest rule can span, apart from runs of closing marks and invisible characters.
BEFORE, AFTER = 60, 40
_RUN = "".join(c for c in _CLOSE if c != "\\") + ".…!?؟。！？ \u00a0\u2009\u202f"


def _before(text: str) -> str:
    """The end of a text that rules look at: BEFORE characters and the closing marks behind them."""
    kept = len(text.rstrip(_RUN))
    return text[max(0, kept - BEFORE) :]


def _after(line: str, at: int) -> str:
    """The text from a place on that rules look at: AFTER characters in canonical form."""
    size = AFTER
    while True:
        look = canonical(regex.sub(r"\p{Cf}", "", line[at : at + size]))
        if len(look) >= AFTER or at + size >= len(line):
            return look[:AFTER]
        size *= 2


def _breaks(table: list[Rule], before: str, after: str) -> bool:
    for rule in table:
        if rule.after.match(after) and rule.before.search(before):
            return rule.breaks
    return False


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Start and end of every sentence unit of a text, in order.

    lang is a hint that the text's script can overrule; without it the language is told from the text. Line feeds end
    units. Null, empty and blank texts have none.
    """
    if not text or text.isspace():
        return []
    lang = language_of(text, lang)
    table, wide = rules(lang), _wide_rules(lang)
    inside = quoted_spans(text)
    starts = [a for a, _ in inside]
    reach = list(accumulate((b for _, b in inside), max))  # how far the spans up to here go
    out, at = [], 0
    for line in text.split("\n"):
        start, stop = at, at + len(line)
        at = stop + 1
        if line.isspace() or not line:
            continue
        cuts: list[int] = []
        if not _ONE_UNIT.match(line):
            head = m.end() if (m := _HEAD.match(line)) else 0
            found = [(m.end("end") if m.group("end") else m.end("wide"), m.end(), bool(m.group("end"))) for m in _CANDIDATE.finditer(line)]
            if lang == "th" and regex.search(r"\p{Thai}", line):
                found = sorted({*((e, n, None) for e, n, _ in found), *((m.start(), m.end(), None) for m in _THAI_GAP.finditer(line))}, key=lambda x: x[:2])
            unit = 0
            for end, follow, spaced in found:
                if follow <= head or end <= unit:
                    continue
                place = start + end
                spans_before = bisect_left(starts, place)
                if spans_before and reach[spans_before - 1] >= place:
                    continue
                if spaced is None:
                    cuts.append(follow)
                    unit = follow
                    continue
                before = _before(regex.sub(r"\p{Cf}", "", line[unit:end]) if not spaced else line[unit:end])
                if spaced:
                    before = regex.sub(r"\s+(?=[»”])", "", canonical(before))
                ok = _breaks(table if spaced else wide, before, _after(line, follow))
                # in scripts without capitals a quotation within a sentence leaves it open
                if ok and lang in ("ar", "hi") and before[-1:] in "”»" and regex.search(r"\S.*[“«]", line[unit:end]):
                    ok = False
                if ok:
                    cuts.append(follow)
                    unit = follow
        for a, b in zip([0, *cuts], [*cuts, len(line)]):
            piece = line[a:b]
            lead = len(piece) - len(piece.lstrip())
            size = len(piece.strip())
            if size:
                out.append((start + a + lead, start + a + lead + size))
    return out


def sentences(pages: DataFrame, id_col: str = "page_id", text_col: str = "text", lang_col: str | None = None, with_text: bool = False) -> DataFrame:
    """id, start_char and end_char of every sentence unit, and its text if wanted.

    Null, empty and blank texts have no units; a null language is told from the text; repeated rows give their units again; an
    empty table gives an empty one. Other columns are not read.
    """

    def units(text: str | None, lang: str | None = None) -> list[tuple]:
        return [(a, b, *([text[a:b]] if with_text else [])) for a, b in sentence_spans(text, lang)]

    outputs = [("start_char", T.IntegerType()), ("end_char", T.IntegerType())] + [("sentence", T.StringType())] * with_text
    rows = pages.where(F.col(text_col).isNotNull())
    return emit_rows(rows, [id_col], [text_col] + [lang_col] * (lang_col is not None), outputs, units)

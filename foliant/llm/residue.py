"""Template residue, filler and error-page text in the fields of note blocks.

Values are aligned first: with digits levelled and the closing citation left out, all values of one template are one look, and
everything below is judged once for each look. Slots are induced by leaving words out: a stretch between signs of a template language
that is the same but for one word is a slot when several words stand in it, and words that stand in several slots are variable
names. A plain-text frame (the words beside a name) is a template's slot when nearly all that ever stands in it are such names. A
field is flagged when a slot of it still holds a name. Defaults, blanks, filler and whole error pages are repeated looks with the
traits of such messages; those that occur once are known by their wording alone and say so in their reason.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.arrow import emit_rows
from foliant.session import broadcast_if_small, ensure_checkpoint_dir

#: A context is text about marks when it holds one and the same mark in at least this many different values; copies count once.
CONSTANT_FIELDS = 3
#: Different words that must stand in a slot, and slots in which a variable name must stand.
SLOT_NAMES, NAME_SLOTS = 3, 2
#: Share of a frame's different words that must be variable names, for frames of plain words and between signs.
PLAIN_PURITY, SIGN_PURITY = 0.8, 0.5
#: Fields that must hold a template for it to be a repeated page or default.
REPEATED = 3
#: Variable names up to which they are held as one array; more of them are joined by shuffle.
HELD_NAMES = 10_000

_NAME = r"(?P<name>[A-Za-z][\w.]{0,30})"
#: Ways to write a variable, as (opening, closing); the name stands between.
MARKS = [
    (r"(?<![\\^_}])\{\{\s*", r"(?:\s*\|[^{}]*)?\s*\}\}"),
    (r"\{%-?\s*(?:if|for|block|include|set)\s+", r"\b[^%]*%\}(?:.*?\{%-?\s*end\w+\s*-?%\})?"),
    (r"\$\{\s*", r"\s*\}"),
    (r"<%=?\s*", r"\s*%>"),
    (r"%\(", r"\)[sd]"),
    (r"(?<![\w%])%(?=[A-Z_]{2,}%)", r"%"),
    (r"(?<![\w$])\$(?=[A-Z_]{2,}\$)", r"\$(?:\s*-\s*replace me)?"),
    (r"##", r"##"),
    (r"@@", r"@@"),
    (r"(?<!\w)__(?=[A-Z])", r"__(?!\w)"),
    (r"<<\s*(?:[A-Z]+:\s*)?(?:the\s+)?", r"(?:\s+of\s+the\s+\w+)?\s*>>"),
    (r"<(?=[A-Z][A-Z_]+>)", r">"),
    (r"\[(?:insert|enter|add|your|hier|à compléter\s*:|insertar|вставьте|hier bitte)\s+(?:the\s+|your\s+)?", r"(?:\s+(?:here|einsetzen|einfügen|aquí|ici))?\s*\]"),
    (r"\[(?=[A-Z][A-Z_]+\])", r"\]"),
    (r"\bXXX\s+", r"\s+XXX\b"),
    (r"\(", r"\s+(?:to follow|to come|goes here|folgt|à venir)\)"),
    (r"<!--\s*", r"\s+(?:goes here|here|to follow)?\s*-->"),
    (r"\b(?:TODO|FIXME|TBD)\s*:\s*(?:write|add|fill in|insert)\s+(?:the\s+)?", r"\b"),
    (r"\b(?:TBD|TBC|TBA)\b\s*", r"{0}"),
]
_MARK = [regex.compile(a + (_NAME if b != "{0}" else "") + (b if b != "{0}" else ""), regex.I if a.startswith(r"\[(?:") else 0) for a, b in MARKS]
#: Marks that are defaults or blanks by themselves.
BLANKS = regex.compile(
    r"(?<![\\\w^_}])\{\d\}(?:[^{}\\]{1,20}\{\d\})+|<mistake>|<what the book says>|\[p\.\s*N\s*:|\[object Object\]|…\s*fill in later\s*…|\bfill (?:this )?in later\b"
    r"|#(?:REF|NAME|VALUE|DIV/0|N/A|NULL|NUM)[!?]?(?!\w)|^(?:NaN|undefined|null|None|nil|N/A|n/a|TBD|TBA|TBC|TODO|FIXME|XXX+|\?{3,}|-{3,}|\.{3,}|…|(?:x|X){4,}|asdf\w*|qwerty\w*|foo(?: ?bar)?|test(?: test)*)[.!]?$"
)
#: The words of the usual Latin filler text, cut to five letters.
FILLER_WORDS = set(
    "lorem ipsum dolor sit amet conse adipi elit sed do eiusm tempo incid ut labor labo dolore magna aliqu aliqua enim ad minim venia quis nostr exerc exerci "
    "ullam labor nisi ex ea commo conseq duis aute irure in repre volup velit esse cillu fugia nulla paria excep sint occae cupid non proid sunt "
    "culpa qui offic deser molli anim id est labum quisnos".split()
)
#: Filler phrases.
FILLER = regex.compile(
    r"\b(?:blah[ ,.]+){2,}|\b(?:sample|dummy|filler|placeholder|example) (?:text|content|copy)\b(?! (?:is|are|was|shows|helps|lets))[^.]*(?:[.:]|\bfor\b|$)|\btext goes here\b|\bclick to (?:add|edit) text\b"
    r"|\b(?:beispieltext|platzhaltertext|blindtext)\b(?:\s+(?:beispieltext|platzhaltertext|blindtext)\b)*$|\btexte? (?:d’|d')?exemple\b|\btexto de (?:ejemplo|relleno)\b|(?<!\w)[xX]{5,}(?!\w)|\breplace this\b[^.]*\btext\b",
    regex.I,
)
#: Wording of error pages and of notices that scripts are required, by kind of message.
MESSAGES = regex.compile(
    "|".join(
        [
            r"^\W*(?:HTTP[ /.\d]*)?\d{3}\W{0,3}\s*(?:Not Found|Bad Gateway|Service (?:Temporarily )?Unavailable|Forbidden|Unauthorized|Internal Server Error|Gateway Time-?out|Too Many Requests|Bad Request|Gone)\b",
            r"^\W*(?:Internal Server Error|Bad Gateway|Service Unavailable|Gateway Time-?out)\b",
            r"^\W*(?:Error|HTTP|Erreur|Fehler|Ошибка|Errore|エラー|错误|خطأ|त्रुटि|ข้อผิดพลาด)\s*:?\s*\d{3}\b",
            r"\b(?:Fehler|error|Error|code)\W{0,2}\s*\d{3}\)?$",
            r"^\W*(?:Page|File) not found\b|^\W*Seite nicht gefunden\b|^\W*Page (?:non trouvée|introuvable)\b|^\W*Página no encontrada\b|^\W*Страница не найдена\b|页面(?:未找到|不存在)|ページが見つかりません",
            r"\b(?:requested|the) \w+ could not be (?:located|found) on this server\b|\bon this server\.?$",
            r"^\W*(?:Access denied|Permission denied|Forbidden)\b[.:!]",
            r"le service est momentanément indisponible|Сервис временно недоступен|El servicio no está disponible|Der Dienst ist (?:derzeit|momentan) nicht verfügbar|服务(?:暂时)?不可用",
            r"^\W*(?:Your|The) session has expired\b|\bPlease sign in again\b|\bToo many requests; rate limit\b|\brate limit (?:reached|exceeded)[,.]",
            r"\bconnect E[A-Z]{5,}\b|^\W*Traceback \(most recent call last\)|\b(?:java|javax|org|com)\.[\w.]+(?:Exception|Error)\b.*\bat\b|^\W*(?:Fatal error|Uncaught \w*Error|Unhandled exception|Segmentation fault)\b",
            r"^\s*<(?:!doctype|html|head|body)\b|<noscript\b|^\s*\{\s*\"(?:error|errors|message|status)\"\s*:",
            r"\b(?:Please |You need to |You must )?(?:enable|activate|turn on|switch on|allow) (?:JavaScript|scripts|cookies)\b(?= (?:to|in|and|for|then)\b|[.,!]|$)",
            r"\bJavaScript (?:is|must be|has to be) (?:disabled|required|enabled|turned off)\b|\b(?:requires|needs) JavaScript\b(?! (?:code|engine|knowledge))|\bScripts are (?:needed|required)\b",
            r"\b(?:Bitte )?aktivieren Sie (?:bitte )?JavaScript|\b(?:Veuillez )?activer JavaScript|\b[Aa]ctive JavaScript en (?:su|tu)\b|\b(?:Habilite|Active) JavaScript\b",
            r"включите JavaScript|(?:启用|开启|打开)\s*JavaScript|JavaScript\s*を有効|JavaScript\s*सक्षम|(?:تفعيل|فعّل|تمكين)\s*JavaScript|เปิด(?:ใช้งาน)?\s*JavaScript",
            r"^\W*(?:Oops|Whoops|Uh-oh)\b|^\W*(?:Sorry, )?[Ss]omething went wrong\b",
            r"^\W*Checking your browser before\b|\bYour browser is (?:not supported|out of date)\b|^\W*Security check: |\bthis step runs a script\b|^\W*Loading\W+if nothing happens\b",
        ]
    )
)
_WORD = regex.compile(r"[^\W\d_]+")
#: Signs of template languages: every mark that is neither punctuation of sentences and quotations nor of formulas.
_SIGN = r"[\p{P}\p{S}--[.,;:!?'\"“”‘’„«»‹›「」『』《》()（）。，、；：！？…\-–—/\\+*=^|&°×·−]]"
_HAS_SIGN = regex.compile(_SIGN, regex.V1)
#: A stretch between signs with its words: slots may be any of them.
_STRETCH = regex.compile(rf"(?={_SIGN})(?P<all>{_SIGN}+\(?\s?(?:(?!{_SIGN})[^\n]){{1,60}}?(?:\)?{_SIGN}+|\)))", regex.V1)
_NAME_WORD = regex.compile(r"(?<![A-Za-z])[A-Za-z]{2,30}(?![A-Za-z])")
_MARK_HINT = regex.compile(r"XXX|T[OB][DCA]|FIXME|to (?:follow|come)|goes here|folgt|à venir|replace me", regex.I)
_TOKENS = regex.compile(r"[A-Za-z]+|[^\W\d_]+|\d+|[^\w\s]|_")


def filler_share(value: str) -> float:
    """Share of the Latin filler vocabulary among the words of a value."""
    words = [w.casefold() for w in _WORD.findall(value)]
    return sum(w in FILLER_WORDS or w[:5] in FILLER_WORDS and len(w) > 4 for w in words) / len(words) if len(words) >= 3 else 0.0


def one_word(look: str) -> int:
    """How often a look says its only word; 0 if it has several."""
    words = _WORD.findall(look.casefold())
    return len(words) if len(words) > 1 and len(words[0]) > 1 and len(set(words)) == 1 else 0


def _around(before: str, after: str) -> str:
    return " ".join(before.split()[-3:]) + " § " + " ".join(after.split()[:3])


def _at_edge(before: str, after: str) -> bool:
    return not before.strip(" \"'“„«([") or not after.strip(" .!?;:\"'”“»)]")


def signs(look: str | None) -> list[tuple[str, str | None, str, str | None, bool]]:
    """(kind, frame, name, around, at the edge) of everything in a look that may be residue.

    kind is message, filler, repeat (one word twice) or blank for whole messages and defaults, mark for known ways to write a variable, sign for
    every word of a stretch between signs, whose frame is the stretch without that word. around are the words beside the mark or
    stretch; those at the start or end of the look are at the edge.
    """
    if not look:
        return []
    out: list[tuple] = []
    if MESSAGES.search(look):
        out.append(("message", None, "", None, True))
    if (again := one_word(look)) > 1:
        out.append(("filler" if again > 2 else "repeat", None, "", None, True))
    elif filler_share(look) >= 0.6 or FILLER.search(look):
        out.append(("filler", None, "", None, True))
    if BLANKS.search(look):
        out.append(("blank", None, "", None, True))
    signed = _HAS_SIGN.search(look)
    if signed or _MARK_HINT.search(look):
        for way, pattern in enumerate(_MARK):
            for m in pattern.finditer(look):
                name = (m.groupdict().get("name") or "").casefold()
                before, after = look[: m.start()], look[m.end() :]
                out.append(("mark", str(way), name, f"{way}: {_around(before, after)}", _at_edge(before, after)))
    if signed:
        for m in _STRETCH.finditer(look, overlapped=True):
            stretch = m.group("all")
            before, after = look[: m.start()], look[m.end() :]
            if before[-1:] and _HAS_SIGN.match(before[-1]):
                continue  # the stretch began a sign earlier
            around, edge = _around(before, after), _at_edge(before, after)
            for w in _NAME_WORD.finditer(stretch):
                out.append(("sign", stretch[: w.start()] + "§" + stretch[w.end() :], w.group().casefold(), around, edge))
    return out


def plain_frames(look: str, names: set[str] | None = None, frames: set[str] | None = None) -> list[tuple[str, str]]:
    """(frame, word) of the Latin words of a look: the three tokens before the word, the three behind it, and one on either side.

    With names, frames of those words only; with frames, those frames only.
    """
    tokens = _TOKENS.findall(look)
    ends = ["^", *tokens, "$"]
    out = []
    for i, token in enumerate(tokens, 1):
        if not ("a" <= token[0] <= "z" or "A" <= token[0] <= "Z") or len(token) < 2:
            continue
        word = token.lower()
        if names is not None and word not in names:
            continue
        before, after = ends[max(0, i - 3) : i], ends[i + 1 : i + 4]
        made = [f"{ends[i - 1]} § {ends[i + 1]}"] if "^" != ends[i - 1] and "$" != ends[i + 1] else []
        made += [" ".join(before) + " §"] if len(before) == 3 else []
        made += ["§ " + " ".join(after)] if len(after) == 3 else []
        out += [(f, word) for f in made if (frames is None or f in frames) and _WORD.search(f)]
    return out


def note_fields(blocks: DataFrame) -> DataFrame:
    """block_no, field_no, key and value of every field; blocks without fields give none."""
    each = blocks.select("block_no", F.posexplode("fields").alias("field_no", "f"))
    return each.select("block_no", "field_no", F.col("f.key").alias("key"), F.col("f.value").alias("value"))


def look_of(value: Column) -> Column:
    """What the values of one template have in common: their bodies with every digit a zero."""
    return F.translate(_body(value), "123456789", "000000000")


def _body(value: Column) -> Column:
    """A value without outer space and closing citation."""
    bare = F.btrim(value, F.lit(" \t\r\n"))
    return F.when(F.contains(bare, F.lit("[p.")), F.regexp_replace(bare, r"\s*\[p\.\s*[0-9ivxlc][^\]]*\]\s*$", "")).otherwise(bare)


def _slots(filled: DataFrame, names: DataFrame, purity: float) -> DataFrame:
    """frame of every slot among (frame, name): several variable names stand in it and little else."""
    known = broadcast_if_small(names.withColumn("known", F.lit(1)))
    counted = filled.select("frame", "name").distinct().join(known, "name", "left").groupBy("frame").agg(F.count("*").alias("n"), F.count("known").alias("k"))
    return counted.where((F.col("k") >= SLOT_NAMES) & (F.col("k") >= purity * F.col("n"))).select("frame")


def _plain_slots(looks: DataFrame, names: DataFrame) -> DataFrame:
    """look of every look in which a variable name stands in a slot of plain words."""
    text = T.StringType()
    held = [r[0] for r in names.limit(HELD_NAMES + 1).collect()]  # words of template languages, not of texts
    few = len(held) <= HELD_NAMES
    words = F.split(F.lower("look"), "[^a-z]+")
    if few:
        asked = looks.where(F.arrays_overlap(words, F.array(*map(F.lit, held or [""]))))
    else:
        asked = looks.withColumn("name", F.explode(F.array_distinct(words))).join(names, "name", "left_semi").select("look").distinct()
    wanted = set(held) if few else None
    of_names = emit_rows(asked.select("look"), ["look"], ["look"], [("frame", text), ("name", text)], lambda x: plain_frames(x, names=wanted)).distinct().checkpoint()
    if not few:
        of_names = of_names.join(names, "name", "left_semi")
    likely = of_names.groupBy("frame").agg(F.count_distinct("name").alias("k")).where(F.col("k") >= SLOT_NAMES).select("frame")
    frames = [r[0] for r in likely.limit(HELD_NAMES + 1).collect()]
    chosen = set(frames) if len(frames) <= HELD_NAMES else None
    every = emit_rows(looks.select("look"), [], ["look"], [("frame", text), ("name", text)], lambda x: plain_frames(x, frames=chosen)).distinct()
    if chosen is None:
        every = every.join(likely, "frame", "left_semi")
    slots = _slots(every, names, PLAIN_PURITY).checkpoint()  # few rows; counting them must not read all looks again
    return of_names.join(broadcast_if_small(slots), "frame", "left_semi").select("look").distinct()


def find_residue(fields: DataFrame) -> DataFrame:
    """block_no, field_no and reason of the fields whose value is or holds residue, one row for each field number.

    Reasons by alignment: slot (a slot between signs holds a variable name), template (one of plain words does), page (a repeated error page or notice),
    default (a repeated default, blank or filler). Reasons by wording alone: mark, message, filler, blank. The first of these that holds is given.
    fields: block_no, field_no, value. Null, empty and blank values and values that start with UNSURE are never residue. Rows with the
    same numbers count once; an empty table gives an empty one; other columns are not read.
    """
    ensure_checkpoint_dir(fields.sparkSession)
    text = T.StringType()
    values = fields.where("value IS NOT NULL AND NOT startswith(upper(ltrim(value)), 'UNSURE')")
    # where the citation quotes a sign, the book itself has it
    quoted = F.contains("value", F.lit("[p.")) & F.col("value").rlike(r"\[p\.\s*[0-9ivxlc][^\]:]*:[^\]]*[{}$%<>@#_][^\]]*\]\s*$")
    values = values.select("block_no", "field_no", look_of(F.col("value")).alias("look"), quoted.alias("quoted"), F.xxhash64(_body(F.col("value"))).alias("body"))
    looks = values.where("look != ''").groupBy("look").agg(F.count("*").alias("n"), F.max("quoted").alias("quoted")).checkpoint()
    outputs = [("kind", text), ("frame", text), ("name", text), ("around", text), ("edge", T.BooleanType())]
    seen = emit_rows(looks, ["look", "n", "quoted"], ["look"], outputs, signs).checkpoint()  # few rows, which the plans below read

    signed = seen.where("kind = 'sign'")
    several = signed.groupBy("frame").agg(F.count_distinct("name").alias("words")).where(F.col("words") >= SLOT_NAMES).select("frame")
    names = signed.join(several, "frame", "left_semi").groupBy("name").agg(F.count_distinct("frame").alias("slots")).where(F.col("slots") >= NAME_SLOTS).select("name").checkpoint()
    held = signed.join(broadcast_if_small(_slots(signed, names, SIGN_PURITY).checkpoint()), "frame", "left_semi").join(broadcast_if_small(names), "name", "left_semi")

    # a context that always holds one and the same mark is text about marks, and so is one whose citation quotes a mark
    marks = seen.where("kind IN ('mark', 'sign') AND around IS NOT NULL")
    inner = broadcast_if_small(marks.where("NOT edge").select("look").distinct())
    bodies = values.join(inner, "look", "left_semi").groupBy("look").agg(F.count_distinct("body").alias("bodies"))
    contexts = marks.where("NOT edge").select("kind", "around", "name", "look").distinct().join(bodies, "look").groupBy("kind", "around")
    contexts = contexts.agg(F.count_distinct("name").alias("names"), F.sum("bodies").alias("bodies"))
    constant = contexts.where((F.col("names") == 1) & (F.col("bodies") >= CONSTANT_FIELDS)).select("kind", "around")
    free = lambda df: df.where("edge").unionByName(df.where("NOT edge AND NOT quoted").join(constant, ["kind", "around"], "left_anti").select(*df.columns))
    by_slot = free(held).select("look", F.lit(1).alias("order"), F.lit("slot").alias("reason"))
    by_mark = free(seen.where("kind = 'mark'")).select("look", F.lit(5).alias("order"), F.lit("mark").alias("reason"))
    by_frame = _plain_slots(looks, names).select("look", F.lit(2).alias("order"), F.lit("template").alias("reason"))

    # whole messages and defaults: addresses, quoted names and numbers vary within one template
    whole = seen.where("kind IN ('message', 'filler', 'repeat', 'blank')").select("look", "n", "kind")
    vary = F.regexp_replace("look", r"[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|(['\"])[^'\"]*\1|/[\p{L}\p{N}/]+", "§")
    whole = whole.withColumn("template", F.regexp_replace(vary, "0+", "0"))
    times = whole.select("template", "look", "n").distinct().groupBy("template").agg(F.sum("n").alias("times"))
    whole = whole.join(times, "template")
    page, again = F.col("kind") == "message", F.col("times") >= REPEATED
    whole = whole.where(again | (F.col("kind") != "repeat"))
    by_whole = whole.select(
        "look",
        F.when(again, F.when(page, 3).otherwise(4)).otherwise(6).alias("order"),
        F.when(again, F.when(page, "page").otherwise("default")).otherwise(F.col("kind")).alias("reason"),
    )
    found = by_slot.unionByName(by_frame).unionByName(by_whole).unionByName(by_mark).groupBy("look").agg(F.min(F.struct("order", "reason"))["reason"].alias("reason"))
    return values.join(broadcast_if_small(found.checkpoint()), "look").groupBy("block_no", "field_no").agg(F.min("reason").alias("reason"))


def without_residue(blocks: DataFrame, residue: DataFrame) -> DataFrame:
    """Fields of the notes that are left when the fields with residue are out."""
    return note_fields(blocks).join(residue.select("block_no", "field_no"), ["block_no", "field_no"], "left_anti")

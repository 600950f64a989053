"""Pages of repeated keywords, link lists and product tags.

One pass reads every text as lines and each line as segments between separators. Link-text ratio, tags, product marks, repeated
segments, separator density and the lack of function words make a line spam. The same pass gives the numbers of the whole text: share of function
words, share of the most frequent pair of words, share of different words, length of segments, and the words behind the first of short
segments. Thresholds on these numbers are calibrated per language: medians and quartiles over all documents of the language. Of the words of
segments, those of pages found so far and of hardly any other page are learned from all documents, per language, and tell lists of terms with such
words from indexes and glossaries.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.arrow import emit_rows
from foliant.session import broadcast_if_small, ensure_checkpoint_dir

#: Frequent words that join others into sentences, by language; for scripts without spaces, endings and particles.
FUNCTION_WORDS = {
    "en": "the a an of to in is are was were be and or that which this these it as by for with from on at has have not than when if so because whereas while does can may must we",
    "de": "der die das des dem den ein eine einer und oder ist sind war wird werden nicht von zu im in am auf mit für als wie dass es sich aus bei wenn um nur",
    "fr": "le la les un une des et ou est sont était que qui ne pas pour par sur avec dans en au aux ce cette il elle se si quand plus à",
    "es": "el la los las un una y o es son que no para por con en al se su como cuando más lo sí ha fue",
    "ru": "и в на не что с по от для как это из к за при или чем во обычно есть был",
    "hi": "में है हैं की का के और से पर को ने नहीं जब तब भी एक",
    "zh": "的 了 是 在 和 有 不 这 就 也 都 与 而 从 到 对 以",
    "ja": "の は が を に で と も た て い",
    "ar": "في من على إلى عن أن مع هذا هذه كل ثم عندما التي الذي",
}
_JOINERS = {w for words in FUNCTION_WORDS.values() for w in words.split()}
_OF_LANGUAGE: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _word in _words.split():
        _OF_LANGUAGE.setdefault(_word, []).append(_lang)

_LINK = regex.compile(r"<a\b[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|www\.)[^\s<>\"')]+|<br\s*/?>", regex.I | regex.S)
_TAG = regex.compile(r"(?<!\S)#[\p{L}\p{N}][\p{L}\p{M}\p{N}_-]*")
_PRODUCT = [regex.compile(x) for x in (r"\bSKU\b|\bArt\.? ?-?Nr\b|\bASIN\b", r"(?<!\d)\d+[.,]\d\d(?!\d)|[$€£¥]\s?\d", r"[★☆⭐]")]
#: Two of the product patterns never match without one of these.
_PRODUCT_SIGNS = ("SKU", "Art", "ASIN", "★", "☆", "⭐")
_SEPARATOR = regex.compile(r"\s+[|»·•>–—/~*\-]+\s+|[|»·•～]|[,;:，；：、،]\s*|[.!?。！？।؟]+(?:\s+|$)|\s{2,}")
_STRONG = regex.compile(r"\s[|»·>/~]\s|[|»·]")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’-]*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_THAI_RUN = regex.compile(r"\p{Thai}[\p{Thai}\p{M}]*")
_UNSPACED = regex.compile(r"[\p{Thai}\p{Han}\p{Hiragana}\p{Katakana}]")


#: Labels of questions and answers.
_LABEL = re.compile(r"(?:^|\s)(?:\d{1,3}|[^\W\d_])[.)](?=\s)", re.M)
#: A word, one character of Chinese or Japanese, or up to four letters of Thai.
_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]|\p{Thai}[\p{Thai}\p{M}]{0,3}|[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}'’-]*")
_ASCII_TOKEN = re.compile(r"[a-z0-9][a-z0-9'-]*")


@dataclass(frozen=True)
class Limits:
    """Thresholds. cjk_word and thai_word are the characters that count as a word; the last group holds relative to a language's own figures.

    A page is stuffed when the share of its top pair of words is over the median by pair_spread quartile ranges and that of different words under
    variety times the median, if fewer than labels of its words are labels of questions. Function words are missing below joiners times the median. A language with fewer than lang_docs pages of at least
    dense_words words takes the figures of all languages. A word of segments is a learned one when at least learned_docs found pages have it and
    learned_ratio times as many as others.
    """

    spam_share: float = 0.5
    link_share: float = 0.7
    tag_share: float = 0.6
    segments: int = 6
    segment_words: float = 4.5
    alpha_share: float = 0.7
    repeated_share: float = 0.4
    top_share: float = 0.25
    cjk_word: float = 2.5
    thai_word: float = 5.0
    bare_density: float = 0.6
    dense_words: int = 30
    pair_spread: float = 2.0
    variety: float = 0.5
    joiners: float = 0.3
    labels: float = 0.08
    tail_share: float = 0.12
    lang_docs: int = 50
    learned_docs: int = 3
    learned_ratio: float = 4.0


def _words_in(segment: str, limits: Limits) -> float:
    """Number of words; scripts without spaces count by characters."""
    if segment.isascii():
        return len(segment.split())
    if not _UNSPACED.search(segment):
        return len(_WORDS.findall(segment))
    cjk = len(_CJK.findall(segment))
    thai = sum(map(len, _THAI_RUN.findall(segment)))
    spaced = _THAI_RUN.sub(" ", _CJK.sub(" ", segment))
    return cjk / limits.cjk_word + thai / limits.thai_word + len(_WORDS.findall(spaced))


def keyword_density(text: str) -> tuple[float, float]:
    """Number of words, and the share of them that the most frequent pair of words, word or run of characters covers.

    Four characters of Chinese and Japanese and ten of Thai stand for such a phrase. Numbers are no words.
    """
    thai_runs = _THAI_RUN.findall(text)
    spaced = _THAI_RUN.sub(" ", text) if thai_runs else text
    words = [w for w in _WORDS.findall(_CJK.sub(" ", spaced).casefold()) if not w.isdecimal()]
    covered = [0.0]
    if words:
        counts = Counter(p for p in zip(words, words[1:]) if p[0] not in _JOINERS or p[1] not in _JOINERS)
        covered += [2 * n for _, n in counts.most_common(1)]
        covered.append(max((n for w, n in Counter(words).items() if w not in _JOINERS and len(w) > 3), default=0))
    total = float(len(words))
    for run, size, per_word in (("".join(_CJK.findall(text)), 4, 2.5), ("".join(thai_runs), 10, 5.0)):
        total += len(run) / per_word
        if len(run) > size:
            covered.append(Counter(run[i : i + size] for i in range(len(run) - size + 1)).most_common(1)[0][1] * size / per_word)
    return total, max(covered) / max(1.0, total)


def _words_of(text: str) -> list[str]:
    """Tokens of a line in small letters."""
    return _ASCII_TOKEN.findall(text.lower()) if text.isascii() else _TOKEN.findall(text.casefold())


def _segments_of(text: str) -> list[str]:
    return [s for s in (x.strip() for x in _SEPARATOR.split(text)) if s]


def _dense(text: str, words: list[str], limits: Limits, spaced: bool = False) -> bool:
    """One keyword phrase over and over."""
    if not spaced and not text.isascii() and _UNSPACED.search(text):
        total, density = keyword_density(text)
        return total >= limits.dense_words // 3 and density >= limits.bare_density
    words = [w for w in words if not w.isdecimal()]
    total = len(words)
    if total < limits.dense_words // 3:
        return False
    counts = Counter(words)
    if 2 * max(counts.values()) < limits.bare_density * total:  # no pair is more frequent than its words
        return False
    pairs = Counter(p for p in zip(words, words[1:]) if p[0] not in _JOINERS or p[1] not in _JOINERS)
    single = max((n for w, n in counts.items() if w not in _JOINERS and len(w) > 3), default=0)
    return max(2 * max(pairs.values(), default=0), single) >= limits.bare_density * total


def _stuffed(text: str, segments: list[str], limits: Limits) -> bool:
    """Short segments, named again and again or strung between separators, where sentences should be."""
    if len(segments) < limits.segments:
        return False
    segments = [s for s in segments if len(s) > 1 or not s.isascii()]  # labels as in Q: and A: are no segments
    named = [s for s in segments if _WORDS.search(s) and not s.replace(" ", "").isdecimal()]
    if len(named) < limits.alpha_share * len(segments) or len(named) < limits.segments:
        return False
    if sum(_words_in(s, limits) for s in named) > limits.segment_words * len(named):
        return False
    bags = [_WORDS.findall(s.casefold()) for s in named]
    repeated = 1 - len({" ".join(sorted(b)) for b in bags}) / len(named)
    words = Counter(w for b in bags for w in b)
    total = max(1, sum(words.values()))
    joiners = sum(n for w, n in words.items() if w in _JOINERS) / total
    if len(_STRONG.findall(text)) >= 0.6 * len(segments) and joiners < 0.25:
        return True
    return repeated >= limits.repeated_share and (joiners < 0.35 or max(words.values()) >= limits.top_share * total)


def line_kind(line: str, limits: Limits = Limits(), words: list[str] | None = None, segments: list[str] | None = None, spaced: bool = False) -> str | None:
    """link, tags, product or keywords for a line of spam, else null. words and segments are those of the line, where they are at hand; spaced tells that its script has spaces."""
    bare = len("".join(line.split()))
    if not bare:
        return None
    if "http" in line or "www." in line or "](" in line or "<" in line:
        links = [m.group() for m in _LINK.finditer(line)]
        if links and sum(len("".join(x.split())) for x in links) >= limits.link_share * bare:
            return "link"
    if "#" in line:
        tags = _TAG.findall(line)
        if len(tags) >= 3 and len(tags) >= limits.tag_share * len(line.split()):
            return "tags"
    if any(x in line for x in _PRODUCT_SIGNS) and sum(bool(p.search(line)) for p in _PRODUCT) >= 2:
        return "product"
    words, segments = _words_of(line) if words is None else words, _segments_of(line) if segments is None else segments
    return "keywords" if _stuffed(line, segments, limits) or _dense(line, words, limits, spaced) else None


def _read(text: str, limits: Limits) -> tuple[float, list[str], list[str]]:
    """Share of visible characters in lines of spam, words and segments of a text that is not blank; each line is taken apart once."""
    spam = total = 0
    rest: list[tuple[str, int, list[str]]] = []
    every_word: list[str] = []
    every_segment: list[str] = []
    spaced = text.isascii() or not _UNSPACED.search(text)
    for line in text.split("\n"):
        bare = len("".join(line.split()))
        if not bare:
            continue
        total += bare
        words, segments = _words_of(line), _segments_of(line)
        every_word += words
        every_segment += segments
        if line_kind(line, limits, words, segments, spaced):
            spam += bare
        elif len(segments) < limits.segments:
            rest.append((line, bare, words))
    if len(rest) >= 3 and spam <= limits.spam_share * total:
        together = ". ".join(line for line, _, _ in rest)
        if _stuffed(together, _segments_of(together), limits) or _dense(together, [w for _, _, words in rest for w in words], limits, spaced):  # one keyword phrase to a line
            spam += sum(bare for _, bare, _ in rest)
    return spam / total, every_word, every_segment


def spam_share(text: str | None, limits: Limits = Limits()) -> float:
    """Share of a text's visible characters in lines of spam; 0 for null, empty and blank texts."""
    return _read(text, limits)[0] if text and not text.isspace() else 0.0


def page_numbers(text: str, limits: Limits = Limits()) -> list[tuple]:
    """(spam_share, language, words, joiners, pair, labels, variety, segment_words, segments, tails) of a text.

    language is told by function words, null without any. pair is the share of words that the most frequent pair of words or word takes, labels that of labels
    as in 1) and a). tails are the words behind the first of different short segments, with the number of segments; kept for pages of short segments only.
    """
    if not text or text.isspace():
        return []
    share, words, segments = _read(text, limits)
    n = max(1, len(words))
    counts = Counter(words)
    joiners, votes = 0, {}
    for w in counts.keys() & _OF_LANGUAGE.keys():
        times = counts[w]
        joiners += times
        for lang in _OF_LANGUAGE[w]:
            votes[lang] = votes.get(lang, 0) + times
    # labels and numbers are no keywords
    no_word = {w for w in counts if w.isdecimal() or len(w) == 1 and w.isascii()}
    if no_word:
        words = [w for w in words if w not in no_word]
    pairs = Counter(zip(words, words[1:]))
    top = 2 * max((times for (a, b), times in pairs.items() if times > 1 and (a not in _JOINERS or b not in _JOINERS)), default=0)
    if not top and any(a not in _JOINERS or b not in _JOINERS for a, b in pairs):
        top = 2
    top = max(top, max((times for w, times in counts.items() if w not in _JOINERS and w not in no_word), default=0))
    each = n / max(1, len(segments))
    tails: Counter = Counter()
    if each < 2 * limits.segment_words and len(segments) >= limits.segments:
        for s in set(segments):
            parts = s.casefold().split()
            if 2 <= len(parts) <= 2 * limits.segment_words:
                tails.update({w for w in parts[1:] if not w.strip("().").isdecimal()})
    lang = max(votes, key=lambda x: (votes[x], x)) if votes else None
    return [(share, lang, sum(counts.values()), joiners / n, top / n, len(_LABEL.findall(text)) / n, len(counts) / n, each, len(segments), list(tails.items()))]


_TAIL = T.StructType([T.StructField("tail", T.StringType()), T.StructField("n", T.IntegerType())])
_NUMBERS = [
    ("spam_share", T.DoubleType()), ("told_lang", T.StringType()), ("words", T.IntegerType()), ("joiners", T.DoubleType()), ("pair", T.DoubleType()), ("labels", T.DoubleType()),
    ("variety", T.DoubleType()), ("segment_words", T.DoubleType()), ("segments", T.IntegerType()), ("tails", T.ArrayType(_TAIL)),
]


def language_limits(numbers: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """lang, docs, and the limits on pair share, variety and function words of every language; the row without lang holds for all others.

    Medians and quartiles are exact: shares are counted in thousandths, so that a language needs at most a thousand counters.
    """
    sized = numbers.where(F.col("words") >= limits.dense_words).select("lang", *[F.round(c, 3).alias(c) for c in ("pair", "variety", "joiners")])
    spread = lambda c, q: F.percentile(c, F.lit(q))
    figures = [
        F.count("*").alias("docs"),
        (spread("pair", 0.5) + limits.pair_spread * (spread("pair", 0.75) - spread("pair", 0.25))).alias("most_pair"),
        (limits.variety * spread("variety", 0.5)).alias("least_variety"),
        (limits.joiners * spread("joiners", 0.5)).alias("least_joiners"),
    ]
    own = sized.where("lang IS NOT NULL").groupBy("lang").agg(*figures).where(F.col("docs") >= limits.lang_docs)
    return own.unionByName(sized.agg(*figures).withColumn("lang", F.lit(None).cast("string")))


def find_spam(documents: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """id, spam_share and reason of the documents most of whose text is spam.

    reason is lines (most characters lie in lines of spam), stuffed (a keyword phrase over and over) or listed (terms with words that only spam ends them with). The texts are read once,
    without a shuffle; what is shuffled are counts by language. lang_col is a hint; without it the language is told from function words.
    Null, empty and blank texts are never spam; repeated rows come out as often as they came in; a null id stays null; an
    empty table gives an empty one. Other columns are not read.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    hint = F.lower(F.substring(F.trim(documents[lang_col]), 1, 2)) if lang_col else F.lit(None).cast("string")
    texts = documents.select(documents[id_col].alias(id_col), hint.alias("__hint"), documents[text_col].alias("__text")).where("__text IS NOT NULL")
    numbers = emit_rows(texts, [id_col, "__hint"], ["__text"], _NUMBERS, lambda text: page_numbers(text, limits))
    known = F.col("__hint").isin(*FUNCTION_WORDS, "th")
    numbers = numbers.withColumn("lang", F.when(known, F.col("__hint")).otherwise(F.col("told_lang"))).drop("__hint", "told_lang").checkpoint()

    bounds = broadcast_if_small(language_limits(numbers, limits).checkpoint())
    pooled = bounds.where("lang IS NULL").select(*[F.col(c).alias(f"all_{c}") for c in ("most_pair", "least_variety", "least_joiners")])
    judged = numbers.join(bounds.where("lang IS NOT NULL").drop("docs"), "lang", "left").crossJoin(F.broadcast(pooled))  # one row
    bound = lambda c: F.coalesce(c, f"all_{c}")
    stuffed = (F.col("words") >= limits.dense_words) & (F.col("pair") > bound("most_pair")) & (F.col("variety") < bound("least_variety")) & (F.col("labels") < limits.labels)
    reason = F.when(F.col("spam_share") > limits.spam_share, "lines").when(stuffed, "stuffed")
    judged = judged.withColumn("reason", reason).withColumn("lang", F.coalesce("lang", F.lit("")))

    # words that stand behind others in the segments of pages found so far and of hardly any other page
    ends = judged.select("lang", F.col("reason").isNotNull().alias("spam"), F.explode("tails.tail").alias("tail"))
    counted = ends.groupBy("lang", "tail").agg(F.count_if("spam").alias("with"), F.count_if(~F.col("spam")).alias("without"))
    learned = counted.where((F.col("with") >= limits.learned_docs) & (F.col("with") >= limits.learned_ratio * F.col("without"))).select("lang", "tail")
    learned = learned.unionByName(learned.select(F.lit("").alias("lang"), "tail")).distinct().checkpoint()  # where the language is not known, those of any
    bare = (F.col("joiners") < bound("least_joiners")) & (F.col("segment_words") < 2 * limits.segment_words) & (F.col("segments") >= limits.segments)
    asked = judged.where("reason IS NULL").where(bare).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    hits = asked.select("__row", "lang", F.explode("tails").alias("t")).select("__row", "lang", "t.tail", "t.n")
    hits = hits.join(broadcast_if_small(learned), ["lang", "tail"], "left_semi").groupBy("__row").agg(F.sum("n").alias("ended"))
    listed = asked.join(hits, "__row").where(F.col("ended") >= limits.tail_share * F.col("segments")).select(id_col, "spam_share", F.lit("listed").alias("reason"))
    return judged.where("reason IS NOT NULL").select(id_col, "spam_share", "reason").unionByName(listed)

"""Texts of scanned pages: running heads and feet, words broken at line ends, misrecognised characters, and their repair.

One pass reads all pages: it counts the words of pages that are not scans (the vocabulary) and takes the lines of scanned pages apart.
Words of scans that the vocabulary lacks are looked up in a trie of the vocabulary that is intersected with a Levenshtein automaton of weighted
edits: letters left out, put in or exchanged, two read as one and one read as two, of which the known confusions of print recognition cost half; all candidates
within the bound are found. Where they are several, or none by known confusions, the words beside decide. Running lines
are told by how often a book's pages repeat them, page numbers by the offset to the page index that most pages of the book agree on.
A page is a scan by its line ends, else, if it is as narrow as print, by its flag or by a running line of a book with scans.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.llm.canonical import canonical
from foliant.session import broadcast_if_small, ensure_checkpoint_dir

#: Times a word must occur on pages that are no scans to be known.
KNOWN_TIMES = 2
#: A known word is a misreading all the same when confusions make it of a word so many times as frequent; doubtful ones only count in long words.
MISREAD_RATIO = 100
#: Words of the vocabulary that one trie holds, and looked-up words that one task takes; a trie is copied once for so many of them, a looked-up word once for each trie.
TRIE_WORDS, LOOKED_UP = 300_000, 1_000_000
#: Values up to which a column is written into a plan instead of joined.
HELD_VALUES = 5_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Cost of all edits of one word, of a known confusion and of any other edit.
MOST_COST, CONFUSION, OTHER_EDIT = 2, 1, 2
MOST_CONFUSIONS = MOST_COST // CONFUSION
#: Letters that a word needs, and times that it must stand beside the same words as what it is taken for, to be corrected by an edit that is no known confusion.
OTHER_LETTERS, OTHER_CONTEXTS = 6, 2
#: Pages of a book that must share a line at their edge for it to be a running one.
SHARED_PAGES = 3
#: Columns that a printed line has at most.
PRINT_WIDTH = 84

#: What print recognition makes of letters, as (printed, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "@"), ("t", "f"), ("f", "t"), ("i", "l"), ("l", "i"), ("o", "0"), ("l", "1"), ("i", "1"), ("c", "("), ("h", "b"), ("g", "q"), ("g", "9"),
    ("s", "5"), ("b", "8"), ("b", "6"), ("é", "6"), ("ä", "a'"), ("ö", "o'"), ("ü", "u'"), ("é", "e'"), ("á", "a'"), ("í", "i'"), ("ó", "o'"), ("ú", "u'"), ("z", "2"), ("n", "ri"), ("u", "ii"), ("ü", "ii"), ("d", "cl"), ("m", "rn"), ("w", "vv"), ("fi", "h"), ("li", "h"), ("rn", "m"), ("cl", "d"), ("h", "li"),
    ("н", "п"), ("п", "н"), ("и", "н"), ("т", "г"), ("г", "т"), ("б", "6"), ("п", "л"), ("л", "п"), ("в", "8"), ("з", "3"), ("ц", "и"), ("ш", "щ"), ("ч", "4"), ("ь", "ъ"), ("t", "l"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"),
]
#: Of these, confusions that also part real words of each other and count only when the word is long.
DOUBTFUL = {("e", "c"), ("c", "e"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("t", "l"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("h", "b"), ("н", "п"), ("п", "н"), ("и", "н"), ("п", "л"), ("л", "п"), ("г", "т"), ("т", "г"), ("ш", "щ"), ("ь", "ъ"), ("cl", "d"), ("rn", "m"), ("h", "li")}

_HYPHEN = regex.compile(r"([\p{L}\p{M}\p{N}@(’'\p{Cf}]+(?:[-‐‑][\p{L}\p{M}\p{N}@(’'\p{Cf}]+)*)\p{Cf}*([-‐‑¬\xad])[\s\p{Cf}]*$")
_TAIL_SPACE = " \t\r\x0b\x0c\xa0\u2002\u2007\u2009\u200b\u200c\u200d\u202f\u2060\ufeff"
_NEXT = regex.compile(r"^\s*([\p{L}\p{M}\p{N}@(\p{Cf}]+(?:[-‐‑][\p{L}\p{M}\p{N}@(\p{Cf}]+)*)")
#: A word; an apostrophe belongs to it between a vowel and a letter, where recognition puts it for an accent.
_TOKEN = regex.compile(r"(?:[\p{L}\p{M}\p{N}@(]|(?<=[aeiouAEIOU])'(?=\p{L}))+(?:-(?:[\p{L}\p{M}\p{N}@(]|(?<=[aeiouAEIOU])'(?=\p{L}))+)*")
_PLAIN_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}@(]+(?:-[\p{L}\p{M}\p{N}@(]+)*")
_URL = regex.compile(r"(?:https?://|www\.)\S+")
_TERMINAL = regex.compile(r"[.!?:;。”»“)\]]\s*$")
_MARK = regex.compile(r"^\s*(?:[•–*-]\s|\d+[.)]\s|Figure|Fig\b|\d+\.\d+\s)")
_NUMBER = r"[0-9lIOoSB]{1,4}"
_BARE = regex.compile(rf"^([–—-]\s*)?({_NUMBER}|[ivxlcIVXLC]{{1,6}})(\s*[–—-])?$")
_PAGE_OF = regex.compile(rf"^\p{{L}}[\p{{L}}@(0-9]{{0,7}}\.?\s+({_NUMBER}|[ivxlc]{{1,6}})(?:\s*/\s*{_NUMBER})$")
_BEFORE = regex.compile(rf"^\s*({_NUMBER}|[ivxlc]{{1,6}})(?:\s{{2,}}|\s*[|·•]\s*)(\p{{L}}.*)$")
_AFTER = regex.compile(rf"^(.*\p{{L}}\S*)(?:\s{{2,}}|\s*[|·•]\s*)({_NUMBER}|[ivxlc]{{1,6}})$")
_CHAPTER_FIRST = regex.compile(rf"^(\p{{L}}[\p{{L}}@(0-9]{{4,8}})\s+({_NUMBER}|[IVXLC]{{1,6}})\s*[·•:–—]\s*(\p{{L}}.*)$")
_CHAPTER_LAST = regex.compile(rf"^(\p{{L}}.*?)\s+[—–·]\s+(\p{{L}}[\p{{L}}@(0-9]{{4,8}})\s+({_NUMBER}|[IVXLC]{{1,6}})$")
_JUNK = regex.compile(r"[\s.,'’`´·*|_~^]+$")

_SKELETON = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("fi", "h"), ("li", "h")]
_SKELETON_CHARS = str.maketrans("e(@f1l0bq95ü82гпилцъ", "ccatiiohggsuвzтннннь", "")


def skeleton(text: str) -> str:
    """A title's letters with confusable ones levelled."""
    out = canonical("".join(c for c in canonical(text).casefold() if c.isalnum() or c in "@("))
    for a, b in _SKELETON:
        out = out.replace(a, b)
    return out.translate(_SKELETON_CHARS)


def word_key(token: str) -> str:
    """Form in which words are counted and looked up."""
    return canonical(canonical(token).lower())


def broken_end(line: str) -> regex.Match | None:
    """The word and hyphen that a line ends in, null if it ends otherwise."""
    return _HYPHEN.search(line) if line.rstrip(_TAIL_SPACE)[-1:] in tuple("-‐‑¬\xad") else None


def is_scan(text: str) -> bool:
    """Whether a page's paragraphs are cut into lines of about one width, as recognised print is; pages with fewer wrapped lines need other signs."""
    lines = text.split("\n")
    if sorted(map(len, lines))[len(lines) * 4 // 5] > PRINT_WIDTH:
        return False
    wrapped = 0
    for a, b in zip(lines, lines[1:]):
        a, b = a.strip(), b.strip()
        if len(a) > 25 and b and not _TERMINAL.search(a) and not _MARK.match(b) and (b[0].islower() or b[0].isdigit() or broken_end(a) or len(a) > 36):
            wrapped += 1
            if wrapped == 2:
                return True
    return False


def is_narrow(text: str) -> bool:
    """Whether no line of a page is wider than print; wide characters take two columns."""
    lines = text.split("\n")
    if max(map(len, lines)) > PRINT_WIDTH:
        return False
    return all(x.isascii() or sum(1 + (unicodedata.east_asian_width(c) in "WF") for c in x) <= PRINT_WIDTH for x in lines)


def number_of(digits: str) -> int | None:
    """Value of a page number as read, roman ones included."""
    if any(c.isdigit() for c in digits) or digits in ("l", "lO", "ll", "O"):
        plain = digits.translate(str.maketrans("lIOoSB", "110058"))
        return int(plain) if plain.isdecimal() else None
    value, last = 0, 0
    for c in reversed(digits.lower()):
        n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}.get(c)
        if n is None:
            return None
        value += n if n >= last else -n
        last = max(last, n)
    return value


def edge_of(line: str, after: str, before: str, top: bool) -> tuple[str, str | None, int | None] | None:
    """(shape, key, number) of a line at the edge of a page that may be a running one.

    Shapes: number (a bare page number), folio (one with dashes or a count of pages), titled (a title with a number or chapter), caps
    and plain (titles alone).
    """
    text = _JUNK.sub("", line.strip())
    look = canonical(text)
    if m := _BARE.match(look):
        return ("folio" if m.group(1) and m.group(3) else "number", None, number_of(m.group(2)))
    if m := _PAGE_OF.match(look):
        return "folio", None, number_of(m.group(1))
    if len(look) > 110 or "=" in look or _MARK.match(look):
        return None
    if m := _BEFORE.match(text):
        return "titled", skeleton(m.group(2)), number_of(m.group(1))
    if m := _AFTER.match(text):
        return "titled", skeleton(m.group(1)), number_of(m.group(2))
    if m := _CHAPTER_FIRST.match(look):
        return "titled", skeleton(m.group(3)), None
    if m := _CHAPTER_LAST.match(look):
        return "titled", skeleton(m.group(1)), None
    if not look[:1].isalpha() or not look[:1].isupper() and not look[:1].isdigit() or line.rstrip()[-1:] in ".!?;:,-¬\xad‐" and not line.rstrip().endswith(" .") and not line.rstrip().endswith(" ,"):
        return None
    # a line that a sentence runs through is no title
    if top and after[:1].islower() and "=" not in after[:16] or not top and before and not _TERMINAL.search(before) and not before[-1:].isdigit() and len(before) > 25:
        return None
    letters = [c for c in look if c.isalpha()]
    caps = len(letters) > 4 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)
    return ("caps" if caps else "plain"), skeleton(text), None


def take_apart(text: str) -> list[tuple]:
    """(line_no, spot, shape, key, number, hyphen, tail, head, next_line, words) of the lines of a scanned page.

    spot counts non-blank lines from the top (0, 1) or from the foot (-1, -2). A word broken at the line end is given as tail and
    head with the line where it goes on; its parts are not among the words.
    """
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    spots: dict[int, int] = {}
    for k, i in enumerate(full[:2]):
        spots[i] = k
    for k, i in enumerate(full[:1:-1][:2]):
        spots.setdefault(i, -1 - k)
    edges = {}
    for i, spot in spots.items():
        at = full.index(i)
        after = lines[full[at + 1]].strip() if at + 1 < len(full) else ""
        before = lines[full[at - 1]].strip() if at else ""
        edges[i] = edge_of(lines[i], after, before, spot >= 0)
    out = []
    skip_first = None
    for at, i in enumerate(full):
        line = lines[i]
        m = broken_end(line)
        tail = head = None
        following = None
        body = line
        if m:
            body = line[: m.start(1)]
            tail = m.group(1)
            if at + 1 < len(full) and full[at + 1] == i + 1 and (n := _NEXT.match(lines[i + 1])):
                following, head = i + 1, n.group(1)
        if skip_first is not None:
            body = body[skip_first:] if skip_first <= len(body) else ""
        skip_first = n.end() if m and following is not None else None
        words = _TOKEN.findall(canonical(_URL.sub(" ", body)))
        shape, key, number = edges.get(i) or (None, None, None)
        out.append((i, spots.get(i), shape, key, number, m.group(2) if m else None, tail, head, following, words))
    return out


_TEXT, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_PROFILE = T.StructType(
    [T.StructField("word", _TEXT), T.StructField("n_clean", _LONG), T.StructField("n_scan", _LONG), T.StructField("page_id", _LONG), T.StructField("book", _TEXT)]
    + [T.StructField(c, _INT) for c in ("page_index", "line_no", "spot")]
    + [T.StructField("shape", _TEXT), T.StructField("key", _TEXT), T.StructField("number", _INT)]
    + [T.StructField(c, _TEXT) for c in ("hyphen", "tail", "head")]
    + [T.StructField("next_line", _INT), T.StructField("words", T.ArrayType(_TEXT)), T.StructField("sure", T.BooleanType())]
)


def read_pages(pages: DataFrame) -> DataFrame:
    """Word counts (word, n_clean, n_scan) of all pages and the lines of scanned ones, in one pass and one table.

    Counts are added up within each task before they leave Python, in rounds of at most HELD_WORDS distinct words. Narrow pages without
    another sign of a scan are not sure: they give their lines and, under their page_id, both counts of which settled() keeps one.
    """
    schema = to_arrow_schema(_PROFILE)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 17
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def counted(clean: Counter, scan: Counter, page: tuple = (None, None)) -> list[tuple]:
        counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for which, counter in ((0, clean), (1, scan)):
            for token, n in counter.items():
                key = word_key(token)
                counts[key][which] += n
                if "(" in key:
                    counts[key.replace("(", "")][which] += n
            counter.clear()
        return [(w, a, b, *page, *[None] * 12) for w, (a, b) in counts.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, scan = Counter(), Counter()
        for batch in batches:
            rows = []
            for page_id, book, index, ocr, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not text or text.isspace():
                    continue
                narrow = not (shaped := is_scan(text)) and is_narrow(text)
                if shaped or narrow:
                    sure = shaped or bool(ocr)
                    of_page = Counter()
                    for line in take_apart(text):
                        (scan if sure else of_page).update(line[-1])
                        rows.append((None, None, None, page_id, book, index, *line, sure))
                    if not sure:
                        rows += counted(Counter((_TOKEN if "'" in text else _PLAIN_TOKEN).findall(text)), of_page, (page_id, book))
                else:
                    clean.update((_TOKEN if "'" in text else _PLAIN_TOKEN).findall(text))
            yield table(rows)
            if len(clean) + len(scan) > HELD_WORDS:
                yield table(counted(clean, scan))
        yield table(counted(clean, scan))

    ocr = F.array_contains("flags", "ocr") if "flags" in pages.columns else F.lit(None).cast("boolean")
    return pages.select("page_id", "book", "page_index", ocr.alias("ocr"), "text").where("text IS NOT NULL").mapInArrow(run, _PROFILE)


def settled(pages: DataFrame, books: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of scanned pages, word counts of all pages and running lines, when the pages that are not sure are judged.

    Such a page is a scan when its book has SHARED_PAGES sure ones and one of its lines is a running one among them.
    """
    profile = read_pages(pages).checkpoint()
    lines = profile.where("word IS NULL").drop("word", "n_clean", "n_scan")
    scanned = lines.where("sure").groupBy("book").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") >= SHARED_PAGES).select("book")
    asked = lines.where("NOT sure").join(broadcast_if_small(scanned), "book", "left_semi").select(*lines.columns).checkpoint()
    lines = lines.where("sure").unionByName(asked)
    running = running_lines(lines, books).checkpoint()
    taken = asked.select("page_id").distinct().join(running.select("page_id").distinct(), "page_id", "left_semi").withColumn("taken", F.lit(True)).checkpoint()
    few = broadcast_if_small(taken)
    lines = profile.where("sure").select(*lines.columns).unionByName(asked.join(few, "page_id", "left_semi").select(*lines.columns))
    refused = broadcast_if_small(asked.join(few, "page_id", "left_anti").select("page_id").distinct())
    running = running.join(refused, "page_id", "left_anti").checkpoint()

    words = profile.where("word IS NOT NULL").select("word", "n_clean", "n_scan", "page_id")
    doubtful = words.where("page_id IS NOT NULL").join(few, "page_id", "left")
    doubtful = doubtful.select("word", F.when(F.col("taken"), 0).otherwise(F.col("n_clean")).alias("n_clean"), F.when(F.col("taken"), F.col("n_scan")).otherwise(0).alias("n_scan"))
    words = words.where("page_id IS NULL").drop("page_id").unionByName(doubtful)
    counts = words.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_scan").alias("n_scan"))
    return lines, counts.checkpoint(), running


class Trie:
    """A vocabulary as a trie of dictionaries; the empty key holds a word's frequency."""

    def __init__(self, words: Iterator[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = n

    def within(self, word: str, bound: int = MOST_COST, others: bool = False) -> dict[str, tuple[int, int, bool, bool]]:
        """Every other word from which known confusions, and with others any edits, of at most the bound make the given one: cost, frequency, whether a sure confusion is among them, and whether all are known confusions.

        The automaton's states are places in the word with the cost so far; it reads the trie's letters and moves on equal letters, along a confusion, or
        along any other edit. Of several ways to one word the cheapest counts, known confusions before others and sure ones before doubtful ones.
        """
        found: dict[str, tuple[int, int, bool, bool]] = {}
        stack = [(self.root, 0, 0, "", False, True)]
        n = len(word)
        while stack:
            node, at, cost, path, sure, known = stack.pop()
            if at == n and "" in node and cost and path != word:
                best = found.get(path)
                if best is None or (cost, not known, not sure) < (best[0], not best[3], not best[2]):
                    found[path] = (cost, node[""], sure, known)
            if at < n and (nxt := node.get(word[at])) is not None:
                stack.append((nxt, at + 1, cost, path + word[at], sure, known))
            if at < n and cost + CONFUSION <= bound:
                for printed, read in _BY_READ.get(word[at], ()):
                    if not word.startswith(read, at):
                        continue
                    to = node
                    for c in printed:
                        to = to.get(c)
                        if to is None:
                            break
                    if to is not None:
                        stack.append((to, at + len(read), cost + CONFUSION, path + printed, sure or (printed, read) not in DOUBTFUL, known))
            if others and cost + OTHER_EDIT <= bound:
                dear = cost + OTHER_EDIT
                if at < n:
                    stack.append((node, at + 1, dear, path, sure, False))  # a letter put in
                for c, nxt in node.items():
                    if not c:
                        continue
                    stack.append((nxt, at, dear, path + c, sure, False))  # left out
                    if at < n:
                        stack.append((nxt, at + 1, dear, path + c, sure, False))  # exchanged
                        if at + 1 < n:
                            stack.append((nxt, at + 2, dear, path + c, sure, False))  # read as two
                        for d, far in nxt.items():
                            if d:
                                stack.append((far, at + 1, dear, path + c + d, sure, False))  # two read as one
        return found


_BY_READ: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _printed, _read in CONFUSIONS:
    _BY_READ[_read[0]].append((_printed, _read))
_BY_READ = dict(_BY_READ)
_NUMERIC = regex.compile(r"^(?=.*\d)(?=.*[lIiOo])[\dlIiOo]+$")


def corrections(word: str, times: int, trie: Trie, known: int = 0) -> list[tuple[str, int, int, bool]]:
    """(meant, cost, frequency, by known confusions) of the words that one may be a misreading of.

    A short word or one with doubtful confusions only needs a candidate that is much more frequent; a word that the vocabulary has (known times) needs one that
    is MISREAD_RATIO times as frequent and, if the word is short, sure. Other edits come into question for long words that the vocabulary lacks.
    """
    others = not known and len(word) >= OTHER_LETTERS
    found = trie.within(word, others=others)
    if word.startswith("(") and not any(c[3] for c in found.values()):
        found = {**trie.within(word[1:], others=others), **found}
    good = []
    for candidate, (cost, n, sure, listed) in found.items():
        if listed:
            if known and (n < MISREAD_RATIO * known or len(word) < 6 and not sure):
                continue
            need = 4 * times if sure else 8 * times
            if len(word) < 4:
                need = max(need, 40)
            elif len(word) < 6 and not sure:
                need = max(need, 12)
            if n >= max(need, 4 if sure else 6):
                good.append((candidate, cost, n, True))
        elif n >= max(8 * times, 6):
            good.append((candidate, cost, n, False))
    return good


def look_up(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, meant, confusions (their cost), frequency and listed (by known confusions) of all words of the vocabulary (word, n) that the asked ones (word, n, known) may be misreadings of.

    The vocabulary is divided into tries of bounded size, the asked words into blocks; every block meets every trie.
    """
    tries = vocabulary.count() // TRIE_WORDS + 1
    blocks = unknown.count() // LOOKED_UP + 1
    blocks = max(blocks, min(8, unknown.sparkSession.sparkContext.defaultParallelism))
    v = vocabulary.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(tries)).cast("int").alias("trie"))
    v = v.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    u = unknown.select("word", "n", "known", F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"))
    u = u.select("*", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("trie"))

    def search(key, left, right):
        import pandas as pd

        trie = Trie(zip(left["word"], left["n"]))
        rows = [(word, *c) for word, times, known in zip(right["word"], right["n"], right["known"]) for c in corrections(word, times, trie, known)]
        return pd.DataFrame(rows, columns=["word", "meant", "confusions", "frequency", "listed"])

    pairs = v.groupBy("trie", "block").cogroup(u.groupBy("trie", "block"))
    return pairs.applyInPandas(search, "word string, meant string, confusions int, frequency long, listed boolean")


def _held(df: DataFrame, column: str) -> list | None:
    """The values of a column where they are at most HELD_VALUES, to be written into the plan; null where they are more, which takes a join."""
    values = [r[0] for r in df.select(column).limit(HELD_VALUES + 1).collect()]
    return values if len(values) <= HELD_VALUES else None


def chosen(answers: DataFrame, content: DataFrame) -> DataFrame:
    """word, meant and confusions of the best answer of look_up() to every word.

    Known confusions come before other edits and fewer before more; among equals the one that stands more often beside the same words on the lines, then the more
    frequent one. Other edits count only with OTHER_CONTEXTS such places. Lines without neighbours and words broken at line ends have no context.
    """
    best = Window.partitionBy("word").orderBy(F.col("listed").desc(), "confusions")
    first = answers.withColumn("r", F.rank().over(best)).where("r = 1").drop("r").checkpoint()
    several = first.groupBy("word").agg(F.count("*").alias("k"), F.max("listed").alias("l")).where("k > 1 OR NOT l").select("word")
    lined = content.where("size(words) > 1").select(F.transform("words", F.lower).alias("words"))
    # lines with such words, and each word's neighbours
    look = lambda i: F.get("words", i)
    open_words = _held(several, "word")
    met = lined if open_words is None else lined.where(F.arrays_overlap("words", F.array(*map(F.lit, open_words or [""]))))
    spots = met.select("words", F.posexplode("words").alias("i", "word")).join(first, "word")
    if open_words is None:
        spots = spots.join(several, "word", "left_semi")
    beside = F.array(F.when(look(F.col("i") - 1).isNotNull(), F.xxhash64(look(F.col("i") - 1), "meant")), F.when(look(F.col("i") + 1).isNotNull(), F.xxhash64("meant", look(F.col("i") + 1))))
    wanted = spots.select("word", "meant", F.explode(beside).alias("pair")).where("pair IS NOT NULL").distinct().checkpoint()
    # how often the lines hold them with what the word may mean
    pairs = F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.xxhash64(look(i), look(i + 1)))
    known_pairs = _held(wanted.select("pair").distinct(), "pair")
    if known_pairs is not None:
        pairs = F.filter(pairs, lambda h: h.isin(known_pairs))
    seen = lined.select(F.explode(pairs).alias("pair"))
    if known_pairs is None:
        seen = seen.join(wanted.select("pair").distinct(), "pair", "left_semi")
    seen = seen.groupBy("pair").agg(F.count("*").alias("n"))
    context = wanted.join(seen, "pair").groupBy("word", "meant").agg(F.sum("n").alias("context"))
    ranked = first.join(context, ["word", "meant"], "left").where(F.col("listed") | (F.col("context") >= OTHER_CONTEXTS))
    order = F.struct(F.coalesce("context", F.lit(0)).alias("c"), "frequency", "meant", "confusions")
    return ranked.groupBy("word").agg(F.max(order).alias("b")).select("word", F.col("b.meant").alias("meant"), F.col("b.confusions").alias("confusions"))


def running_lines(lines: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """page_id and line_no of running heads and feet and page numbers among lines of read_pages()."""
    edges = lines.where("shape IS NOT NULL AND spot IS NOT NULL").select("page_id", "book", "page_index", "line_no", "spot", "shape", "key", "number")
    # page numbers: most pages of a book agree on printed number minus page index
    numbered = edges.where("number IS NOT NULL AND page_index IS NOT NULL")
    votes = numbered.groupBy("book", (F.col("number") - F.col("page_index")).alias("offset")).agg(F.count("*").alias("n"))
    offset = votes.groupBy("book").agg(F.max(F.struct("n", "offset")).alias("v")).select("book", F.col("v.offset").alias("offset"), F.col("v.n").alias("votes"))
    numbers = edges.where("shape IN ('number', 'folio')").join(broadcast_if_small(offset), "book", "left")
    near = F.abs(F.col("number") - F.col("page_index") - F.col("offset")) <= 3
    outer = F.col("spot").isin(0, -1) | (F.col("spot") == 1)
    first = numbers.where(outer & ((F.col("shape") == "folio") | F.coalesce(near, F.lit(False)) | ((F.col("spot") != 1) & F.col("number").isNull())))
    roman = numbers.where((F.col("shape") == "number") & F.col("spot").isin(0, -1) & (F.col("number") <= 20) & (F.col("page_index") <= 20) & ~F.coalesce(near, F.lit(False)))
    roman = roman.where(F.abs(F.col("number") - F.col("page_index")) <= 2)
    is_number = first.unionByName(roman).select("page_id", "line_no")

    # a number in the next line marks the title above it as running
    with_number = is_number.join(edges.where("spot = 1").select("page_id", "line_no"), ["page_id", "line_no"]).select("page_id").distinct().withColumn("numbered", F.lit(True))
    titles = edges.where("key IS NOT NULL AND key != '' AND spot IN (0, -1)").join(with_number, "page_id", "left")
    titles = titles.withColumn("numbered", F.coalesce("numbered", F.lit(False)) & (F.col("spot") == 0))
    counted = titles.groupBy("book", "key").agg(
        F.count_distinct("page_index").alias("pages"),
        F.min(F.when((F.col("shape") == "plain") & (F.col("spot") == 0) & ~F.col("numbered"), F.col("page_index"))).alias("opening"),
        F.max(F.when(F.col("shape").isin("titled", "caps") | F.col("numbered"), 1).otherwise(0)).alias("marked"),
    )
    if books is not None:
        known = books.where("title IS NOT NULL").select("book", _skeletons(F.col("title")).alias("key")).distinct()
        counted = counted.join(known.withColumn("of_book", F.lit(True)), ["book", "key"], "left")
    else:
        counted = counted.withColumn("of_book", F.lit(None).cast("boolean"))
    of_book = F.coalesce(F.col("of_book"), F.lit(False))
    shared = counted.where((F.col("pages") >= SHARED_PAGES) | of_book | (F.col("marked") == 1))
    shared = shared.withColumn("of_book", of_book)
    # misread copies of a shared title: same book and about the same length
    sure = shared.where((F.col("pages") >= SHARED_PAGES) | F.col("of_book"))
    band = lambda c: F.floor(F.length(c) / 6)
    rest = titles.join(shared.select("book", "key"), ["book", "key"], "left_anti")
    spread = sure.select("book", F.col("key").alias("like"), "opening", "of_book", F.explode(F.array(*[band("key") + d for d in (-1, 0, 1)])).alias("band"))
    fuzzy = rest.withColumn("band", band("key")).join(spread, ["book", "band"])
    fuzzy = fuzzy.where(F.levenshtein("key", "like") <= F.greatest(F.lit(1), F.floor(F.length("like") * 0.15)))
    hits = titles.join(shared.select("book", "key", "opening", "of_book"), ["book", "key"]).unionByName(fuzzy.select(*titles.columns, "opening", "of_book"))
    opens = (F.col("shape") == "plain") & (F.col("spot") == 0) & ~F.col("of_book") & ~F.col("numbered") & (F.col("page_index") == F.col("opening"))
    return hits.where(~opens).select("page_id", "line_no").unionByName(is_number).distinct()


def _skeletons(title):
    @F.pandas_udf(T.StringType())
    def run(titles):
        import pandas as pd

        return pd.Series([skeleton(x) if x is not None else None for x in titles], dtype=object)

    return run(title)


def _keys(column):
    @F.pandas_udf(T.StringType())
    def run(tokens):
        import pandas as pd

        return pd.Series([word_key(x) if x is not None else None for x in tokens], dtype=object)

    return run(column)


def defects(pages: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """page_id, line_no, defect, token and meant of every defect of the scanned pages.

    defect is running, hyphen or misread. token is the word as it was read (the joined word of a hyphen), meant the word as it was printed, in small
    letters, where it is another one; a line has a row for each misread word. pages: page_id, book, page_index, text and, if at hand, flags; books: book and title, to know a book's title where it is a running head. Null, empty and
    blank texts give nothing; pages without a book or index only lose the comparison with their book; a page delivered several times is judged each time.
    Empty tables give an empty result; other columns are not read.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    return _defects(*settled(pages, books))


def _defects(lines: DataFrame, counts: DataFrame, running: DataFrame) -> DataFrame:
    vocabulary = counts.where(F.col("n_clean") >= KNOWN_TIMES).select("word", F.col("n_clean").alias("n"))

    most = vocabulary.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    content = lines.join(broadcast_if_small(running), ["page_id", "line_no"], "left_anti")

    # words broken at line ends: the joined word and the compound, as often as they are known
    strip = lambda c: F.regexp_replace(c, r"[\p{Cf}]", "")
    broken = content.where("hyphen IS NOT NULL").select(
        "page_id", "line_no", "next_line", "hyphen", strip("tail").alias("tail"), strip("head").alias("head")
    )
    broken = broken.withColumn("whole", _keys(F.concat("tail", F.coalesce("head", F.lit("")))))
    broken = broken.withColumn("compound", F.when(F.col("head").isNotNull(), _keys(F.concat_ws("-", "tail", "head"))).otherwise(F.lit(None).cast("string")))
    known = counts.select("word", "n_clean", "n_scan")
    broken = broken.join(known.select(F.col("word").alias("whole"), F.col("n_clean").alias("n_whole")), "whole", "left")
    broken = broken.join(known.select(F.col("word").alias("compound"), (F.col("n_clean") + F.col("n_scan")).alias("n_compound")), "compound", "left")
    n_whole, n_compound = F.coalesce("n_whole", F.lit(0)), F.coalesce("n_compound", F.lit(0))
    broken = broken.withColumn("n_whole", n_whole).withColumn("n_compound", n_compound).checkpoint()

    # what is unknown among single words, joined words and compounds
    singles = content.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("word", _keys(F.col("token"))).checkpoint()
    # known ones are asked too: what they were misread from may be far more frequent
    unseen = F.expr("n_whole < 2 AND n_compound < 2")
    joined = broken.where(unseen | (F.greatest("n_whole", "n_compound") * MISREAD_RATIO <= most))
    joined = joined.withColumn("ask_whole", unseen | (F.col("n_whole") >= 2)).withColumn("ask_compound", unseen | (F.col("n_compound") >= 2))
    asked = (
        singles.select("word", "n")
        .unionByName(joined.where("head IS NOT NULL AND ask_whole").select(F.col("whole").alias("word"), F.lit(1).cast("long").alias("n")))
        .unionByName(joined.where("compound IS NOT NULL AND ask_compound").select(F.col("compound").alias("word"), F.lit(1).cast("long").alias("n")))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    has_letter = F.col("word").rlike(r"[\p{L}@(]") & (F.length("word") >= 2) & ~F.col("word").rlike("^[ivxlc]+$")
    known_n = F.coalesce("known", F.lit(0))
    unknown = asked.where(has_letter).join(vocabulary.select("word", F.col("n").alias("known")), "word", "left").withColumn("known", known_n)
    unknown = unknown.where(F.col("known") * MISREAD_RATIO <= most)
    meant = chosen(look_up(unknown, vocabulary), content).checkpoint()
    # an opening bracket alone before a known word is no misreading
    bare = meant.where("startswith(word, '(')").withColumn("rest", F.expr("substring(word, 2)"))
    plain = bare.join(vocabulary.select(F.col("word").alias("rest")), "rest", "left_semi").select("word")
    meant = meant.join(plain, "word", "left_anti")

    # digits among which letters stand are read as digits; both ways are few rows, told apart before anything is shuffled
    spelled = singles.where(F.col("token").rlike(r"^(?=.*[0-9])(?=.*[lIO])[0-9lIO]+$")).select("token", F.translate("token", "lIO", "110").alias("meant"))
    keyed = singles.select("token", "word").join(meant, "word").select("token", "meant").unionByName(spelled).checkpoint()
    tokens = content.select("page_id", "line_no", F.explode(F.array_distinct("words")).alias("token"))
    misread = tokens.join(broadcast_if_small(keyed), "token").select("page_id", "line_no", "token", "meant")

    # a misread broken word: the part that differs tells the line
    answers = joined.join(meant.select(F.col("word").alias("whole"), F.col("meant").alias("as_whole"), F.col("confusions").alias("c_whole")), "whole", "left")
    answers = answers.join(meant.select(F.col("word").alias("compound"), F.col("meant").alias("as_compound"), F.col("confusions").alias("c_compound")), "compound", "left")
    for form in ("whole", "compound"):
        answers = answers.withColumn(f"as_{form}", F.when(F.col(f"ask_{form}"), F.col(f"as_{form}")))
    # a known form that is no misreading settles the word
    answers = answers.where("(n_whole < 2 OR as_whole IS NOT NULL) AND (n_compound < 2 OR as_compound IS NOT NULL)")
    compound_better = F.col("as_compound").isNotNull() & (F.col("as_whole").isNull() | (F.col("c_compound") < F.col("c_whole")))
    answers = answers.withColumn("kept", compound_better).withColumn("word_meant", F.when(compound_better, F.col("as_compound")).otherwise(F.col("as_whole")))
    spoiled = answers.where("word_meant IS NOT NULL").withColumn("tail_key", _keys(F.col("tail"))).withColumn("head_key", _keys(F.col("head")))
    of_broken = [F.lit(None).cast("string").alias("token"), F.col("word_meant").alias("meant")]
    in_tail = spoiled.where("NOT startswith(word_meant, tail_key)").select("page_id", "line_no", *of_broken)
    in_head = spoiled.where("NOT endswith(word_meant, head_key)").select("page_id", F.col("next_line").alias("line_no"), *of_broken)
    misread = misread.unionByName(in_tail).unionByName(in_head)

    # a hyphen belongs to the word when the compound is the better known form
    soft = F.col("hyphen").isin("¬", "­")
    own = (F.col("n_compound") > F.col("n_whole")) | ((F.col("n_whole") < 2) & (F.col("n_compound") >= 2))
    kept = answers.where("kept").select("page_id", "line_no")
    hyphen = broken.where(soft | ~own).join(kept, ["page_id", "line_no"], "left_anti")
    # at the end of a page the rest is missing: a whole known word before a plain hyphen stays
    known_tail = vocabulary.select(F.col("word").alias("whole")).withColumn("tail_known", F.lit(True))
    hyphen = hyphen.join(known_tail, "whole", "left").where(soft | F.col("head").isNotNull() | F.col("tail_known").isNull())
    hyphen = hyphen.join(answers.select("page_id", "line_no", "word_meant"), ["page_id", "line_no"], "left")
    hyphen = hyphen.select("page_id", "line_no", F.concat("tail", F.coalesce("head", F.lit(""))).alias("token"), F.col("word_meant").alias("meant"))

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select("page_id", "line_no", F.lit(name).alias("defect"), "token", "meant")

    none = F.lit(None).cast("string")
    every = kind(running.withColumn("token", none).withColumn("meant", none), "running")
    return every.unionByName(kind(hyphen, "hyphen")).unionByName(kind(misread.distinct(), "misread"))


_CYRILLIC = str.maketrans("aceopxyë", "асеорхуё")


def as_written(meant: str, token: str) -> str:
    """A word of the vocabulary in the script and case of the word that stands in the text."""
    if regex.search(r"[бвгджзийклмнптфцчшщъыьэюя]", meant):
        meant = meant.translate(_CYRILLIC)
    letters = [c for c in token if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if token[:1].isupper() or token[:1].isdigit() and letters[:1] and letters[0].isupper() else meant


def reflow(text: str, found: list[dict] | None) -> list[str]:
    """The continuous paragraphs of a scanned page: running lines out, misread words put right, broken words joined."""
    by_line: dict[int, list[dict]] = defaultdict(list)
    for d in found or []:
        by_line[d["line_no"]].append(d)
    lines = text.split("\n")
    paragraphs: list[str] = []
    current = ""
    joined_rest: str | None = None
    kept = [i for i, x in enumerate(lines) if x.strip() and not any(d["defect"] == "running" for d in by_line[i])]
    widest = max((len(lines[i]) for i in kept), default=0)
    last = None
    for i in kept:
        line = lines[i].strip()
        for d in by_line[i]:
            if d["defect"] == "misread" and d["token"]:
                line = regex.sub(rf"(?<![\p{{L}}\p{{N}}@]){regex.escape(d['token'])}(?![\p{{L}}\p{{N}}@])", lambda m, d=d: as_written(d["meant"], m.group()), line)
        if joined_rest is not None and (m := _NEXT.match(line)):
            line, current = line[m.end() :], current + joined_rest
            joined_rest = None
            current += line
        else:
            ended = last is not None and (_TERMINAL.search(lines[last]) and (len(lines[last]) < 0.8 * widest or last < i - 1) or last < i - 1)
            closed = last is None or _TERMINAL.search(lines[last]) or len(lines[last]) < 0.6 * widest
            title = bool(_MARK.match(line)) and closed or "=" in line and line.endswith(")")
            if current and (ended or title or last is not None and len(lines[last]) < 0.6 * widest):
                paragraphs.append(current)
                current = ""
            current += ("" if not current or broken_end(current) else " ") + line
        broken = next((d for d in by_line[i] if d["defect"] == "hyphen"), None)
        if broken and (m := broken_end(current)):
            word = as_written(broken["meant"], m.group(1)) if broken["meant"] else broken["token"]
            current = current[: m.start(1)]
            joined_rest = word
        last = i
    if joined_rest is not None:
        current += joined_rest
    if current:
        paragraphs.append(current)
    return [p for p in (regex.sub(r"\s+", " ", p).strip() for p in paragraphs) if p]


def paragraphs(pages: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """page_id, para_no and text of the repaired paragraphs of every scanned page; pages that are no scans give their lines as they are."""
    ensure_checkpoint_dir(pages.sparkSession)
    lines, counts, running = settled(pages, books)
    found = _defects(lines, counts, running).groupBy("page_id").agg(F.collect_list(F.struct("line_no", "defect", "token", "meant")).alias("found"))
    scanned = lines.select("page_id").distinct().withColumn("scanned", F.lit(True))
    both = pages.select("page_id", "text").where("text IS NOT NULL").join(found, "page_id", "left").join(scanned, "page_id", "left")
    kind = T.ArrayType(T.StringType())

    @F.pandas_udf(kind)
    def run(texts, founds, scans):
        import pandas as pd

        out = []
        for text, f, scanned in zip(texts, founds, scans):
            if scanned:
                out.append(reflow(text, list(f) if f is not None else None))
            else:
                out.append([x for x in text.split("\n") if x.strip()])
        return pd.Series(out, dtype=object)

    return both.select("page_id", F.posexplode(run("text", "found", F.coalesce("scanned", F.lit(False)))).alias("para_no", "text"))

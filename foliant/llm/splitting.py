"""Splitting oversized items where the topic changes, with overlap between the pieces."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.arrow import emit_rows
from foliant.session import broadcast_if_small

#: Words on either side of a gap whose likeness is compared.
BLOCK_WORDS = 60
#: A piece takes at least this share of the window before a cut is looked for.
LEAST_FILL = 0.5
#: What a kind of boundary adds to the depth of a valley.
BONUS = {"paragraph": 0.6, "line": 0.35, "sentence": 0.2, "space": 0.0}

_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{N}]+(?:[\p{M}\p{L}\p{N}])*")
_GAP = regex.compile(
    r"(?P<paragraph>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?P<sentence>[.!?…।؟]+[\p{Pe}\p{Pf}\"']*\s+|[。！？]+[\p{Pe}\p{Pf}]*)|(?P<space>\s+)"
)


def _valleys(text: str, gaps: list[int]) -> list[float]:
    """For each gap the depth of the dip in likeness of the words before and after it."""
    words, starts = [], []
    for m in _WORD.finditer(text):
        words.append(m.group().casefold())
        starts.append(m.start())
    left: Counter = Counter()
    right: Counter = Counter()
    cross = norm_left = norm_right = 0
    at = lo = hi = 0
    likeness = []

    def shift(bag: Counter, other: Counter, word: str, by: int) -> tuple[int, int]:
        had = bag[word]
        bag[word] = had + by
        return by * other[word], (had + by) ** 2 - had**2

    for gap in gaps:
        border = bisect_left(starts, gap)
        if border - BLOCK_WORDS > at + BLOCK_WORDS:  # nothing in common with the last blocks
            left.clear(), right.clear()
            cross = norm_left = norm_right = 0
            at = lo = hi = max(0, border - BLOCK_WORDS)
        while hi < min(len(words), border + BLOCK_WORDS):
            c, n = shift(right, left, words[hi], 1)
            cross, norm_right, hi = cross + c, norm_right + n, hi + 1
        while at < border:
            c, n = shift(right, left, words[at], -1)
            cross, norm_right = cross + c, norm_right + n
            c, n = shift(left, right, words[at], 1)
            cross, norm_left, at = cross + c, norm_left + n, at + 1
        while lo < border - BLOCK_WORDS:
            c, n = shift(left, right, words[lo], -1)
            cross, norm_left, lo = cross + c, norm_left + n, lo + 1
        likeness.append(cross / (norm_left * norm_right) ** 0.5 if norm_left and norm_right else 0.0)

    peak_before, run = [], 0.0
    for i, x in enumerate(likeness):  # climb down from the last peak on the left
        run = max(run, x) if i and likeness[i - 1] >= x else x
        peak_before.append(run)
    peak_after, run = [0.0] * len(likeness), 0.0
    for i in range(len(likeness) - 1, -1, -1):
        x = likeness[i]
        run = max(run, x) if i + 1 < len(likeness) and likeness[i + 1] >= x else x
        peak_after[i] = run
    return [b + a - 2 * x for b, a, x in zip(peak_before, peak_after, likeness)]


def _whole_character(text: str, at: int, least: int) -> int:
    """The last place up to at that does not part a letter from its marks or joiners."""
    while at > least + 1 and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def cut_points(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of every piece.

    Each piece has at most max_chars characters and starts overlap characters before the end of the one before. An overlap must be
    smaller than the limit, as every piece brings new text; a larger one is refused (ValueError). A text within the limit is one
    piece, an empty one too. Cuts fall on the deepest valley in the upper part of the window, on the end of the window where it has no
    boundary at all.
    """
    n = len(text)
    max_chars = max(1, max_chars)
    overlap = max(0, overlap)
    if overlap >= max_chars:
        raise ValueError(f"an overlap of {overlap} characters leaves no room for new text within {max_chars}")
    if n <= max_chars:
        return [(0, n)]
    marks = [(m.end(), BONUS[m.lastgroup]) for m in _GAP.finditer(text) if 0 < m.end() < n]
    ends = [e for e, _ in marks]
    strong = [i for i, (_, b) in enumerate(marks) if b > 0]
    score = [0.0] * len(marks)
    for i, depth in zip(strong, _valleys(text, [ends[i] for i in strong])):
        score[i] = depth + marks[i][1]
    pieces, start, done = [], 0, 0
    while n - start > max_chars:
        last = start + max_chars
        first = done + max(1, int((last - done) * LEAST_FILL))
        inside = range(bisect_left(ends, first), bisect_right(ends, last))
        if not inside:
            inside = range(bisect_right(ends, done), bisect_right(ends, last))
        if inside:
            cut = ends[max(inside, key=lambda i: (score[i], i))]
        else:
            cut = _whole_character(text, last, done)
        pieces.append((start, cut))
        done, start = cut, cut - overlap
    return [*pieces, (start, n)]


def split_items(items: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of all items longer than their limit.

    items: item_kind, item_id, read_no, tier, text. limits: item_kind, tier, max_chars, overlap_chars. Result: item_kind,
    item_id, read_no, piece_no, n_pieces, start_char, end_char and, unless with_text is false, the piece. Kinds and tiers agree
    without regard to case and outer spaces; of several limits of one tier the smallest counts. Items without text, tier or a limit, and items
    within it, give no row. A limit whose overlap is as large as itself is refused (ValueError). Repeated items come out as often as they came in; empty tables give an empty result; other columns are not read.
    """
    name = lambda c: F.lower(F.trim(c))
    items = items.select("item_kind", "item_id", "read_no", "tier", "text")
    bound = (
        limits.where("max_chars > 0")
        .groupBy(name(limits["item_kind"]).alias("item_kind"), name(limits["tier"]).alias("__tier"))
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))).alias("b"))
        .select(F.col("item_kind").alias("__kind"), "__tier", F.col("b.max_chars").alias("max_chars"), F.col("b.overlap").alias("overlap"))
    )
    if bound.where("overlap >= max_chars").limit(1).count():
        raise ValueError("an overlap must be smaller than its limit")
    bound = broadcast_if_small(bound)
    over = items.join(bound, (name(items["item_kind"]) == bound["__kind"]) & (name(items["tier"]) == bound["__tier"]))
    over = over.where(F.char_length(items["text"]) > F.col("max_chars"))

    def pieces(text: str, max_chars: int, overlap: int) -> list[tuple]:
        cuts = cut_points(text, max_chars, overlap)
        return [(i, len(cuts), a, b, *([text[a:b]] if with_text else [])) for i, (a, b) in enumerate(cuts)]

    number = T.IntegerType()
    outputs = [("piece_no", number), ("n_pieces", number), ("start_char", number), ("end_char", number)]
    outputs += [("piece", T.StringType())] * with_text
    return emit_rows(over, ["item_kind", "item_id", "read_no"], ["text", "max_chars", "overlap"], outputs, pieces)


def all_items(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Page texts and the texts of the files that tasks hand over, as items of split_items()."""
    one = pages.select(
        F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.lit(0).alias("read_no"), F.lit("any").alias("tier"), "text"
    )
    files = tasks.select("task_id", "tier", F.posexplode(F.col("read.text")).alias("read_no", "text"))
    two = files.select(F.lit("task").alias("item_kind"), F.col("task_id").alias("item_id"), "read_no", "tier", "text")
    return one.unionByName(two)

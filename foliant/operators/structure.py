"""Structure of books: lines, running lines, page labels, outlines and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.plans.shapes import range_join


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, book, page_index, line_no and line of every line; pages without text give none."""
    each = pages.where("text IS NOT NULL").select("page_id", "book", "page_index", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each


def line_core(line: Column) -> Column:
    """A line with its numbers and roman numerals levelled, as running lines differ in them only."""
    level = F.regexp_replace(tx.one_line(line), r"[0-9]+", "#")
    return F.regexp_replace(level, r"(^|[^\p{L}\p{N}])[ivxlcIVXLC]+($|[^\p{L}\p{N}])", "$1#$2")


def running_lines(pages: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """book, core and number of pages of lines at page edges that at least `least` pages and `share` of a book's pages with text repeat."""
    filled = pages.where("text IS NOT NULL AND text RLIKE '[^ \\n\\t\\r]'")
    lines = page_lines(filled).where(F.trim("line") != "")
    w = Window.partitionBy("page_id")
    edge = lines.withColumn("lo", F.min("line_no").over(w)).withColumn("hi", F.max("line_no").over(w)).where("line_no = lo OR line_no = hi")
    counted = edge.select("book", "page_index", line_core(F.col("line")).alias("core")).groupBy("book", "core").agg(F.count_distinct("page_index").alias("pages"))
    sizes = filled.groupBy("book").agg(F.count_distinct("page_index").alias("book_pages"))
    return counted.join(sizes, "book").where((F.col("pages") >= least) & (F.col("pages") >= F.col("book_pages") * F.lit(share).cast("double")))


def clean_text(pages: DataFrame, running: DataFrame) -> DataFrame:
    """page_id and text without running lines; pages that have none left give an empty text."""
    lines = page_lines(pages).withColumn("core", line_core(F.col("line")))
    w = Window.partitionBy("page_id")
    full = F.trim("line") != ""
    lines = lines.withColumn("lo", F.min(F.when(full, F.col("line_no"))).over(w)).withColumn("hi", F.max(F.when(full, F.col("line_no"))).over(w))
    marked = lines.join(running.select("book", "core").distinct().withColumn("runs", F.lit(True)), ["book", "core"], "left")
    drop = F.coalesce("runs", F.lit(False)) & ((F.col("line_no") == F.col("lo")) | (F.col("line_no") == F.col("hi")))
    kept = F.array_sort(F.collect_list(F.when(~drop, F.struct("line_no", "line"))))
    return marked.groupBy("page_id").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"))


def label_offsets(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """book, offset and votes of the printed page number minus the page index, where enough of the numbered pages agree.

    Of two offsets with equally many votes the smaller counts.
    """
    numbered = pages.where("label RLIKE '^[0-9]{1,6}$' AND page_index IS NOT NULL").select("book", "page_index", F.col("label").cast("int").alias("n")).distinct()
    votes = numbered.groupBy("book", (F.col("n") - F.col("page_index")).alias("offset")).agg(F.count("*").alias("votes"))
    total = numbered.groupBy("book").agg(F.count("*").alias("numbered"))
    best = votes.groupBy("book").agg(F.max(F.struct("votes", (-F.col("offset")).alias("minus"))).alias("b"))
    best = best.select("book", (-F.col("b.minus")).alias("offset"), F.col("b.votes").alias("votes")).join(total, "book")
    return best.where((F.col("votes") >= least) & (F.col("votes") >= F.col("numbered") * F.lit(share).cast("double")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """One row for each paragraph record of a page, with its position."""
    each = pages.select("page_id", "book", "page_index", "height", F.posexplode("paras").alias("pos", "p"))
    return each.select("page_id", "book", "page_index", "height", "pos", "p.*")


def body_sizes(pages: DataFrame, least_chars: int = 2000) -> DataFrame:
    """book and body_size: the type size that most characters of a book have, if it has enough of them. The smaller of two equal ones."""
    sized = paragraphs(pages).where("size IS NOT NULL AND text IS NOT NULL").groupBy("book", "size").agg(F.sum(F.char_length("text")).alias("chars"))
    best = sized.groupBy("book").agg(F.max(F.struct("chars", (-F.col("size")).alias("minus"))).alias("b"), F.sum("chars").alias("all_chars"))
    return best.where(F.col("all_chars") > least_chars).select("book", (-F.col("b.minus")).alias("body_size"), F.col("b.chars").alias("chars"), "all_chars")


def bold_shares(pages: DataFrame, most: float = 0.45) -> DataFrame:
    """book, share of bold characters, and whether bold type means nothing there as more than `most` is bold."""
    p = paragraphs(pages).where("text IS NOT NULL")
    width = F.aggregate(F.coalesce("bold", F.array().cast("array<array<int>>")), F.lit(0).cast("long"), lambda a, r: a + (F.element_at(r, 2) - F.element_at(r, 1)))
    sums = p.groupBy("book").agg(F.sum(width).alias("bold_chars"), F.sum(F.char_length("text")).cast("long").alias("chars"))
    share = F.coalesce(F.col("bold_chars") / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0))
    return sums.withColumn("share", F.round(share, 6)).withColumn("meaningless", share > most)


def foot_notes(pages: DataFrame, body: DataFrame, from_height: float = 0.7, smaller: float = 0.9) -> DataFrame:
    """page_id and pos of footnotes: in the lower part of a page, from the first small or marked paragraph on, everything below."""
    p = paragraphs(pages).join(body.select("book", "body_size"), "book", "left").where("y0 >= height * " + str(from_height))
    small = F.coalesce(F.col("size") < F.col("body_size") * F.lit(smaller).cast("double"), F.lit(False))
    marked = p.withColumn("hit", small | F.coalesce(F.col("text").rlike(r"^\s*(?:\[[0-9]{1,2}\]|[*†‡])"), F.lit(False)))
    w = Window.partitionBy("page_id").orderBy("y0", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("note", F.max(F.col("hit").cast("int")).over(w) == 1).where("note").select("page_id", "pos")


def captions(pages: DataFrame) -> DataFrame:
    """First caption of every figure and table number of a book: book, figure, page_index, page_id and caption."""
    shape = r"^\s*(Figure|Fig\.|Table|Tab\.|Abbildung|Abb\.|Tabelle)\s+([0-9]+(?:\.[0-9]+)*)\s+(.*)$"
    hits = page_lines(pages).where(F.col("line").rlike(shape))
    kind = F.when(F.regexp_extract("line", shape, 1).rlike("^(Tab|Table)"), "TAB-").otherwise("FIG-")
    found = hits.select("book", "page_index", "page_id", "line_no", F.concat(kind, F.regexp_extract("line", shape, 2)).alias("figure"), tx.one_line(F.regexp_extract("line", shape, 3)).alias("caption"))
    w = Window.partitionBy("book", "figure").orderBy("page_index", "page_id", "line_no")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "line_no")


def outline(pages: DataFrame) -> DataFrame:
    """Sections of every book by numbered headings (`3.2 Title`): section, title, first and last page index.

    The first place of a number counts; a section ends where the next one starts, the last one with the book.
    """
    shape = r"^([0-9]{1,2}\.[0-9]{1,2}) +(\p{Lu}[^.!?=]{2,70})$"
    hits = page_lines(pages).where("page_index IS NOT NULL").where(F.col("line").rlike(shape))
    found = hits.select("book", "page_index", "page_id", "line_no", F.regexp_extract("line", shape, 1).alias("section"), F.trim(F.regexp_extract("line", shape, 2)).alias("title"))
    first = Window.partitionBy("book", "section").orderBy("page_index", "page_id", "line_no")
    once = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    ends = pages.groupBy("book").agg(F.max("page_index").alias("book_end"))
    order = Window.partitionBy("book").orderBy("page_index", "page_id", "line_no")
    nxt = once.withColumn("next_page", F.lead("page_index").over(order)).join(ends, "book")
    last = F.greatest(F.col("page_index"), F.coalesce(F.col("next_page"), F.col("book_end")))
    return nxt.select("book", "section", "title", F.col("page_index").alias("first_page"), last.alias("last_page"))


def section_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages with the sections whose range holds them."""
    p = pages.where("page_index IS NOT NULL").select("page_id", "book", "page_index")
    return range_join(p, sections.select("book", "section", "first_page", "last_page"), ["book"], "page_index", "first_page", "last_page")


def dehyphen_vocabulary(pages: DataFrame) -> DataFrame:
    """word and n: how often words, hyphenated ones included, stand within lines; the choice between joined and hyphenated forms rests on it."""
    words = page_lines(pages).select(F.explode(F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def joined_line_ends(pages: DataFrame) -> DataFrame:
    """Lines that end in a hyphen with the word they and the next line make: without the hyphen unless the hyphenated form is more frequent."""
    w = Window.partitionBy("page_id").orderBy("line_no")
    lines = page_lines(pages).withColumn("next_line", F.lead("line").over(w))
    tail = F.regexp_extract(F.lower("line"), r"([\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*)-\s*$", 1)
    head = F.regexp_extract(F.lower("next_line"), r"^\s*([\p{Ll}\p{N}]+)", 1)
    ends = lines.select("page_id", "line_no", tail.alias("tail"), head.alias("head")).where("tail != '' AND head != ''")
    ends = ends.withColumn("whole", F.concat("tail", "head")).withColumn("compound", F.concat_ws("-", "tail", "head"))
    known = dehyphen_vocabulary(pages)
    both = ends.join(known.select(F.col("word").alias("whole"), F.col("n").alias("n_whole")), "whole", "left")
    both = both.join(known.select(F.col("word").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
    keep = F.coalesce("n_compound", F.lit(0)) > F.coalesce("n_whole", F.lit(0))
    return both.select("page_id", "line_no", F.when(keep, F.col("compound")).otherwise(F.col("whole")).alias("word"))


def page_flags(pages: DataFrame) -> DataFrame:
    """page_id and the quality flags that its records call for, in fixed order."""
    text = F.coalesce("text", F.lit(""))
    chars = F.char_length(F.regexp_replace(text, r"\s", ""))
    area = F.aggregate(F.coalesce("images", F.array().cast("array<array<double>>")), F.lit(0.0).cast("double"), lambda a, r: a + (F.element_at(r, 3) - F.element_at(r, 1)) * (F.element_at(r, 4) - F.element_at(r, 2)))
    covered = F.coalesce(area > F.col("width") * F.col("height") * F.lit(0.45).cast("double"), F.lit(False))
    formulas = F.size(F.filter(F.split(text, "\n"), lambda x: tx.is_math_line(x)))
    scripts = tx.count_of(text, r"[_^](?:\{[^}]*\}|[\p{L}\p{N}_])")
    flags = F.array_compact(
        F.array(
            F.when((chars < 30) & covered, F.lit("scanned-no-text")),
            F.when((chars < 30) & ~covered, F.lit("blank")),
            F.when(tx.garble_ratio(text) > 0.01, F.lit("garbled")),
            F.when((formulas >= 3) | (scripts >= 6), F.lit("math-heavy")),
            F.when(F.coalesce("two_column", F.lit(False)), F.lit("two-column")),
        )
    )
    return pages.select("page_id", F.array_join(flags, ",").alias("flags"))


def reading_order(lines: DataFrame, keys: list[str], width: str = "width", x0: str = "x0", x1: str = "x1", y0: str = "y0", least: int = 8) -> DataFrame:
    """place of every line in reading order, for one and two columns.

    A page has two columns when each half holds at least `least` lines and less than a quarter cross the middle. Lines that cross it part the page into
    bands; within a band the left column comes before the right one.
    """
    middle = F.col(width) / 2
    side = F.when(F.col(x1) <= middle * 1.04, 1).when(F.col(x0) >= middle * 0.96, 2).otherwise(0)
    w = Window.partitionBy(*keys)
    marked = lines.withColumn("__side", side)
    left, right, all_lines = (F.sum((F.col("__side") == s).cast("int")).over(w) for s in (1, 2, 0))
    two = (left >= least) & (right >= least) & (all_lines < F.count("*").over(w) * 0.25)
    banded = marked.withColumn("__two", two).withColumn("__side", F.when(F.col("__two"), F.col("__side")).otherwise(0))
    ordered = Window.partitionBy(*keys).orderBy(y0, x0).rowsBetween(Window.unboundedPreceding, 0)
    banded = banded.withColumn("__band", F.when(F.col("__two"), F.sum((F.col("__side") == 0).cast("int")).over(ordered)).otherwise(0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__band", F.col("__side"), y0, x0))
    return banded.withColumn("place", place).withColumn("two_column", F.col("__two")).drop("__side", "__two", "__band")

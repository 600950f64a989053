"""From words with places to rows, lines and paragraphs, for pages whose text comes as boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx


def word_rows(words: DataFrame, keys: list[str], tolerance: float = 0.5, gap: float = 1.8) -> DataFrame:
    """Segments of words: keys, row, segment, x0, x1, y0, y1, text.

    Words whose baselines (y1) differ by less than `tolerance` of their height are one row; within a row a gap of more than `gap` heights parts segments.
    words: keys, x0, x1, y0, y1, word. Words without place or text are left out.
    """
    full = words.where("x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL AND word IS NOT NULL")
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(0.1))
    down = Window.partitionBy(*keys).orderBy("y1", "x0", "word")
    new_row = F.coalesce((F.col("y1") - F.lag("y1").over(down) > height * tolerance).cast("int"), F.lit(1))
    rows = full.withColumn("__new", new_row).withColumn("row", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys, "row").orderBy("x0", "word")
    part = F.coalesce((F.col("x0") - F.lag("x1").over(along) > height * gap).cast("int"), F.lit(0))
    cut = rows.withColumn("__part", part).withColumn("segment", F.sum("__part").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word"))), lambda w: w["word"]), " ")
    return cut.groupBy(*keys, "row", "segment").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), text.alias("text"))


def merged_pieces(lines: DataFrame, keys: list[str], tolerance: float = 0.45) -> DataFrame:
    """Pieces of one visual line put together: baselines within `tolerance` of the type size, read from left to right.

    lines: keys, x0, x1, y0, y1, size, text; the size of the longest piece is the line's.
    """
    down = Window.partitionBy(*keys).orderBy("y1", "x0", "text")
    new = F.coalesce((F.col("y1") - F.lag("y1").over(down) > F.coalesce("size", F.lit(10.0)) * tolerance).cast("int"), F.lit(1))
    marked = lines.where("text IS NOT NULL").withColumn("__new", new).withColumn("line", F.sum("__new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    size = F.max_by("size", F.char_length("text"))
    return marked.groupBy(*keys, "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), size.alias("size"), text.alias("text"))


def paragraph_breaks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the number of their paragraph within the page.

    A paragraph starts at a change of size, a wider pitch than usual, an indented line, a list mark, an equation or its end, and after a line that ends a sentence well
    before the right edge. lines: keys, x0, x1, y0, y1, size, text in reading order by (y0, x0).
    """
    down = Window.partitionBy(*keys).orderBy("y0", "x0", "text")
    page = Window.partitionBy(*keys)
    lag = lambda c: F.lag(c).over(down)
    pitch = F.col("y0") - lag("y0")
    d = lines.where("text IS NOT NULL AND trim(text) != ''").withColumn("__pitch", pitch)
    d = d.withColumn("__usual", F.percentile_approx("__pitch", 0.5).over(page)).withColumn("__left", F.min("x0").over(page)).withColumn("__right", F.max("x1").over(page))
    math = tx.is_math_line(F.col("text"))
    breaks = (
        (F.abs(F.col("size") - lag("size")) > 0.8)
        | (F.col("__pitch") > F.col("__usual") * 1.35)
        | (F.col("x0") > lag("x0") + 0.8 * F.coalesce("size", F.lit(10.0)))
        | F.col("text").rlike(r"^\s*(?:[•–▪*]\s|\d{1,3}[.)]\s|\([a-z0-9]\)\s)")
        | math
        | lag(math)
        | (lag("text").rlike(r"[.!?:。！？]['\"”»)]?\s*$") & (lag("x1") < F.col("__left") + (F.col("__right") - F.col("__left")) * 0.85))
    )
    started = d.withColumn("__new", F.coalesce(breaks, F.lit(False)).cast("int") + lag("text").isNull().cast("int"))
    return started.withColumn("paragraph", F.sum(F.least("__new", F.lit(1))).over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("__new", "__pitch", "__usual", "__left", "__right")


def joined_lines(first: Column, second: Column, whole_known: Column, compound_known: Column) -> Column:
    """Two lines of a paragraph as one: a soft hyphen goes, a hyphen before a small letter goes unless the hyphenated form is known more often, CJK lines meet without a space."""
    soft = F.concat(F.regexp_replace(first, "­\\s*$", ""), second)
    hard = F.concat(F.when(F.coalesce(compound_known, F.lit(0)) > F.coalesce(whole_known, F.lit(0)), first).otherwise(F.regexp_replace(first, r"-\s*$", "")), second)
    wide = first.rlike(tx.CJK + r"\s*$") & second.rlike(r"^\s*" + tx.CJK)
    return F.when(first.rlike("­\\s*$"), soft).when(first.rlike(r"[\p{L}\p{N}]-\s*$") & second.rlike(r"^\s*\p{Ll}"), hard).when(wide, F.concat(F.rtrim(first), F.ltrim(second))).otherwise(F.concat_ws(" ", F.rtrim(first), F.ltrim(second)))


def recognised_sizes(lines: DataFrame, keys: list[str], body: float = 10.0) -> DataFrame:
    """Type sizes of recognised lines from their heights: the median of lines of 25 characters or more is body size, heights within 0.72 to 1.18 of it too; larger ones are headings if short."""
    height = F.col("y1") - F.col("y0")
    usual = F.percentile_approx(F.when(F.char_length("text") >= 25, height), 0.5).over(Window.partitionBy(*keys))
    ratio = height / F.nullif(usual, F.lit(0.0))
    size = F.when(ratio.between(0.72, 1.18), F.lit(body)).otherwise(F.round(ratio * body, 1))
    return lines.withColumn("size", F.coalesce(size, F.lit(body))).withColumn("heading", F.coalesce((ratio > 1.18) & (F.char_length("text") <= 80), F.lit(False)))

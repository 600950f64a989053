"""Pages by label, parts of sections, numbered questions, and quick looks at a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators.structure import page_lines
from foliant.plans.shapes import islands


def labelled_pages(pages: DataFrame) -> DataFrame:
    """book, label and page_index of every label once: that of its first page."""
    return pages.where("label IS NOT NULL AND page_index IS NOT NULL").groupBy("book", "label").agg(F.min("page_index").alias("page_index"))


def find_pages(wanted: DataFrame, pages: DataFrame, key: str, spec: str = "page", most: int = 4) -> DataFrame:
    """key, first and last page index of cited labels: the exact label, else the only one that differs in case, or a range `a-b` of at most four pages.

    Labels that are not found give no row.
    """
    labels = labelled_pages(pages)
    folded = labels.groupBy("book", F.lower("label").alias("low")).agg(F.count("*").alias("n"), F.min("page_index").alias("at")).where("n = 1").select("book", "low", "at")
    parts = F.split(F.regexp_replace(F.trim(F.col(spec)), r"\s*[–-]\s*", "-"), "-", 2)
    w = wanted.where(F.col(spec).isNotNull()).select(key, "book", parts[0].alias("a"), F.coalesce(F.get(parts, 1), parts[0]).alias("b"))

    def place(df: DataFrame, c: str) -> DataFrame:
        exact = labels.select("book", F.col("label").alias(c), F.col("page_index").alias(f"{c}_exact"))
        loose = folded.select("book", F.col("low").alias(f"{c}_low"), F.col("at").alias(f"{c}_loose"))
        both = df.join(exact, ["book", c], "left").withColumn(f"{c}_low", F.lower(c)).join(loose, ["book", f"{c}_low"], "left")
        return both.withColumn(f"{c}_at", F.coalesce(f"{c}_exact", f"{c}_loose")).drop(f"{c}_exact", f"{c}_loose", f"{c}_low")

    found = place(place(w, "a"), "b").where("a_at IS NOT NULL AND b_at IS NOT NULL AND b_at >= a_at").where(F.col("b_at") - F.col("a_at") < most)
    return found.select(key, F.col("a_at").alias("first_page"), F.col("b_at").alias("last_page"))


def range_texts(pages: DataFrame) -> DataFrame:
    """Delivered pages of every book as text: `0-4, 7, 9-12`."""
    runs = islands(pages, ["book"], "page_index")
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first"), F.col("last")))
    listed = F.array_sort(F.collect_list(F.struct("first", part.alias("part"))))
    return runs.groupBy("book").agg(F.array_join(F.transform(listed, lambda x: x["part"]), ", ").alias("ranges"))


def book_parts(sizes: Column, budget: int) -> Column:
    """Part number of each of an array of sizes: ceil(total / budget) parts, each closed when the running sum reaches its share."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    share = total / F.greatest(F.ceil(total / budget), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("parts"))

    def step(a, x):
        part = F.floor(F.when(share > 0, a["sum"] / share).otherwise(0)).cast("int")
        return F.struct((a["sum"] + x).alias("sum"), F.concat(a["parts"], F.array(part)).alias("parts"))

    return F.aggregate(sizes, start, step, lambda a: a["parts"])


def section_parts(section_pages: DataFrame, pages: DataFrame, budget: int = 1500) -> DataFrame:
    """Parts of every section of about `budget` tokens that end with pages: book, section, part, first and last page, tokens."""
    once = pages.where("text IS NOT NULL AND page_index IS NOT NULL").groupBy("book", "page_index").agg(F.max(tx.estimate_tokens(F.col("text"))).alias("tokens"))
    sized = section_pages.select("book", "section", "page_index").distinct().join(once, ["book", "page_index"])
    listed = sized.groupBy("book", "section").agg(F.array_sort(F.collect_list(F.struct("page_index", "tokens"))).alias("ps"))
    parted = listed.withColumn("parts", book_parts(F.transform("ps", lambda x: x["tokens"]), budget))
    each = parted.select("book", "section", F.explode(F.arrays_zip("ps", "parts")).alias("z")).select("book", "section", F.col("z.parts").alias("part"), "z.ps.*")
    return each.groupBy("book", "section", "part").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.sum("tokens").alias("tokens"))


def fallback_sections(pages: DataFrame, per: int = 6) -> DataFrame:
    """Parts of six pages for books without an outline: book, part, first and last page."""
    ends = pages.groupBy("book").agg(F.max("page_index").alias("last")).where("last IS NOT NULL AND book IS NOT NULL")
    starts = ends.select("book", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(per))).alias("first_page"))
    return starts.select("book", (F.col("first_page") / per + 1).cast("int").alias("part"), "first_page", F.least(F.col("first_page") + per - 1, F.col("last")).alias("last_page"))


def unique_ids(df: DataFrame, keys: list[str], base: str, order: list[Column], name: str = "unique_id") -> DataFrame:
    """Ids made unique in order: the second `x` becomes `x-2`."""
    n = F.row_number().over(Window.partitionBy(*keys, base).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n)))


def split_questions(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Numbered questions of exam papers: key, number and text. A number starts a question if it is at most 3 as the first, else up to three above the last; other lines go on."""
    lines = F.split(F.col(text), "\n")
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("ns"))
    number = lambda x: F.regexp_extract(x, r"^\s*([0-9]{1,3})[.)]\s", 1).try_cast("int")

    def step(a, x):
        n = number(x)
        opens = F.coalesce(F.when(a["last"] == 0, n <= 3).otherwise((n > a["last"]) & (n <= a["last"] + 3)), F.lit(False))
        last = F.when(opens, n).otherwise(a["last"])
        return F.struct(last.alias("last"), F.concat(a["ns"], F.array(last)).alias("ns"))

    owned = texts.where(F.col(text).isNotNull()).select(key, lines.alias("ls"), F.aggregate(lines, start, step, lambda a: a["ns"]).alias("ns"))
    each = owned.select(key, F.posexplode(F.arrays_zip("ls", "ns")).alias("pos", "z")).select(key, "pos", F.col("z.ls").alias("line"), F.col("z.ns").alias("number")).where("number > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ")
    return each.groupBy(key, "number").agg(body.alias("question"))


def probe(pages: DataFrame, step: int = 1) -> DataFrame:
    """Quick look at every book from each step-th page: pages, with text, without, garbled, flagged as scans; step 1 looks at all of them."""
    seen = pages.where(F.col("page_index").isNotNull() & (F.col("page_index") % step == 0))
    letters = F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", ""))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("long")
    return seen.groupBy("book").agg(
        F.count("*").alias("pages"), count(letters >= 30).alias("with_text"), count(letters < 30).alias("without_text"),
        count(tx.garble_ratio(F.col("text")) > 0.01).alias("garbled"), count(F.array_contains("flags", "ocr")).alias("scans"),
    )


def boxes_of_polygons(points: Column) -> Column:
    """Bounding box (x0, y0, x1, y1) of a polygon given as an array of points."""
    xs, ys = F.transform(points, lambda p: F.element_at(p, 1)), F.transform(points, lambda p: F.element_at(p, 2))
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def source_text(pages: DataFrame) -> DataFrame:
    """book and its whole text with a marker before every page, from the last delivery of each page, as rows of (book, page_index, part) in order."""
    last = pages.where("page_index IS NOT NULL AND text IS NOT NULL").groupBy("book", "page_index").agg(F.max_by("text", "page_id").alias("text"), F.max_by("label", "page_id").alias("label"))
    return last.select("book", "page_index", F.concat(F.lit("PAGE "), F.coalesce("label", F.col("page_index").cast("string")), F.lit("\n"), F.col("text")).alias("part"))


def numbered_headings(pages: DataFrame) -> DataFrame:
    """Headings of the form `N.M Title` with their level and whether the number follows the one before it in the book (3.1 after 3.0 or 2.x)."""
    hits = page_lines(pages).where(F.col("line").rlike(r"^[0-9]{1,2}\.[0-9]{1,2} +\p{Lu}") & F.col("page_index").isNotNull())
    n = hits.select("book", "page_index", "page_id", "line_no", F.regexp_extract("line", r"^([0-9]+)\.", 1).cast("int").alias("chapter"), F.regexp_extract("line", r"^[0-9]+\.([0-9]+)", 1).cast("int").alias("section"))
    w = Window.partitionBy("book").orderBy("page_index", "page_id", "line_no")
    before = F.lag(F.struct("chapter", "section")).over(w)
    follows = (before["chapter"] == F.col("chapter")) & (before["section"] + 1 == F.col("section")) | (before["chapter"] + 1 == F.col("chapter")) & (F.col("section") <= 1)
    return n.withColumn("follows", F.coalesce(follows, F.lit(True)))

"""Readers of books, notes, results and recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

#: Characters after which unmarked text starts a new page at the next blank line.
PAGE_CHARS = 3000


def _cut_pages(lines: Column, size: int) -> Column:
    """Page number of every line when a page ends at the first blank line after `size` characters."""
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("pages"))

    def step(a, line):
        turn = (a["chars"] > size) & (F.trim(line) == "")
        page = a["page"] + turn.cast("int")
        chars = F.when(turn, 0).otherwise(a["chars"] + F.char_length(line))
        return F.struct(page.alias("page"), chars.alias("chars"), F.concat(a["pages"], F.array(page)).alias("pages"))

    return F.aggregate(lines, start, step, lambda a: a["pages"])


def text_pages(files: DataFrame, size: int = PAGE_CHARS) -> DataFrame:
    """Pages of text and Markdown books (book, text): book, page_index, label and text.

    Pages part at form feeds, else at markers of their own line (`{12}---` or `--- page 12 ---`), else after `size` characters at a blank line. A marker's number is
    the label of the page after it.
    """
    marker = r"^\s*(?:\{([0-9]+)\}-{3,}|-+\s*[Pp]age\s+([0-9ivxlc]+)\s*-+)\s*$"
    named = files.where("text IS NOT NULL").select("book", F.regexp_replace("text", "\r\n", "\n").alias("text"))
    fed = named.where(F.contains("text", F.lit("\f"))).select("book", F.posexplode(F.split("text", "\f")).alias("page_index", "text")).withColumn("label", F.lit(None).cast("string"))
    rest = named.where(~F.contains("text", F.lit("\f"))).withColumn("lines", F.split("text", "\n"))
    rest = rest.withColumn("marked", F.exists("lines", lambda x: x.rlike(marker)))
    by_size = rest.withColumn("cut", F.when(~F.col("marked"), _cut_pages(F.col("lines"), size)))
    lines = by_size.select("book", "marked", "cut", F.posexplode("lines").alias("pos", "line"))
    w = Window.partitionBy("book").orderBy("pos")
    is_mark = F.col("marked") & F.col("line").rlike(marker)
    page = F.when(F.col("marked"), F.sum(is_mark.cast("int")).over(w)).otherwise(F.element_at("cut", F.col("pos") + 1))
    labelled = lines.withColumn("page", page).withColumn("mark", is_mark)
    label = F.max(F.when(F.col("mark"), F.concat(F.regexp_extract("line", marker, 1), F.regexp_extract("line", marker, 2))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("mark"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    grouped = labelled.groupBy("book", "page").agg(label.alias("label"), body.alias("text"))
    grouped = grouped.where("trim(text) != '' OR label IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("book").orderBy("page")) - 1
    return grouped.select("book", order.alias("page_index"), "label", "text").unionByName(fed.select("book", "page_index", "label", "text"))


def read_books(spark: SparkSession, folder: str) -> DataFrame:
    """Text and Markdown files of a folder as (book, text), the book named by the file."""
    raw = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.\w+)?$", 1).alias("book"), F.col("value").alias("text"))
    return raw


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Study results of JSON files {course, results: [{id, correct, at}]}, as one row for each result; a BOM does no harm."""
    shape = "course string, results array<struct<id: string, correct: boolean, at: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), shape).alias("r"))
    each = raw.select("r.course", F.explode("r.results").alias("x"))
    return each.select("course", F.col("x.id").alias("id"), F.col("x.correct").alias("correct"), F.to_timestamp_ntz(F.col("x.at")).alias("at") if hasattr(F, "to_timestamp_ntz") else F.col("x.at").cast("timestamp_ntz").alias("at"))


def page_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Picture files of a folder in natural order: path, place."""
    files = spark.read.format("binaryFile").load(folder).select("path").where(F.lower("path").rlike(r"\.(?:png|jpe?g|tiff?|bmp|webp)$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(tx.natural_key(name), "path")))


def salvaged(new: DataFrame, cached: DataFrame, key: str = "page_index") -> DataFrame:
    """Recognised pages of an interrupted run that are free of errors and not in the cache yet; the first line of a page counts."""
    fine = new.where("error IS NULL")
    return fine.dropDuplicates([key]).join(cached.select(key), key, "left_anti")

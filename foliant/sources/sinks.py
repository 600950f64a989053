"""Writers: JSON lines, Markdown, card decks, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object for each row; Spark's commit protocol keeps half-written files out."""
    df.write.mode("overwrite").json(path)


def marked_bold(text: Column, ranges: Column) -> Column:
    """A text with ** around its bold ranges [[from, to]]; ranges that overlap an earlier one or lie outside are left out."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    ordered = F.array_sort(F.coalesce(ranges, F.array().cast("array<array<int>>")))

    def step(a, r):
        lo, hi = F.element_at(r, 1), F.element_at(r, 2)
        fits = (lo >= a["at"]) & (hi > lo) & (hi <= F.char_length(text))
        added = F.concat(a["out"], text.substr(a["at"] + 1, lo - a["at"]), F.lit("**"), text.substr(lo + 1, hi - lo), F.lit("**"))
        return F.struct(F.when(fits, added).otherwise(a["out"]).alias("out"), F.when(fits, hi).otherwise(a["at"]).alias("at"))

    return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], text.substr(a["at"] + 1, F.char_length(text))))


def markdown_pages(pages: DataFrame, heading_ratio: float = 1.45) -> DataFrame:
    """page_id and Markdown of every page with paragraphs: a page marker, headings by type size, bold ranges."""
    p = pages.select("page_id", "page_index", F.posexplode("paras").alias("pos", "p")).select("page_id", "page_index", "pos", "p.*").where("text IS NOT NULL")
    big = p.groupBy("page_id").agg(F.percentile_approx("size", 0.5).alias("usual"))
    marked = p.join(big, "page_id").withColumn("line", marked_bold(F.col("text"), F.col("bold")))
    head = F.coalesce(F.col("size") >= F.col("usual") * F.lit(heading_ratio).cast("double"), F.lit(False)) | F.coalesce("heading", F.lit(False))
    line = F.when(head, F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("line"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n\n")
    return marked.groupBy("page_id", "page_index").agg(listed.alias("body")).select("page_id", F.concat(F.lit("<!-- page "), F.coalesce(F.col("page_index").cast("string"), F.lit("?")), F.lit(" -->\n\n"), F.col("body")).alias("markdown"))


def write_deck(cards: DataFrame, path: str) -> None:
    """Flashcards as tab-separated files that card programs import."""
    flat = cards.select(*[F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in cards.columns])
    flat.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def ics_text(value: Column) -> Column:
    """Calendar text with its special characters escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for ch in ";,":
        out = F.replace(out, F.lit(ch), F.lit("\\" + ch))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def folded(line: str, octets: int = 73) -> str:
    """A calendar line folded so that no part has more bytes; characters stay whole."""
    parts, current, used = [], "", 0
    for ch in line:
        size = len(ch.encode())
        if used + size > octets:
            parts.append(current)
            current, used = " ", 1
        current += ch
        used += size
    return "\r\n".join([*parts, current])


def calendar(events: DataFrame) -> str:
    """iCalendar text of a schedule (uid, date, title): a plan of one learner, which the driver writes row by row, whole however long."""
    rows = events.select("uid", F.date_format("date", "yyyyMMdd").alias("day"), ics_text(F.col("title")).alias("title")).orderBy("day", "uid").toLocalIterator()
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//foliant//EN"]
    for r in rows:
        lines += ["BEGIN:VEVENT", f"UID:{r.uid}", f"DTSTART;VALUE=DATE:{r.day}", folded(f"SUMMARY:{r.title}"), "END:VEVENT"]
    return "\r\n".join([*lines, "END:VCALENDAR", ""])

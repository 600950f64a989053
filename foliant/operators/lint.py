"""Checks of single fields and questions of note blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import notes

#: Values that a field may have.
ALLOWED = {"type": "mcq tf numeric short cloze".split(), "bloom": "remember understand apply analyze evaluate create".split()}
#: Fields that must state something definite, that rest on the book, and that hold text of the learner.
DEFINITE = "type bloom term name title latex answer".split()
RESTING = "definition where holds-when what result step source".split()
#: Words that a reason must have, choices that a question needs, and how alike two texts are copies.
REASON_WORDS, LEAST_CHOICES, COPY_SHARE, COPY_LIKENESS = 3, 3, 0.8, 0.9
_ID = r"^[A-Z]{1,4}-[\w.-]+$"


def field_issues(blocks: DataFrame) -> DataFrame:
    """block_no, field_no and code of what is wrong with single fields.

    Codes: bad-value (not one of the field's values), unsure-not-allowed, unsure-reason (too short a reason), no-citation, bad-id (a covered id that is none),
    no-pair (a misconception without `Wrong: .. | Right: ..`). Null and blank values have no issue here. All checks are expressions over
    one row, so nothing is shuffled; a block handed in twice has its issues twice.
    """
    f = notes.fields(blocks).where("value IS NOT NULL AND trim(value) != ''").withColumn("v", F.trim("value"))
    unsure = F.startswith(F.upper("v"), F.lit("UNSURE"))
    reason = tx.count_of(F.regexp_replace("v", r"^[Uu][Nn][Ss][Uu][Rr][Ee][\s:]*", ""), r"\S+")
    cited = F.col("v").rlike(r"\[p\.?\s*[^\]]+\]")
    ids = F.transform(F.split(F.col("v"), ","), lambda i: F.trim(i))
    off_list: Column = F.lit(False)
    for key, values in ALLOWED.items():
        off_list = off_list | ((F.col("key") == key) & ~F.lower("v").isin(*values))
    checks = [
        F.when(unsure & F.col("key").isin(*DEFINITE), F.lit("unsure-not-allowed")),
        F.when(unsure & ~F.col("key").isin(*DEFINITE) & (reason < REASON_WORDS), F.lit("unsure-reason")),
        F.when(~unsure & off_list, F.lit("bad-value")),
        F.when(~unsure & F.col("key").isin(*RESTING) & ~cited, F.lit("no-citation")),
        F.when(~unsure & (F.col("key") == "covers") & F.exists(ids, lambda i: ~i.rlike(_ID)), F.lit("bad-id")),
        F.when(~unsure & (F.col("key") == "misconception") & ~F.col("v").rlike(r"(?is)^wrong:.*\|\s*right:"), F.lit("no-pair")),
    ]
    return f.select("block_no", "field_no", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("code"))


def block_issues(blocks: DataFrame) -> DataFrame:
    """block_no and code of what is wrong between the fields of a block: few-choices, same-choices (questions of choice), plain-copies-definition (concepts).

    Two choices are the same when their letters and digits are. An explanation copies when it is nearly as long as the quote of the definition and nearly the same.
    The first field of a key counts. Fields are one row of the block, so nothing is shuffled.
    """
    held = F.filter(
        F.transform("fields", lambda f: F.struct(tx.normal_key(f["key"]).alias("key"), F.trim(f["value"]).alias("value"))), lambda f: f["value"].isNotNull() & (f["value"] != "")
    )
    b = blocks.select("block_no", "kind", held.alias("held"))
    first = lambda key: F.get(F.transform(F.filter("held", lambda f: f["key"] == key), lambda f: f["value"]), F.lit(0))
    choices = F.transform(F.filter("held", lambda f: f["key"].rlike("^option [a-d]$")), lambda f: tx.letters_key(f["value"]))
    said = tx.letters_key(tx.strip_citations(first("plain")))
    quote = tx.letters_key(F.get(F.transform(tx.citations(first("definition")), lambda c: c["quote"]), F.lit(0)))
    n = lambda x: F.char_length(x)
    likeness = F.lit(1.0).cast("double") - F.levenshtein(said, quote) / F.greatest(n(said), n(quote))
    is_choice = (F.col("kind") == "question") & (F.lower(first("type")) == "mcq")
    copies = (F.col("kind") == "concept") & (said != "") & (quote != "") & (n(said) >= n(quote) * F.lit(COPY_SHARE).cast("double")) & (F.round(likeness, 9) >= COPY_LIKENESS)
    checks = [
        F.when(is_choice & (F.size(choices) < LEAST_CHOICES), F.lit("few-choices")),
        F.when(is_choice & (F.size(F.array_distinct(choices)) < F.size(choices)), F.lit("same-choices")),
        F.when(copies, F.lit("plain-copies-definition")),
    ]
    return b.select("block_no", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("code"))


def dead_links(blocks: DataFrame) -> DataFrame:
    """block_no and id of the covered ids that no block of the course has. Ids that are none are bad-id issues, not links; null courses have no links."""
    covered = notes.fields(blocks).where("key = 'covers' AND value IS NOT NULL").select("block_no", F.explode(F.split("value", ",")).alias("id"))
    wanted = covered.withColumn("id", F.trim("id")).where(F.col("id").rlike(_ID)).distinct().join(blocks.select("block_no", "course"), "block_no")
    return wanted.join(blocks.select("course", "id").distinct(), ["course", "id"], "left_anti").where("course IS NOT NULL").select("block_no", "id").distinct()

"""Note blocks: their text form, fields, citations and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import calc
from foliant.functions import text as tx

#: Fields of the note kinds as kind, key, least and most times (0 for any number), largest number of words (0 for any).
RULES = """
concept term 1 1 0 | concept definition 1 1 60 | concept plain 0 1 60 | concept example 0 0 60 | concept why 0 0 60 | concept misconception 0 0 80
formula source 0 0 60 | worked-example calc 0 0 0 | formula name 1 1 0 | formula latex 1 1 0 | formula where 0 0 60 | formula holds-when 0 0 60 | formula calc 0 0 0
worked-example title 1 1 0 | worked-example problem 1 1 120 | worked-example step 1 0 80 | worked-example result 1 1 60 | worked-example source 0 0 60
figure title 0 1 0 | figure what 1 1 60 | figure look-for 1 0 60 | figure source 0 0 60
question type 1 1 0 | question bloom 1 1 0 | question ask 1 1 60 | question answer 1 1 60 | question option a 0 1 40 | question option b 0 1 40
question option c 0 1 40 | question option d 0 1 40 | question why 0 0 60 | question covers 0 1 0
"""


def rules(spark: SparkSession) -> DataFrame:
    """The rules as a table: kind, key, least, most, words."""
    rows = []
    for entry in RULES.replace("\n", "|").split("|"):
        parts = entry.split()
        if parts:
            rows.append((parts[0], " ".join(parts[1:-3]), *map(int, parts[-3:])))
    return spark.createDataFrame(rows, "kind string, key string, least int, most int, words int")


def fields(blocks: DataFrame) -> DataFrame:
    """One row for every field: block_no, kind, field_no, key in normal form, value."""
    each = blocks.select("block_no", "kind", F.posexplode("fields").alias("field_no", "f"))
    return each.select("block_no", "kind", "field_no", tx.normal_key(F.col("f.key")).alias("key"), F.col("f.value").alias("value"))


def cited(fields_df: DataFrame) -> DataFrame:
    """One row for every citation of a field: block_no, field_no, n, page and quote."""
    each = fields_df.select("block_no", "field_no", F.posexplode(tx.citations(F.col("value"))).alias("n", "c"))
    return each.select("block_no", "field_no", "n", F.col("c.page").alias("page"), F.col("c.quote").alias("quote"))


def issues(blocks: DataFrame) -> DataFrame:
    """block_no, key and code of every broken rule: missing, too-many, unknown, empty, too-long.

    Rules are a small table that the fields are joined to, so a new kind of block is a new row, not new code.
    """
    rule = F.broadcast(rules(blocks.sparkSession))  # thirty rows
    f = fields(blocks)
    counted = f.groupBy("block_no", "kind", "key").agg(F.count("*").alias("n"))
    expected = blocks.select("block_no", "kind").join(rule, "kind")
    missing = expected.where("least > 0").join(counted.select("block_no", "key"), ["block_no", "key"], "left_anti").select("block_no", "key", F.lit("missing").alias("code"))
    judged = counted.join(rule, ["kind", "key"], "left")
    many = judged.where("most > 0 AND n > most").select("block_no", "key", F.lit("too-many").alias("code"))
    known_kinds = rule.select("kind").distinct()
    unknown = judged.where("least IS NULL AND key IS NOT NULL").join(known_kinds, "kind", "left_semi").select("block_no", "key", F.lit("unknown").alias("code"))
    empty = f.where("value IS NULL OR trim(value) = ''").select("block_no", "key", F.lit("empty").alias("code")).distinct()
    words = tx.count_of(tx.strip_citations(F.col("value")), r"\S+")
    long = f.join(rule.where("words > 0"), ["kind", "key"]).where(words > F.col("words")).select("block_no", "key", F.lit("too-long").alias("code")).distinct()
    return missing.unionByName(many).unionByName(unknown).unionByName(empty).unionByName(long)


def formula_issues(fields_df: DataFrame) -> DataFrame:
    """block_no, field_no and whether the latex field can be set."""
    return fields_df.where("key = 'latex' AND value IS NOT NULL").select("block_no", "field_no", tx.latex_ok(F.col("value")).alias("ok"))


def answer_issues(blocks: DataFrame) -> DataFrame:
    """block_no, type, answer and validity of questions: a letter of an option that is there, true or false, or anything for the other types.

    Validity is null where a reader has to judge (short answers) or the type is missing.
    """
    f = fields(blocks.where("kind = 'question'")).where("value IS NOT NULL")
    first = lambda key: F.min_by(F.when(F.col("key") == key, F.trim("value")), F.when(F.col("key") == key, F.col("field_no")))
    options = F.array_sort(F.collect_set(F.when(F.col("key").rlike("^option [a-d]$"), F.upper(F.substring("key", 8, 1)))))
    q = f.groupBy("block_no").agg(first("type").alias("type"), first("answer").alias("answer"), options.alias("options"))
    letter = F.upper(F.substring("answer", 1, 1))
    valid = (
        F.when(F.col("type") == "mcq", F.array_contains("options", letter) & (F.char_length("answer") == 1))
        .when(F.col("type") == "tf", F.lower("answer").isin("true", "false"))
        .when(F.col("type").isin("numeric", "cloze"), F.col("answer") != "")
    )
    return q.select("block_no", "type", "answer", F.array_join("options", "").alias("options"), valid.alias("valid"))


def parse_notes(files: DataFrame) -> DataFrame:
    """Fields of note files (file, text): block, kind, id, field_no, key, value, line.

    A block runs from `::: kind id` to `:::`; `key: value` starts a field and other lines continue it; lines in <!-- --> are left out. Block numbers are a
    running sum of openings over the file's lines.
    """
    lines = files.where("text IS NOT NULL").select("file", F.posexplode(F.split(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), "\r?\n")).alias("line", "raw"))
    w = Window.partitionBy("file").orderBy("line")
    opening = F.col("raw").rlike(r"^:::\s*\S")
    closing = F.col("raw").rlike(r"^:::\s*$")
    marked = lines.withColumn("block", F.sum(opening.cast("int")).over(w)).withColumn("closed", F.sum(closing.cast("int")).over(w))
    shape = r"^([\p{L}][\p{L}\p{N} _-]{0,30}):\s?(.*)$"
    inner = marked.where((F.col("block") > F.col("closed")) & ~opening & ~closing & (F.trim("raw") != ""))
    heads = marked.where(opening).select("file", "block", F.regexp_extract("raw", r"^:::\s*(\S+)", 1).alias("kind"), F.regexp_extract("raw", r"^:::\s*\S+\s+(\S+)", 1).alias("id"))
    starts = F.col("raw").rlike(shape)
    in_block = Window.partitionBy("file", "block").orderBy("line")
    numbered = inner.withColumn("field", F.sum(starts.cast("int")).over(in_block)).where("field > 0")
    part = F.when(starts, F.regexp_extract("raw", shape, 2)).otherwise(F.trim("raw"))
    grouped = numbered.withColumn("part", part).withColumn("key", F.when(starts, F.regexp_extract("raw", shape, 1)))
    made = grouped.groupBy("file", "block", "field").agg(
        F.max("key").alias("key"), F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part"))), lambda x: x["part"]), "\n").alias("value")
    )
    return made.join(heads, ["file", "block"]).select("file", "block", "kind", "id", (F.col("field") - 1).alias("field_no"), tx.normal_key(F.col("key")).alias("key"), F.trim("value").alias("value"), "line")


def render_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in their text form, which parse_notes() reads: block_no and text."""
    each = F.transform("fields", lambda f: F.concat_ws(": ", f["key"], F.coalesce(f["value"], F.lit(""))))
    head = F.concat(F.lit("::: "), F.coalesce("kind", F.lit("")), F.lit(" "), F.coalesce("id", F.lit("")))
    return blocks.select("block_no", F.concat_ws("\n", F.trim(head), F.array_join(each, "\n"), F.lit(":::")).alias("text"))


def cards(blocks: DataFrame) -> DataFrame:
    """Flashcards of concepts and questions: block_no, front and back, without citations."""
    f = fields(blocks).where("value IS NOT NULL")
    first = lambda key: F.min_by(F.when(F.col("key") == key, F.col("value")), F.when(F.col("key") == key, F.col("field_no")))
    wide = f.groupBy("block_no", "kind").agg(*[first(k).alias(k) for k in ("term", "definition", "ask", "answer")])
    concept = wide.where("kind = 'concept'").select("block_no", F.col("term").alias("front"), F.col("definition").alias("back"))
    question = wide.where("kind = 'question'").select("block_no", F.col("ask").alias("front"), F.col("answer").alias("back"))
    both = concept.unionByName(question).select("block_no", tx.strip_citations(F.col("front")).alias("front"), tx.strip_citations(F.col("back")).alias("back"))
    return both.where("front != '' AND back != ''")


def calculations(blocks: DataFrame) -> DataFrame:
    """block_no, field_no, ok and problem of every calculation line, run block by block in field order, so that a line knows the names of those before it.

    A block's fields are one row, so nothing is shuffled. Null values are no lines; blocks without any give no row; a block handed in twice is run twice.
    """
    numbered = F.transform("fields", lambda f, i: F.struct(i.alias("field_no"), tx.normal_key(f["key"]).alias("key"), f["value"].alias("value")))
    lines = F.filter(numbered, lambda f: (f["key"] == "calc") & f["value"].isNotNull())
    held = blocks.select("block_no", lines.alias("lines")).where(F.size("lines") > 0)
    run = held.withColumn("results", calc.calc_results(F.transform("lines", lambda f: f["value"])))
    each = run.select("block_no", F.explode(F.arrays_zip("lines", "results")).alias("z"))
    return each.select("block_no", F.col("z.lines.field_no").alias("field_no"), F.col("z.results.ok").alias("ok"), F.col("z.results.problem").alias("problem"))

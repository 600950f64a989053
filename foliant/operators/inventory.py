"""Key items of books: terms, their first uses, links between books, numbered exercises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators.structure import page_lines
from foliant.plans.shapes import top_k

#: Phrases that define a term, by language, as (a part that each match holds, pattern whose group is the term). Both regular-expression dialects of the SQL engines read them.
DEFINING = {
    "en-called": ("called", r"\bis called (?:the |an? )?([a-z][a-z -]{2,40}[a-z])"),
    "en-known": ("known as", r"\bknown as (?:the |an? )?([a-z][a-z -]{2,40}[a-z])"),
    "en-define": ("efine the", r"\b[Ww]e define the ([a-z][a-z -]{2,40}?[a-z]) as "),
    "en-defined": ("defined as", r"\b(?:The|An?) ([a-z][a-z -]{2,40}?[a-z]) is defined as\b"),
    "en-mean": ("we mean", r"\bBy (?:the |an? )?([a-z][a-z -]{2,40}?[a-z]) we mean\b"),
    "en-term": ("term", r"\b[Tt]he term “([^”\n]{3,40})” (?:means|denotes|refers)\b"),
    "de-nennt": ("nennt", r"\bnennt (?:man )?(?:die|den|das) ([A-ZÄÖÜ][\p{L}]{2,40})[ .]"),
    "de-versteht": ("versteht man", r"[Uu]nter (?:der |dem |einer |einem )?([A-ZÄÖÜ][\p{L} -]{2,40}?) versteht man"),
    "de-bezeichnet": ("bezeichnet man als", r"bezeichnet man als ([A-ZÄÖÜ][\p{L}-]{2,40})"),
    "de-heißt": ("heißt", r"\bheißt (?:die |der |das )?([A-ZÄÖÜ][\p{L}-]{2,40})[ .,]"),
    "fr-définir": ("définir", r"\bdéfinir (?:le|la|l’) ?([a-zà-ÿ]{3,40})"),
    "fr-appelle": ("appelle", r"\b[Oo]n appelle (?:le |la |l’|une? )?([a-zà-ÿ][a-zà-ÿ -]{2,40}?)[ ,.]"),
    "fr-désigne": ("désigne", r"\bLe terme « ([^»\n]{3,40}) » désigne"),
    "es-definir": ("definir", r"\bdefinir (?:el|la) ([a-zá-ú]{3,40})"),
    "es-llama": ("llama", r"\b[Ss]e llama (?:el |la |una? )?([a-zá-úñ]{3,40})"),
    "es-denomina": ("denomina", r"\b[Ss]e denomina (?:el |la |una? )?([a-zá-úñ]{3,40})"),
    "es-entiende": ("entiende por", r"\b[Ss]e entiende por (?:el |la )?([a-zá-úñ]{3,40})"),
    "ru-что": ("что такое", r"что такое ([а-яё][а-яё -]{2,40})[.?,]"),
    "ru-называется": ("называется", r"называется ([а-яё][а-яё-]{2,40})"),
    "ru-называют": ("называют", r"называют ([а-яё][а-яё-]{2,40})"),
    "zh-定义": ("的定义", r"(?:写出|给出|理解)([一-龥]{2,12})的定义"),
    "zh-称为": ("称为", r"称为([一-龥]{2,12})[。，；]"),
    "zh-叫做": ("叫做", r"叫做([一-龥]{2,12})[。，；]"),
    "zh-是指": ("是指", r"(?:^|[。！？\n])([一-龥]{2,12})是指"),
    "ja-定義": ("の定義", r"(?:では|[。、\n])([ぁ-ヿ一-龥ー]{2,20})の定義"),
    "ja-とは": ("とは", r"(?:^|[。、\n])([ァ-ヿ一-龥ー]{2,20})とは"),
    "ja-呼ぶ": ("と呼", r"[をは、]([ァ-ヿ一-龥ー]{2,20})と呼[ぶば]"),
    "hi-परिभाषा": ("की परिभाषा", r"में ([\p{L}\p{M} ]{3,40}?) की परिभाषा"),
    "hi-कहते": ("कहते हैं", r"को ([\p{L}\p{M} ]{3,40}?) कहते हैं"),
    "ar-ذكر": ("ذكر", r"ذكر ([\p{L}\p{M} ]{3,40}?) مع"),
    "ar-يسمى": ("يسمى", r"يسمى ([\p{L}\p{M}]{3,40})"),
    "ar-يعرف": ("بأنه", r"يعرف ([\p{L}\p{M} ]{3,40}?) بأنه"),
    "th-อธิบาย": ("อธิบาย", r"อธิบาย([ก-๙]{3,40}?)ก็พอ"),
    "th-เรียกว่า": ("เรียกว่า", r"เรียกว่า([ก-๙]{3,40})"),
}


def term_ok(term: Column) -> Column:
    """A term has at most 60 characters and six words, starts with a letter, and is no label."""
    return (F.char_length(term) <= 60) & (tx.count_of(term, r"\S+") <= 6) & term.rlike(r"^\p{L}") & ~term.rlike(r"(?i)^(?:figure|table|chapter|section|example|equation)\b")


def defined_terms(pages: DataFrame) -> DataFrame:
    """page_id, book, page_index, term and key of every definition that the defining phrases find."""
    # one scan; a pattern runs only over texts that hold its fixed part
    none = F.array().cast("array<string>")
    every = [F.when(F.contains("text", F.lit(part)), F.regexp_extract_all("text", F.lit(pattern), 1)).otherwise(none) for part, pattern in DEFINING.values()]
    found = pages.where("text IS NOT NULL").select("page_id", "book", "page_index", F.explode(F.concat(*every)).alias("term"))
    named = found.withColumn("term", tx.one_line(F.col("term"))).where(term_ok(F.col("term")))
    return named.withColumn("key", tx.letters_key(F.col("term")))


def first_uses(terms: DataFrame) -> DataFrame:
    """The first definition of every term in each book: book, key, term, page_index and number of definitions."""
    w = Window.partitionBy("book", "key")
    order = w.orderBy(F.col("page_index").asc_nulls_last(), "page_id", "term")
    numbered = terms.withColumn("n", F.row_number().over(order)).withColumn("uses", F.count("*").over(w))
    return numbered.where("n = 1").select("book", "key", "term", "page_index", "uses")


def term_owners(firsts: DataFrame, books: DataFrame) -> DataFrame:
    """Owner of every term: of the books that define it the one that was added first, then by name."""
    dated = firsts.join(books.select("book", "added_on").distinct(), "book", "left")
    order = Window.partitionBy("key").orderBy(F.col("added_on").asc_nulls_last(), "book")
    return dated.withColumn("n", F.row_number().over(order)).where("n = 1").select("key", F.col("book").alias("owner"))


def book_links(firsts: DataFrame, owners: DataFrame, least: int = 2) -> DataFrame:
    """book, owner and weight: how many terms a book uses that another owns, from `least` on."""
    used = firsts.select("book", "key").join(owners, "key").where("book != owner")
    return used.groupBy("book", "owner").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def accept_in_order(numbers: Column) -> Column:
    """Of an array of whole numbers those that continue the count from 1: each accepted one is the last accepted plus one."""
    return F.aggregate(numbers, F.array().cast("array<int>"), lambda acc, n: F.when(n == F.size(acc) + 1, F.concat(acc, F.array(n))).otherwise(acc))


def exercises(pages: DataFrame) -> DataFrame:
    """page_id and how many numbered items (`3. ..`) of a page continue the count."""
    hits = page_lines(pages).where(F.col("line").rlike(r"^[0-9]{1,3}\. "))
    numbers = hits.select("page_id", "line_no", F.regexp_extract("line", r"^([0-9]{1,3})\. ", 1).cast("int").alias("n"))
    listed = numbers.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "n"))).alias("items"))
    return listed.select("page_id", F.size("items").alias("numbered"), F.size(accept_in_order(F.transform("items", lambda x: x["n"]))).alias("accepted"))


#: Opposite beginnings of words.
OPPOSITES = [("internal", "external"), ("initial", "final"), ("local", "global"), ("partial", "total"), ("average", "marginal"), ("absolute", "relative")]


def confusable_terms(firsts: DataFrame, per_book: int = 5) -> DataFrame:
    """Pairs of terms of a book that learners may confuse: opposite first words (rank 1) or the same last word (rank 2).

    Terms meet by their last word only, never all with all.
    """
    t = firsts.select("book", "term", F.element_at(F.split("term", " "), -1).alias("last"), F.element_at(F.split("term", " "), 1).alias("first"))
    t = t.where("term != last")
    a, b = (t.select("book", "last", F.col("term").alias(f"term_{x}"), F.col("first").alias(f"first_{x}")) for x in "ab")
    pairs = a.join(b, ["book", "last"]).where("term_a < term_b")
    opposite = F.lit(False)
    for x, y in OPPOSITES:
        opposite = opposite | ((F.col("first_a") == x) & (F.col("first_b") == y)) | ((F.col("first_a") == y) & (F.col("first_b") == x))
    ranked = pairs.withColumn("reason", F.when(opposite, 1).otherwise(2))
    return top_k(ranked, ["book"], [F.col("reason"), F.col("term_a"), F.col("term_b")], per_book).select("book", "term_a", "term_b", "reason", "rank")

"""Rankings by weighted signals, and language votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx

#: Weights of the signals of study priority.
WEIGHTS = {"past": 3.0, "objectives": 1.0, "exercises": 1.0, "reuse": 0.8, "terms": 0.5, "boxed": 0.4}


def weighted_score(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """score: each signal divided by its largest value (0 where that is 0), weighted and added."""
    total: Column = F.lit(0.0).cast("double")
    tops = df.agg(F.struct(*[F.max(c).alias(c) for c in weights])).scalar()  # all of them in one pass
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c) / F.nullif(tops[c], F.lit(0)), F.lit(0.0)) * F.lit(w).cast("double")
    return df.withColumn("score", F.round(total, 6))


def stars(df: DataFrame, order: list[Column], high: float = 0.3, middle: float = 0.7) -> DataFrame:
    """rank and stars: 3 for the first 30 %, 2 to 70 %, 1 below, rounded half to even.

    Ranks of all rows need one order over the table; the rows ranked here are books or sections, not pages.
    """
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    n = df.agg(F.count("*")).scalar()
    three = F.col("rank") <= F.bround(n * F.lit(high).cast("double"))
    two = F.col("rank") <= F.bround(n * F.lit(middle).cast("double"))
    return ranked.withColumn("stars", F.when(three, 3).when(two, 2).otherwise(1))


def book_signals(books: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Signals of every book: quotes that cite it (past), numbered items (exercises), distinct long words (terms), repeated captions (boxed), pages."""
    past = checks.groupBy("book").agg(F.count("*").alias("past"))
    text = pages.where("text IS NOT NULL")
    per_page = text.groupBy("book").agg(
        F.count_distinct("page_index").alias("pages"),
        F.sum(tx.count_of(F.col("text"), r"(?m)^[0-9]{1,3}\. ")).alias("exercises"),
        F.sum(tx.count_of(F.col("text"), r"(?m)^Figure [0-9]")).alias("boxed"),
        F.sum(tx.count_of(F.col("text"), r"\?")).alias("objectives"),
    )
    words = text.select("book", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{9,}"), 0))).alias("word")).distinct()
    terms = words.groupBy("book").agg(F.count("*").alias("terms"))
    shared = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").select("word")
    reuse = words.join(shared, "word").groupBy("book").agg(F.count("*").alias("reuse"))
    out = books.select("book").distinct()
    for part in (past, per_page, terms, reuse):
        out = out.join(part, "book", "left")
    return out.select("book", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", *WEIGHTS)])


def priority_plan(books: DataFrame, pages: DataFrame, checks: DataFrame) -> DataFrame:
    """Books by study priority with score, rank, stars and minutes (7 for each page, at least 15; by stars times 1.2, 1 or 0.7)."""
    scored = weighted_score(book_signals(books, pages, checks), WEIGHTS)
    ranked = stars(scored, [F.col("score").desc(), F.col("book")])
    factor = F.when(F.col("stars") == 3, 1.2).when(F.col("stars") == 2, 1.0).otherwise(0.7).cast("double")
    minutes = F.bround(F.greatest(F.lit(15), F.col("pages") * 7).cast("double") * factor).cast("long")
    return ranked.select("book", "score", "rank", "stars", "pages", minutes.alias("minutes"))


#: Frequent words by language.
STOP_WORDS = {
    "en": "the and of to in is that for was with as on are by",
    "de": "der die das und ist von den mit wird sich für als über im",
    "fr": "le la les et des est une du pour dans que après on de",
    "es": "el la los una que por con del para más se no como en",
}
#: Scripts that decide a language by themselves, as (language, characters, weight of one character).
SCRIPTS = [
    ("ja", r"[\x{3040}-\x{30FF}]", 3), ("zh", r"[\x{4E00}-\x{9FFF}]", 1), ("ru", r"[\x{0400}-\x{04FF}]", 1),
    ("ar", r"[\x{0600}-\x{06FF}]", 1), ("hi", r"[\x{0900}-\x{097F}]", 1), ("th", r"[\x{0E00}-\x{0E7F}]", 1),
]


def _listed(words: str):
    known = words.split()
    return lambda w: w.isin(*known)


def language_vote(documents: DataFrame) -> DataFrame:
    """doc_id and language by script, else by votes of frequent words; English where nothing votes. Ties go to the earlier language of the list."""
    text = F.coalesce("text", F.lit(""))
    latin = tx.count_of(text, r"[A-Za-zÀ-ÿ]")
    best = F.greatest(*[F.struct((tx.count_of(text, p) * w).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")) for i, (lang, p, w) in enumerate(SCRIPTS)])
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), 0)
    votes = []
    for i, (lang, stop) in enumerate(STOP_WORDS.items()):
        n = F.size(F.filter(words, _listed(stop)))
        votes.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")))
    vote = F.greatest(*votes)
    by_script = (best["n"] > 0) & (best["n"] * 2 > latin)
    return documents.select("doc_id", F.when(by_script, best["lang"]).when(vote["n"] > 0, vote["lang"]).otherwise("en").alias("language"))

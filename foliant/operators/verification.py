"""Planting false statements, scoring checkers by them, and rolling results up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.plans.shapes import hash_uniform, split_row_number
from foliant.session import broadcast_if_small, ensure_checkpoint_dir

#: Words and their opposites, by language, in order of use.
ANTONYMS = {
    "en": [("larger", "smaller"), ("increases", "decreases"), ("always", "never"), ("before", "after"), ("outside", "inside"), ("first", "last"), ("every", "no")],
    "de": [("größer", "kleiner"), ("immer", "nie"), ("vor", "nach"), ("länger", "kürzer"), ("zunimmt", "abnimmt")],
    "fr": [("augmente", "diminue"), ("toujours", "jamais"), ("avant", "après"), ("plus", "moins")],
    "es": [("aumenta", "disminuye"), ("siempre", "nunca"), ("antes", "después"), ("más", "menos")],
}


def changed_number(number: Column) -> Column:
    """Another number: the last two digits exchanged where they differ, else the last digit raised by one (9 becomes 8)."""
    last, before = F.substring(number, -1, 1), F.substring(number, -2, 1)
    body = F.regexp_replace(number, r"..$", "")
    swapped = F.concat(body, last, before)
    bumped = F.concat(F.regexp_replace(number, r".$", ""), F.when(last == "9", "8").otherwise((last.cast("int") + 1).cast("string")))
    return F.when((F.char_length(number) >= 2) & (last != before), swapped).otherwise(bumped)


def false_numbers(claims: DataFrame, claim_id: str, text: str, context: str) -> DataFrame:
    """Claims with their first number changed: id, number, changed and mutated. Those whose context holds the changed number are left out."""
    number = F.regexp_extract(text, r"([0-9]+)", 1)
    c = claims.where(F.col(text).isNotNull()).withColumn("number", number).where("number != ''").withColumn("changed", changed_number(F.col("number")))
    mutated = F.concat(F.regexp_extract(text, r"^([^0-9]*)", 1), F.col("changed"), F.regexp_extract(text, r"^[^0-9]*[0-9]+((?s).*)$", 1))
    kept = c.where(~F.coalesce(F.contains(F.col(context), F.col("changed")), F.lit(False)))
    return kept.select(claim_id, "number", "changed", mutated.alias("mutated"))


def false_words(claims: DataFrame, claim_id: str, text: str) -> DataFrame:
    """Claims with the first word of the opposites table exchanged: id, word, opposite and mutated. The table's order decides, words match whole."""
    pairs = [(a, b) for table in ANTONYMS.values() for x, y in table for a, b in ((x, y), (y, x))]
    bounded = lambda w: rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"
    choice, mutated = F.lit(None).cast("string"), F.lit(None).cast("string")
    opposite = F.lit(None).cast("string")
    for a, b in reversed(pairs):
        hit = F.col(text).rlike(bounded(a))
        choice, opposite = F.when(hit, F.lit(a)).otherwise(choice), F.when(hit, F.lit(b)).otherwise(opposite)
        mutated = F.when(hit, F.regexp_replace(text, bounded(a), b)).otherwise(mutated)
    return claims.select(claim_id, choice.alias("word"), opposite.alias("opposite"), mutated.alias("mutated")).where("word IS NOT NULL")


def batches(claims: DataFrame, keys: list[str], order: list[Column], size: int = 12, span: int = 1 << 16) -> DataFrame:
    """Claims in batches of fixed size within each group: batch number and place, both from 1. The first column of the order is a whole number, rising.

    Spans of that number are counted apart, so that a group as large as a third of all claims is no single task.
    """
    each = split_row_number(claims, keys, F.floor(order[0] / span), order, "n")
    return each.withColumn("batch", F.ceil(F.col("n") / size).cast("int")).withColumn("place", ((F.col("n") - 1) % size + 1).cast("int")).drop("n")


def batch_scores(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Planted, caught and rejected of every batch. judged has planted and verdict_true; a batch with a planted claim held true is rejected whole."""
    planted = F.col("planted")
    return judged.groupBy(*keys).agg(
        F.count("*").alias("claims"),
        F.sum(planted.cast("int")).alias("planted"),
        F.sum((planted & ~F.col("verdict_true")).cast("int")).alias("caught"),
        F.bool_or(planted & F.col("verdict_true")).alias("rejected"),
    )


def status_rollup(statuses: DataFrame, key: str = "book", status: str = "status") -> DataFrame:
    """Counts of every status by group and over all (null group) in one pass over the data."""
    return statuses.groupingSets([[F.col(key), F.col(status)], [F.col(status)]], key, status).agg(F.count("*").alias("n"))


def mismatched(claims: DataFrame, claim_id: str, key: str, contexts: DataFrame, context_id: str, context_key: str, most: float = 0.2, seed: int = 0) -> DataFrame:
    """For each claim one context that shares less than a share of its three-grams, chosen by hash.

    Every claim is tried against a few hashed contexts, so that the work grows with the claims and not with all pairs. Claims that none of these fits
    are tried against further blocks of contexts, each eight times as large, until every claim has one or all contexts were tried.
    """
    ensure_checkpoint_dir(claims.sparkSession)
    tries, width = 8, 64
    u = hash_uniform(F.col(context_id), seed=seed)
    slots = contexts.select(context_id, context_key, F.pmod(F.xxhash64(context_id), F.lit(width)).alias("slot"))
    one = slots.groupBy("slot").agg(F.min(F.struct(u.alias("u"), F.col(context_id).alias("id"), F.col(context_key).alias("k"))).alias("c"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(key) - 2), lambda i: F.substring(F.col(key), i, F.lit(3))))
    shared = F.size(F.filter("grams", lambda g: F.contains(F.col("c.k"), g))) / F.size("grams")
    asked = claims.where(F.char_length(key) >= 3).select(claim_id, grams.alias("grams"))

    def fits(both: DataFrame, order: str) -> DataFrame:
        # explode, as a filter on a plain column would compute it twice
        fit = both.select("*", F.explode(F.array(shared)).alias("shared")).where(F.col("shared") < most)
        best = fit.groupBy(claim_id).agg(F.min(F.struct(order, F.col("c.id").alias("id"), "shared")).alias("b"))
        return best.select(claim_id, F.col("b.id").alias(context_id), F.round("b.shared", 6).alias("shared"))

    wanted = asked.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.pmod(F.xxhash64(F.col(claim_id)) + i * 7, F.lit(width)))).alias("slot"))
    found = fits(wanted.join(F.broadcast(one), "slot"), "slot").checkpoint()  # at most 64 contexts
    left = asked.join(found.select(claim_id), claim_id, "left_anti").checkpoint()
    total, low, size = 0, 0.0, width
    while low < 1 and left.count():
        total = total or contexts.count()
        high = low + size / max(total, 1)
        block = contexts.where((u >= low) & (u < high) if high < 1 else u >= low)
        block = block.select(u.alias("u"), F.struct(F.col(context_id).alias("id"), F.col(context_key).alias("k")).alias("c"))
        more = fits(block.crossJoin(broadcast_if_small(left)), "u").checkpoint()
        found = found.unionByName(more)
        left = left.join(more.select(claim_id), claim_id, "left_anti").checkpoint()
        low, size = high, size * 8
    return found


def claim_ids(location: Column, text: Column, quotes: Column) -> Column:
    """Stable id of a claim: C and ten hex digits of the hash of its place, text and quotes."""
    return F.concat(F.lit("C"), tx.short_hash(F.concat_ws("|", location, text, quotes)))

"""Mixing sources to target shares of tokens by hash-seeded Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import tokens as tok
from foliant.session import broadcast_if_small, ensure_checkpoint_dir, stable_hash

#: Bits of a document's draw.
DRAW_BITS = 52


def source_key(source: Column) -> Column:
    """Sources spelled with other case or outer white space are the same; blank is null."""
    key = F.lower(F.trim(F.regexp_replace(source, r"\s+", " ")))
    return F.when(key != "", key)


def poisson_terms(mu: float, cap: int) -> list[float]:
    """Probabilities of 0, 1, .. cap - 1 events at mean mu, by logarithms, so that no mean is too large."""
    if mu <= 0:
        return [1.0, *[0.0] * (cap - 1)][:cap]
    return [math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(cap)]


def capped_poisson_mean(mu: float, cap: int) -> float:
    """Mean of min(Poisson(mu), cap)."""
    terms = poisson_terms(mu, cap)
    return sum(k * p for k, p in enumerate(terms)) + cap * max(0.0, 1.0 - math.fsum(terms))


def capped_poisson_cumulative(rate: float | None, cap: int | None) -> list[float] | None:
    """Probabilities of at most 0, 1, .. cap - 1 repeats, for repeats min(Poisson(mu), cap) whose mean is rate."""
    if rate is None or cap is None or rate <= 0 or cap <= 0:
        return None
    if rate >= cap:
        return [0.0] * cap
    low, high = 0.0, float(cap)
    while capped_poisson_mean(high, cap) < rate and high < 1e9:
        low, high = high, 2 * high
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if capped_poisson_mean(mid, cap) < rate else (low, mid)
    out, total = [], 0.0
    for p in poisson_terms(high, cap):
        total += p
        out.append(min(1.0, total))
    return out


def source_rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Rate of repetition of every target source.

    sizes: source, n_docs, n_tokens. targets: source, target_share, max_repeats. A source that has no tokens cannot
    contribute; the shares of the others are scaled to sum 1. Without total_tokens the mix is as large as it can be
    with every source at its share: the smallest max_repeats * n_tokens / share. A larger total_tokens leaves sources that
    reach max_repeats below their share.
    """
    goal = targets.select(
        source_key(targets["source"]).alias("source"),
        F.col("target_share").cast("double").alias("target_share"),
        F.col("max_repeats").cast("int").alias("max_repeats"),
    ).where("source IS NOT NULL")
    goal = goal.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    usable = F.col("n_tokens").isNotNull() & (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    both = goal.join(sizes, "source", "left").withColumn("share", F.when(usable, F.col("target_share")))
    every = Window.partitionBy(F.lit(1))  # one row for each target
    both = both.withColumn("share", F.col("share") / F.sum("share").over(every))  # null stays null
    most = F.col("max_repeats") * F.col("n_tokens") / F.col("share")
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.min(most).over(every)
    rate = F.least(F.col("max_repeats").cast("double"), F.col("share") * total / F.col("n_tokens"))
    return both.withColumn("rate", F.when(F.col("share").isNotNull(), rate))


def _steps(rate: Column, cap: Column) -> Column:
    """capped_poisson_cumulative() of two columns."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(rates, caps):
        import pandas as pd

        bound = [None if pd.isna(c) else int(c) for c in caps]
        return pd.Series([capped_poisson_cumulative(None if pd.isna(r) else float(r), c) for r, c in zip(rates, bound)], dtype=object)

    return run(rate, cap)


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, id and text."""
    bits = F.shiftrightunsigned(stable_hash(doc_id, text, seed=seed), 64 - DRAW_BITS)
    return bits / F.lit(float(1 << DRAW_BITS))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tokenizer: str = tok.TOKENIZER,
    tokenizer_dir: str = tok.TOKENIZER_DIR,
) -> tuple[DataFrame, DataFrame]:
    """(report, repeats): the shares reached by each target source, and each used document with its number of copies.

    The number of copies is an inverted Poisson distribution cut at max_repeats whose mean is the source's rate, at a draw that is a hash of
    the seed, the document's id and its text: a document's draw does not depend on other documents, and no source is ranked or brought together. Shares are reached within the
    chance of the draws, which falls with the square root of a source's documents; the report says what came out. Documents without text or without a target source are never used; repeated rows
    have the same draw, rows of one id with other texts draws of their own. Empty tables give empty results, sources without documents a report row of zeros.
    """
    path = tok.vocabulary_path(tokenizer, tokenizer_dir)
    sized = (
        documents.select(
            documents[id_col].alias("doc_id"),
            source_key(documents[source_col]).alias("source"),
            documents[text_col].alias("text"),
        )
        .where("source IS NOT NULL AND text IS NOT NULL AND text != ''")
        .join(broadcast_if_small(targets.select(source_key(targets["source"]).alias("source")).distinct()), "source", "left_semi")
        .select("doc_id", "source", _draw(F.col("doc_id"), F.col("text"), seed).alias("u"), tok.token_count(F.col("text"), path).alias("n_tokens"))
    )
    ensure_checkpoint_dir(documents.sparkSession)
    sized = sized.checkpoint()  # tokens are counted once; two results read them
    rates = source_rates(sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), targets, total_tokens)
    plan = rates.select("source", "rate", "max_repeats", _steps(F.col("rate"), F.col("max_repeats")).alias("steps"))

    draws = sized.join(broadcast_if_small(plan.where("rate > 0")), "source")
    repeats = draws.withColumn("copies", F.size(F.filter("steps", lambda c: c <= F.col("u")))).where("copies > 0")
    repeats = repeats.select("doc_id", "source", "n_tokens", "copies")

    reached = repeats.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_out"),
        F.sum("copies").alias("rows_out"),
        F.max("copies").alias("most_repeats"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = rates.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), "rate", zero("rows_out"), zero("tokens_out"), zero("most_repeats")
    )
    share = F.col("tokens_out") / F.nullif(F.sum("tokens_out").over(Window.partitionBy(F.lit(1))), F.lit(0))
    return report.withColumn("reached_share", F.coalesce(share, F.lit(0.0))), repeats


def shuffled_copies(repeats: DataFrame, seed: int = 0) -> DataFrame:
    """One row for every copy in one global order by hash: range partitions in order, each sorted within."""
    copies = repeats.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no")).drop("copies")
    return copies.withColumn("shuffle_key", stable_hash("doc_id", "copy_no", seed=seed + 3)).orderBy("shuffle_key", "doc_id", "copy_no")

"""Claims of notes: what they state, on which evidence, and how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions import titles as ti
from foliant.operators import notes
from foliant.operators.verification import claim_ids

#: Fields of notes that state something about the book.
CLAIM_KEYS = ("definition", "plain", "example", "why", "where", "holds-when", "what", "result", "step")


def claims(blocks: DataFrame) -> DataFrame:
    """claim_id, block_no, field_no, key, claim, quotes and whether the claim says no more than its first quote. UNSURE values state nothing."""
    f = notes.fields(blocks).where(F.col("key").isin(*CLAIM_KEYS) & F.col("value").isNotNull())
    text = tx.strip_citations(F.col("value"))
    quotes = F.transform(tx.citations(F.col("value")), lambda c: c["quote"])
    stated = f.where(~tx.is_unsure(F.col("value"))).withColumn("claim", text).where("claim != ''").withColumn("quotes", quotes)
    place = F.concat_ws("#", F.col("block_no"), F.col("key"), F.col("field_no"))
    stated = stated.withColumn("claim_id", claim_ids(place, F.col("claim"), F.array_join("quotes", "|")))
    return stated.withColumn("verbatim", ti.is_verbatim(F.col("claim"), F.get("quotes", F.lit(0)))).select("claim_id", "block_no", "field_no", "key", "claim", "quotes", "verbatim")


def claim_issues(claims_df: DataFrame) -> DataFrame:
    """claim_id and code of what is wrong with a claim by itself: no-citation, quote-short, says-nothing (explanations only)."""
    c = claims_df
    none = c.where(F.size("quotes") == 0).select("claim_id", F.lit("no-citation").alias("code"))
    short = c.where(F.exists("quotes", lambda q: ~ti.long_enough(q))).select("claim_id", F.lit("quote-short").alias("code"))
    empty = c.where((F.col("key") == "why") & ti.says_nothing(F.col("claim"))).select("claim_id", F.lit("says-nothing").alias("code"))
    return none.unionByName(short).unionByName(empty)


def worst_of(statuses: Column) -> Column:
    """The worst of an array of statuses, ordered ok, pending, warn; null for an empty one."""
    rank = F.transform(statuses, lambda s: F.when(s == "warn", 2).when(s == "pending", 1).otherwise(0))
    return F.element_at(F.array(F.lit("ok"), F.lit("pending"), F.lit("warn")), F.array_max(rank) + 1)


def block_trust(claims_df: DataFrame, issues: DataFrame) -> DataFrame:
    """block_no, status (the worst of its claims: warn with an issue, ok when verbatim, else pending) and number of claims."""
    flagged = issues.select("claim_id").distinct().withColumn("flagged", F.lit(True))
    status = F.when(F.col("flagged"), "warn").when(F.col("verbatim"), "ok").otherwise("pending")
    each = claims_df.join(flagged, "claim_id", "left").withColumn("status", status)
    return each.groupBy("block_no").agg(worst_of(F.collect_set("status")).alias("status"), F.count("*").alias("claims"))


def ratios(counts: DataFrame, parts: list[str], whole: str) -> DataFrame:
    """Shares of columns in another one, null where that is 0."""
    return counts.select("*", *[F.round(F.col(p) / F.nullif(F.col(whole), F.lit(0)), 6).alias(f"{p}_share") for p in parts])

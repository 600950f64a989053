"""Digests of rows and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and the SHA-256 of a text with line ends levelled; a null text has a null digest."""
    return df.select(*keys, F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what happened to each row between two digest tables with unique keys: added, removed or changed."""
    a, b = old.select(*keys, F.col("digest").alias("was"), F.lit(True).alias("in_old")), new.select(*keys, F.col("digest").alias("now"), F.lit(True).alias("in_new"))
    both = a.join(b, keys, "full_outer")
    what = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(*keys, what.alias("change")).where("change IS NOT NULL")

"""The public functions under their SQL names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from foliant.functions import calc
from foliant.functions.text import key_of
from foliant.operators.evidence import best_window


@pandas_udf(T.StringType())
def match_key(texts: pd.Series) -> pd.Series:
    return pd.Series([key_of(x) for x in texts], dtype=object)


@pandas_udf(T.DoubleType())
def unit_value(units: pd.Series) -> pd.Series:
    """Factor of a unit to base units; null where it cannot be read."""

    def one(x):
        try:
            return calc.parse_unit(x)[0] if x is not None else None
        except calc.CalcError:
            return None

    return pd.Series([one(x) for x in units], dtype=float)


@pandas_udf(T.DoubleType())
def calc_value(expressions: pd.Series) -> pd.Series:
    """Value of an expression in base units; null where it cannot be read or its units do not go together."""

    def one(x):
        try:
            return calc.evaluate(x).value if x is not None else None
        except calc.CalcError:
            return None

    return pd.Series([one(x) for x in expressions], dtype=float)


@pandas_udf(T.DoubleType())
def window_ratio(pages: pd.Series, quotes: pd.Series) -> pd.Series:
    return pd.Series([best_window(p, q) for p, q in zip(pages, quotes)], dtype=float)


_FIELD = T.StructType([T.StructField(c, T.IntegerType() if c == "field_no" else T.StringType()) for c in ("kind", "id", "field_no", "key", "value")])


@udtf(returnType=_FIELD)
class NoteFields:
    """note_fields(text): one row for every field of a note text."""

    def eval(self, text: str):
        kind = ident = None
        fields: list[list[str]] = []
        for line in [*(text or "").split("\n"), ":::"]:
            bare = line.strip()
            if bare.startswith(":::"):
                for i, (key, value) in enumerate(fields):
                    yield kind, ident, i, key.strip().lower(), value.strip()
                parts = bare[3:].split()
                kind, ident, fields = (parts[0] if parts else None), (parts[1] if len(parts) > 1 else None), []
            elif kind and bare:
                key, colon, value = line.partition(":")
                if colon and key.strip() and len(key) <= 31 and key[0].isalpha() and key.replace("-", "").replace("_", "").replace(" ", "").isalnum():
                    fields.append([key, value])
                elif fields:
                    fields[-1][1] += "\n" + bare


def register(spark: SparkSession) -> None:
    """Make match_key, unit_value, calc_value, window_ratio and the table function note_fields known to spark.sql()."""
    for name, fn in (("match_key", match_key), ("unit_value", unit_value), ("calc_value", calc_value), ("window_ratio", window_ratio)):
        spark.udf.register(name, fn)
    spark.udtf.register("note_fields", NoteFields)

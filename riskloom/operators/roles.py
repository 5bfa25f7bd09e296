"""Which columns are numeric, categorical, or neither a feature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    numeric: list[str]
    categorical: list[str]

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def roles(df: DataFrame, exclude: Sequence[str] = (), bool_as: str = "numeric") -> Roles:
    """Strings are categorical, numbers and (by default) booleans numeric.

    Other types, such as dates and arrays, are no model features here and are left out;
    the summary variant counts them, see ``count_types``.
    """
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if is_numeric(f.dataType) or (isinstance(f.dataType, T.BooleanType) and bool_as == "numeric"):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            categorical.append(f.name)
    return Roles(numeric, categorical)


def count_types(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, int]:
    """Numbers against everything else; a boolean is not a number here."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    n = sum(is_numeric(f.dataType) for f in fields)
    return {"numeric": n, "categorical": len(fields) - n}

"""JSONPath over a column of JSON texts, with a given schema: ``jsonpath(df, column, path, schema)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import VALUE, expand
from ..plans.paths import build
from ..sources.reader import parsed


def jsonpath(df: DataFrame, column: str, path: str, schema: T.DataType | str, keep: list[str] | None = None) -> DataFrame:
    """One row for each match of ``path`` in each text of ``column``; ``keep`` names columns that go along."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    keep = [c for c in df.columns if c != column] if keep is None else keep
    return expand(df.select(*keep, parsed(F.col(column), kind).alias(VALUE)), build(path), kind, keep)

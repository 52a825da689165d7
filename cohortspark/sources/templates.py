"""SQL templates whose tables, columns and values come from outside."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def run_template(spark: SparkSession, template: str, tables: Mapping[str, DataFrame], columns: Mapping[str, str] | None = None,
                 **values: Any) -> DataFrame:
    """The result of a SQL text in which ``{name}`` stands for a table, ``IDENTIFIER(:name)`` for a column of ``columns`` and
    ``:name`` for a value (a list becomes an array).

    Nothing is pasted into the text: Spark parses the template first and binds the values to its markers, so that no value can
    change the statement. A column name must be one plain identifier, so it cannot reach into another table or field.
    """
    for marker, column in (columns or {}).items():
        if not _NAME.fullmatch(column):
            raise ValueError(f"{column!r}, given for {marker}, is no column name")
    bound = {name: F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else value for name, value in values.items()}
    return spark.sql(template, args={**bound, **(columns or {})}, **tables)

"""Stable keys for the rows of a table: the file a row stands in and its number there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeweave.scratch import materialize


def with_row_keys(df: DataFrame, file: str = "__file", row: str = "__row") -> DataFrame:
    """df with its columns renamed c0, c1, ... and a key of two columns that every reading of it gives again.

    A table that isn't read from files, or has a column that hides the files' metadata, is written once.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    keyed = None
    if "_metadata" not in (c.lower() for c in df.columns):
        try:
            keyed = _keys(df.select("*", "_metadata"), file, row)
        except AnalysisException:
            keyed = None
    if keyed is None:
        keyed = _keys(materialize(plain, "rows").select("*", "_metadata"), file, row)
    return keyed.toDF(*plain.columns, file, row)


def _keys(df: DataFrame, file: str, row: str) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)).drop("_metadata")

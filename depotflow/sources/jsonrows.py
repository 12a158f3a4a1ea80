"""Result rows as JSON lines, with NULL fields kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.options(**JSON_OPTIONS).json(path)

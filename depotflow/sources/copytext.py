r"""Rows in COPY text format.

One row per line, fields separated by tabs, ``\N`` for NULL, ``t`` / ``f`` for
booleans and backslash escapes. The CSV reader cannot keep NULL and the empty
string apart here and leaves escapes as they are, so lines are read as text and
decoded with column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotflow.functions.columns import LINE_PARTS, with_generated
from depotflow.schemas import MODEL

# --- fixed values: escapes of the COPY text format ---
ESCAPES = {"\\b": "\b", "\\f": "\f", "\\n": "\n", "\\r": "\r", "\\t": "\t", "\\v": "\v"}
NULL_FIELD = "\\N"
END_OF_DATA = "\\."


def _unescape(part: Column) -> Column:
    for written, meant in ESCAPES.items():
        part = F.replace(part, F.lit(written), F.lit(meant))
    # a backslash before any other character stands for that character
    return F.regexp_replace(part, r"\\(.)", "$1")


def decode_field(raw: Column) -> Column:
    """One field as text; NULL is tested on the raw field, before any unescaping.

    Cutting at doubled backslashes first keeps an escaped backslash apart from the
    escape that may follow it.
    """
    parts = F.transform(F.split(raw, r"\\\\", -1), _unescape)
    return F.when(raw != NULL_FIELD, F.array_join(parts, "\\"))


def encode_field(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(F.when(value, "t").otherwise(F.when(~value, "f")), F.lit(NULL_FIELD))
    text = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for written, meant in ESCAPES.items():
        text = F.replace(text, F.lit(meant), F.lit(written))
    return F.coalesce(text, F.lit(NULL_FIELD))


def read_copy_text(spark: SparkSession, path: str, table: str,
                   columns: list[str] | None = None) -> DataFrame:
    """A table from COPY text files.

    ``columns`` are the fields of the file in order, by default the stored columns of
    the table. Fields the model does not have (secrets) are dropped; generated
    columns, which COPY leaves out, are computed.
    """
    model = MODEL[table]
    columns = columns or [c.name for c in model.stored]
    fields = F.split("value", "\t", -1)
    lines = spark.read.text(path, lineSep="\n").filter(F.col("value") != END_OF_DATA)
    dtypes = {c.name: c.dtype for c in model.stored}
    rows = lines.select(*[
        decode_field(fields[i]).cast(dtypes[name]).alias(name)
        for i, name in enumerate(columns) if name in dtypes])
    return with_generated(rows, table) if table in LINE_PARTS else rows.select(*model.names)


def write_copy_text(df: DataFrame, path: str, table: str) -> None:
    """The stored columns of a table as COPY text files."""
    fields = [encode_field(F.col(c.name), c.dtype) for c in MODEL[table].stored]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.text(path, lineSep="\n")

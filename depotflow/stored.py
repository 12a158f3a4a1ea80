"""Tables read from files, with the size that their rows have.

Spark takes a table for as large as its files when it decides which side of a join to broadcast. Files of
ids and states that are compressed hold some fifty times that, and many millions of rows can pass for ten
megabytes and be gathered by the driver. So rows are counted, which reads the ends of the files only, where the files
alone leave it open, and the relation is given the factor between the two (``spark.sql.sources.fileCompressionFactor``),
by a session of its own, so the setting holds for this table and for nothing else.
"""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from depotflow import session

FACTOR = "spark.sql.sources.fileCompressionFactor"
DENSEST = 256  # times its files a table is taken to have at most, when rows are not counted
KEY_WIDTH = 16  # bytes of a row with one bigint


def row_width(df: DataFrame) -> int:
    """Bytes of a row as Spark reckons them for its projections."""
    return 8 + df._jdf.schema().defaultSize() + 12 * sum(kind == "string" for _, kind in df.dtypes)


def sized_relation(df: DataFrame) -> JavaObject | None:
    """The relation of a table read from files with its true size, or nothing where that would decide nothing."""
    spark = df.sparkSession._jsparkSession
    limit = spark.sessionState().conf().autoBroadcastJoinThreshold()
    relation = df._jdf.queryExecution().analyzed().relation()
    files, width = relation.sizeInBytes(), row_width(df)
    if files * DENSEST <= limit or files * KEY_WIDTH > limit * width:
        return None
    apart = spark.cloneSession()
    apart.conf().set(FACTOR, str(max(1.0, df.count() * width / files)))
    return relation.copy(relation.location(), relation.partitionSchema(), relation.dataSchema(), relation.bucketSpec(),
                         relation.fileFormat(), relation.options(), apart)


def of_relation(spark: SparkSession, relation: JavaObject) -> DataFrame:
    """A new reading of a relation."""
    return DataFrame(spark._jsparkSession.baseRelationToDataFrame(relation), spark)


def sized(df: DataFrame) -> DataFrame:
    """A table read from files, as one of its true size."""
    relation = sized_relation(df)
    return df if relation is None else of_relation(df.sparkSession, relation)


def durable(df: DataFrame) -> DataFrame:
    """``session.durable``, and Spark knows the size of the rows."""
    return sized(session.durable(df))

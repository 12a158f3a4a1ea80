"""A corpus pipeline over ``documents``: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the docs of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotflow.llm import decontaminate, langid, neardup, repeats, subword
from depotflow.llm.queries import remainder, table, tokenizer
from depotflow.session import durable

LANGUAGE_SHARE = 0.5  # a text whose best language has less is rejected
SHINGLE = 5  # words of a shingle in the near-duplicate stage; the query op10 takes three, and 85 per cent
NEAR = 80  # per cent: shared shingles of all shingles of two near copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: null, empty, without a letter, or evenly mixed.

    The model learns from the labelled rows of the training folds; a text's own label is not looked at.
    """
    model = langid.train(docs.where(F.coalesce(remainder("doc_id", 3) != 1, F.lit(True))))
    judged = langid.predict(docs, model)
    return (judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE))
            .select(*docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of least id, one without an id last,
    and of one id the one of least digest; of equal rows one.

    Texts without words are in no group and stay.
    """
    marks = neardup.near_duplicates(docs, size=SHINGLE, threshold=NEAR, keys=True)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    kept = (marks.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(place).alias("first")).select("first.*")
            .unionByName(marks.where(F.col("root").isNull()).select(place.alias("first")).distinct().select("first.*"))
            .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")))
    rows = docs.withColumn("__text", F.sha2("text", 256))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["__id"]) & rows["__text"].eqNullSafe(kept["__digest"]),
                     "left_semi")
    return rows.dropDuplicates(["doc_id", "__text"]).drop("__text")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 200 bytes that are found twice; a text that is cut whole goes.

    What is left of a character that was cut through is dropped with it.
    """
    names = docs.columns
    cut = repeats.repeats(docs, keep=[c for c in names if c != "doc_id"])
    rows = (cut.where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
            .withColumn("text", F.col("kept")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: ids, their digests and the decoded text's."""
    return subword.encoded(docs, tokenizer("piece_bpe_32k.model"), with_ids=True, with_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", language),
    ("near-duplicates", one_of_each),
    ("repeated strings", without_repeats),
    ("benchmark decontamination", uncontaminated),
    ("subword encoding", encoded),
]

#: SQL can express neither the trained language model nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs

"""The named queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotflow.llm import (covertree, decontaminate, langid, licenses, neardup, pages, phrases, repeats, simhash,
                           subword, suffixtree, tokenfile, whitening)

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of the id written as text, modulo ``by``: the fold of a row."""
    return F.crc32(F.col(column).cast("string")) % by


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "benchmark")).drop("key")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return (suffixtree.scored(table(spark, sf_dir, "documents"), ~held_out)
            .select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model,
                          keep=["doc_id", "held_out"])


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_subword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), with_text=False)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return pages.extract(rows, pages.train(rows))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: each source is a tree, 64 ids share a directory, and the first id of
    a directory, and of 4,096 ids, is a file named LICENSE."""
    number = F.col("doc_id")
    folder = F.concat_ws("/", F.lit(""), "source", F.floor(number / 4096).cast("string"))
    path = (F.when(number % 4096 == 0, F.concat_ws("/", folder, F.lit("LICENSE")))
            .otherwise(F.concat_ws("/", folder, F.floor(number / 64).cast("string"),
                                   F.when(number % 64 == 0, F.lit("LICENSE"))
                                   .otherwise(F.concat(number.cast("string"), F.lit(".txt"))))))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"), with_text=False)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.by_component(whitening.whitened(vectors, model), model,
                                  whitening.identity_error(vectors, model))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(phrases.collocations(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_language_id": op3_language_id,
    "op4_top_k": op4_top_k,
    "op5_subword_round_trip": op5_subword_round_trip,
    "op6_main_text": op6_main_text,
    "op7_licence_scan": op7_licence_scan,
    "op8_token_files": op8_token_files,
    "op9_repeated_strings": op9_repeated_strings,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_collocations": op13_collocations,
}

SQL: dict[str, str] = {
    "op4_top_k": """
        WITH whole AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS vector
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id,
                   list_dot_product(q.vector, d.vector)::BIGINT AS score
            FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        spoken AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM spoken GROUP BY lang),
        begun AS (
            SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken WHERE len(w) > 0),
        grams AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
            FROM begun CROSS JOIN (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
            GROUP BY ALL HAVING count(*) >= 100),
        split AS (
            SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w,
                   unnest(range(1, m)) AS k
            FROM grams WHERE m >= 2),
        scored AS (
            SELECT s.lang, s.phrase, s.a, s.k, x.f AS l, y.f AS r, n,
                   (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
            FROM split s
            JOIN grams x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:k], ' ')
            JOIN grams y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[k + 1:s.m], ' ')
            JOIN sizes z ON z.lang = s.lang),
        lowest AS (
            SELECT * FROM scored
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, array_to_string(w[b:b + size - 1], ' ') AS phrase, max(f) AS most
            FROM (SELECT lang, f, m, w, size, unnest(range(1, m - size + 2)) AS b
                  FROM (SELECT lang, f, m, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS size
                        FROM grams WHERE m >= 3))
            GROUP BY ALL),
        kept AS (
            SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase)
            WHERE most IS NULL OR 100 * most < 100 * a),
        ranked AS (
            SELECT *, row_number() OVER (
                PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}

"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import ann, bpe, crosstok, html_text, language, ngram_join, packing, phrases, quality, secrets, simhash, suffix_dedup, topk
from corpusforge.llm.common import documents


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources, paths their languages within a source."""
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_pack_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model).withColumn("held_out", held_out)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By strings of 400 bytes; beside that, the text without repeated passages, as a stage of a pipeline would keep it."""
    return suffix_dedup.dedup(documents(spark, sf_dir), passage=suffix_dedup.PASSAGE)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near(documents(spark, sf_dir))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_graph": op1_ann_graph,
    "op2_quality": op2_quality,
    "op3_topk_exact": op3_topk_exact,
    "op4_html_text": op4_html_text,
    "op5_ngram_join": op5_ngram_join,
    "op6_secrets": op6_secrets,
    "op7_pack_curve": op7_pack_curve,
    "op8_bpe": op8_bpe,
    "op9_language": op9_language,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_simhash": op11_simhash,
    "op12_phrases": op12_phrases,
    "op13_crosstok": op13_crosstok,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk_exact": """
        WITH r AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM r q JOIN r c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20""",
    "op12_phrases": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
            FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
        total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        own AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
        cuts AS (
            SELECT lang, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') AS x, array_to_string(list_slice(w, c + 1, len(w)), ' ') AS y
            FROM own, (SELECT unnest([1, 2]) AS c) WHERE c < len(w)),
        scored AS (
            SELECT cuts.*, p.n AS l, q.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(p.n AS HUGEINT) * q.n) AS BIGINT) AS score
            FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
        inner_ AS (
            SELECT lang, short, max(a) AS most
            FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS short FROM own WHERE len(w) = 3) GROUP BY ALL),
        kept AS (
            SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.short = b.phrase
            WHERE most IS NULL OR 100 * most < 50 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}

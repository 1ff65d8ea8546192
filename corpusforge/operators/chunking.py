"""Chunks of documents: even ones at sentence ends, semantic ones at breaks of similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusforge.config import Settings
from corpusforge.functions.ids import chunk_id
from corpusforge.functions.text import sentences


def fold_sentences(parts: list[str], target: float, overlap: int) -> list[str]:
    """Sentences gathered until a chunk reaches the target; the next begins with the last ones that cover the overlap."""
    chunks: list[str] = []
    now: list[str] = []
    size, carried = 0, 0  # carried: sentences of now that the chunk before ends with
    for part in parts:
        now.append(part)
        size += len(part) + 1
        if size >= target:
            chunks.append(" ".join(now))
            size, carried = 0, 0
            while carried < len(now) and (carried == 0 or size < overlap):
                carried += 1
                size += len(now[-carried]) + 1
            now = now[-carried:]
    if now and (not chunks or len(now) != carried):
        chunks.append(" ".join(now))
    return chunks


def naive(content: Column, settings: Settings = Settings()) -> Column:
    """The chunks of a text, about ideal_chunk_size characters each. A fold that grows arrays is quadratic as a column
    expression, so it is one Arrow-batched function over the sentences that the JVM has split."""
    ideal, share = settings.ideal_chunk_size, settings.overlap

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for p, n in zip(parts, length, strict=True):
            if p is None or pd.isna(n):
                out.append(None)
                continue
            target = n / max(1, round(n / ideal))
            out.append(fold_sentences(list(p), target, int(target * share)))
        return pd.Series(out, dtype=object)

    return run(_bounded(sentences(content)), F.length(content))


def _bounded(parts: Column) -> Column:
    """The batches that go to Python are bounded by their bytes: by rows alone they grow with the texts, and with the table up to
    that number of rows."""
    SparkSession.getActiveSession().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return parts


def chunks(docs: DataFrame, made: Column, uuid: str = "uuid", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk: id, document, position (from 0) and what it inherits, with the columns named in keep as well."""
    rows = docs.select("*", F.posexplode(made).alias("pos", "chunk"))
    return rows.select(chunk_id(F.col(uuid), F.col("pos")).alias("chunk_id"), F.col(uuid).alias("doc_uuid"), "pos", "type", "link", F.col("chunk").alias("content"), F.col("create_date").alias("content_date"), *keep)


def sentence_context(parts: Column, c: int = 1) -> Column:
    """Each sentence with c before and c after it. Give it a column, not an expression: a lambda would split the text anew for each."""
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.greatest(i - c, F.lit(0)) + 1, F.least(i + c, F.size(parts) - 1) - F.greatest(i - c, F.lit(0)) + 1), " "))


def semantic_parameters(length: int) -> tuple[int, float]:
    """Sentences of context and least similarity, by the length of the text."""
    return (2, 0.6) if length < 1800 else (4, 0.85) if length > 30_000 else (3, 0.7)


def hashed_vectors(texts: list[str], size: int = 256) -> np.ndarray:
    """Deterministic stand-in of an embedder: hashed words, square roots of counts, unit length."""
    import re
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            out[i, zlib.crc32(w.encode()) % size] += 1
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def semantic(content: Column, embed=hashed_vectors) -> Column:
    """Cuts where neighbouring groups of sentences are less alike than the threshold."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for p, n in zip(parts, length, strict=True):
            if p is None or pd.isna(n):
                out.append(None)
                continue
            p = list(p)
            c, least = semantic_parameters(int(n))
            v = embed([" ".join(p[max(0, i - c) : i + c + 1]) for i in range(len(p))])
            cut = np.flatnonzero((v[1:] * v[:-1]).sum(1) < least) + 1
            out.append([" ".join(p[a:b]) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True)])
        return pd.Series(out, dtype=object)

    return run(_bounded(sentences(content)), F.length(content))


def statistics(per_document: DataFrame, by: str = "chunker") -> DataFrame:
    """Chunks in all, their mean number in a document, and mean, spread, least and largest of their sizes."""
    docs = per_document.groupBy(by, "doc").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.sum(F.col("size") * F.col("size")).alias("q"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    spread = F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0))))
    return docs.groupBy(by).agg(n.alias("chunks"), F.avg("n").alias("per_document"), (s / n).alias("mean_size"), spread.alias("std_size"), F.min("lo").alias("min_size"), F.max("hi").alias("max_size"))

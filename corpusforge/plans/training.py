"""Training sets from a corpus: pairs, hard negatives, triplets, clusters; their checks and splits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.plans.index import LexicalIndex, bounded_batches, least_common


def queries_for(index: LexicalIndex, n_terms: int = 5) -> DataFrame:
    """doc, query: the terms that tell a document from the others, as a question's stand-in."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    keys, least = ["scope", "term"], least_common(index.terms)
    known = index.terms.join(F.broadcast(index.corpus), "scope").select("scope", "term", "df", idf.alias("idf"))
    # of common terms a document gives its best only, and rare ones alone are shuffled
    common = known.where(F.col("df") >= least)
    bounded_batches(index.held.sparkSession)
    kinds = dict(index.held.dtypes)
    best = index.held.select("scope", "doc", "terms", "counts").mapInArrow(_telling(common.orderBy("scope", "term").select("scope", "term", "idf").toArrow(), n_terms), f"doc {kinds['doc']}, term string, tf bigint, idf double")
    if least > 1:
        rare = index.postings.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(known.where(F.col("df") < least), keys)
        best = best.union(rare.select("doc", "term", "tf", "idf"))
    rows = best.select("doc", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("w"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("w"), "term"))).where(F.col("r") <= n_terms)
    return top.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("query"))


def _telling(sent: pa.Table, n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc, term, tf, idf: of each document the terms of `sent` (scope, term, idf, in this order) that can be among its n greatest by
    rounded weight, equal ones by term."""
    scopes = {}
    for name in pc.unique(sent["scope"]).to_pylist():
        own = sent.filter(pc.equal(sent["scope"], name))
        scopes[name] = (own["term"].combine_chunks(), own["idf"].to_numpy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (vocabulary, idf) in scopes.items():
                mine = batch.filter(pc.equal(batch.column(0), name))
                lists = mine.column(2)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                row = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
                some = row >= 0
                row, col, tf = row[some], np.repeat(np.arange(len(sizes)), sizes)[some], mine.column(3).flatten().to_numpy()[some].astype(np.int64)
                w = tf * idf[row]
                order = np.lexsort((row, -w, col))
                row, col, tf, w = row[order], col[order], tf[order], w[order]
                start = np.searchsorted(col, col)
                place = np.arange(len(col)) - start
                last = w[np.minimum(start + n - 1, max(0, len(w) - 1))]
                # a weight that is less by under a millionth may be equal when rounded
                kept = (place < n) | ((w < last) & (w > last - 2e-6))
                docs = mine.column(1).take(pa.array(col[kept]))
                yield pa.RecordBatch.from_arrays([docs, vocabulary.take(pa.array(row[kept])), pa.array(tf[kept]), pa.array(idf[row[kept]])], ["doc", "term", "tf", "idf"])

    return run


def pairs(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    return queries.join(chunks, "doc").where((F.trim("query") != "") & (~F.trim("content").isin("", "."))).select("query", F.col("content").alias("chunk"), "doc", "chunk_id")


def negatives_exact(positives: DataFrame, retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query the first retrieved content that is a chunk of another document."""
    known = chunks.select(F.col("content").alias("negative"), F.col("doc").alias("negative_doc"))
    rows = retrieved.join(known, retrieved["content"] == known["negative"]).join(positives.select("query_id", "doc"), "query_id").where("negative_doc <> doc")
    return rows.groupBy("query_id").agg(F.min_by("negative", F.struct("rank", "negative")).alias("negative"))


def negatives_contained(retrieved: DataFrame, chunks: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Per query the first chunk of another document that holds a retrieved text. words: see containing(), by chunk_id."""
    parts = retrieved.select(F.struct("query_id", "anchor_doc", F.md5("content").alias("part_md5")).alias("asked"), F.col("content").alias("part")).distinct()
    rows = containing(parts, chunks.select("chunk_id", "content"), "asked", "chunk_id", words).join(chunks.select("chunk_id", "doc"), "chunk_id")
    rows = rows.select("asked.query_id", "asked.anchor_doc", "chunk_id", "doc").where("doc <> anchor_doc")
    return rows.groupBy("query_id").agg(F.min_by("chunk_id", F.struct("doc", "chunk_id")).alias("negative_id"))


def containing(parts: DataFrame, wholes: DataFrame, asked: str, held: str, words: DataFrame | None = None) -> DataFrame:
    """Pairs of keys (asked, held) of a part and a content that holds it. They meet on the rarest word of the part, of those inside it
    if it has some: its first and last may be cut from longer ones. A part without a word holds nothing.

    Parts of few words in all go to the wholes, of which nothing is shuffled. Of more parts only words and keys go through that
    join, and the texts of the pairs that are left come after it.

    words (held, word), each pair once, are the words of the wholes where an index has them; else the wholes are read for the
    parts' words."""
    from corpusforge.plans.index import FEW, WORD, tokens

    inner = tokens(F.regexp_replace("part", f"^{WORD}|{WORD}$", " "))
    wanted = parts.select(asked, F.explode(F.array_distinct(F.when(F.size(inner) > 0, inner).otherwise(tokens(F.col("part"))))).alias("word"))
    own = F.explode(F.array_distinct(tokens(F.col("content")))).alias("word")
    few = wanted.count() <= FEW
    if words is None:
        words = wholes.select(held, own)
    sought = wanted.select("word").distinct()
    words = words.join(F.broadcast(sought) if few else sought, "word", "left_semi")
    rare = words.groupBy("word").agg(F.count("*").alias("df"))
    key = wanted.join(rare, "word", "left").groupBy(asked).agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("word"))
    if few:
        # sent with their keys: a content is looked at where it is, once for each of its words that is a key
        sent = F.broadcast(key.join(parts.select(asked, "part"), asked))
        return wholes.select(held, "content", own).join(sent, "word").where(F.contains("content", F.col("part"))).select(asked, held).distinct()
    pairs = words.join(key, "word").select(asked, held)
    return pairs.join(parts.select(asked, "part"), asked).join(wholes.select(held, "content"), held).where(F.contains("content", F.col("part"))).select(asked, held).distinct()


def pair_negatives(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """query, positive, negative: the first negative of the same query."""
    first = negatives.groupBy("query").agg(F.min_by("text", "pos").alias("negative"))
    return positives.join(first, "query").select("query", F.col("text").alias("positive"), "negative")


def labelled_pairs(triples: DataFrame) -> DataFrame:
    rows = F.array(F.struct(F.col("positive").alias("text"), F.lit(1).alias("label")), F.struct(F.col("negative").alias("text"), F.lit(0).alias("label")))
    return triples.select("query", F.explode(rows).alias("x")).select("query", "x.text", "x.label")


def split(rows: DataFrame, key: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """Adds train: by a hash of the key, so that a row stays on its side when others come."""
    return rows.withColumn("train", F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), 1, 7), 16, 10).cast("bigint") < int(share * (1 << 28)))


def valid_pairs(rows: DataFrame, verdict: Column) -> DataFrame:
    return rows.where((F.trim("query") != "") & (~F.trim("chunk").isin("", ".")) & verdict)


def check_pairs(rows: DataFrame) -> None:
    bad = rows.agg(F.count_if(F.col("query").isNull() | F.col("chunk").isNull()).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} pairs lack a query or a chunk")


def tfidf(docs: DataFrame, doc: str = "doc_id", content: str = "content", vocabulary: int = 1000):
    from pyspark.ml.feature import IDF, CountVectorizer

    from corpusforge.plans.index import tokens

    words = docs.select(F.col(doc).alias("doc"), tokens(F.col(content)).alias("words"))
    counted = CountVectorizer(vocabSize=vocabulary, inputCol="words", outputCol="tf").fit(words).transform(words)
    return IDF(inputCol="tf", outputCol="features").fit(counted).transform(counted).select("doc", "features")


def cluster(docs: DataFrame, k: int = 10, seed: int = 42, doc: str = "doc_id", content: str = "content", cut=None) -> DataFrame:
    """doc, cluster, by mini-batches of TF-IDF vectors (of 1000 terms); clusters without documents don't appear."""
    from pyspark.ml.functions import vector_to_array

    from corpusforge.plans import clusters

    # written as sparse vectors and by batch, so that a batch reads its own rows only
    made = tfidf(docs, doc, content).select(F.col("doc").alias("id"), "features").withColumn("batch", clusters.batch_of(clusters.BATCHES, seed))
    made = cut(made) if cut else made
    vectors = made.select("id", vector_to_array("features").alias("v"), "batch")
    return clusters.assign(vectors, clusters.fit(vectors, k, seed=seed)).withColumnRenamed("id", "doc")


def benchmark_items(clusters: DataFrame, chunks: DataFrame, size: int = 3) -> DataFrame:
    """type, relevant ids: one chunk, one document, or `size` documents of one cluster, the first by a hash."""
    order = F.md5(F.concat(F.col("doc").cast("string"), F.lit("42")))
    one = chunks.groupBy("doc").agg(F.min_by("chunk_id", F.md5(F.col("chunk_id").cast("string"))).alias("chunk_id"))
    specific = one.select(F.lit("specific").alias("type"), F.array(F.col("chunk_id").cast("string")).alias("relevant_uuids"))
    document = one.select(F.lit("document").alias("type"), F.array(F.col("doc").cast("string")).alias("relevant_uuids"))
    ranked = clusters.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(order, "doc"))).where(F.col("r") <= size)
    multi = ranked.groupBy("cluster").agg(F.sort_array(F.collect_list(F.col("doc").cast("string"))).alias("relevant_uuids")).where(F.size("relevant_uuids") == size)
    return specific.union(document).union(multi.select(F.lit("multi_document").alias("type"), "relevant_uuids"))


def safety_model(texts: DataFrame, label: str = "label", text: str = "text"):
    """A logistic model of TF-IDF features for labelled texts (text, label 0/1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[\p{L}\p{N}_]+", gaps=False)
    return Pipeline(stages=[words, HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 12), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, regParam=0.01)]).fit(texts)

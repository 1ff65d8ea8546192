"""Search as one plan for a batch of questions: lexical top-k, filter, vector top-k among candidates, rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.config import Settings
from corpusforge.operators.filters import SearchFilter, by_date
from corpusforge.plans.index import LexicalIndex, Tokenizer, tokens


#: A text's unit vector, and the score of a question with a text: column expressions, or functions on Arrow batches around a model.
Embedder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]
#: Chunks of documents: a table (chunk_id, doc, content, and words where these are stored), or a function that joins the chunks of
#: documents to a table of these (doc). A chunk depends on its document only, so with a function no others need be cut.
Chunks = DataFrame | Callable[[DataFrame], DataFrame]


def ranked(rows: DataFrame, k: int, score: str = "score", key: str = "doc", query: str = "query_id") -> DataFrame:
    """The k best of each query; scores are rounded first, so that ties are the same wherever the sums were made."""
    rows = rows.withColumn(score, F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


#: Weights of terms that go to all tasks with a batch of questions at most, and rows that a task gives at most; what passes them
#: is searched by joins. Cells of the matrix of terms by documents that a task holds.
WEIGHTS, LISTED, CELLS = 1 << 18, 1 << 20, 1 << 22


def bm25(index: LexicalIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, query: str = "query_id", text: str = "text", scope: str | None = None) -> DataFrame:
    """query_id, doc, score, rank. A term that a query repeats counts each time. Without a scope all sources are searched.

    The weights of the questions' terms go to the documents: all terms of a document stand in its row, so a task scores its own
    documents and gives each question's k best of them, and only these lists are shuffled. Batches of more than WEIGHTS weights, or
    lists of more than LISTED rows, go by joins on terms."""
    wanted = queries.select(F.col(query).alias("query_id"), *([F.col(scope).alias("scope")] if scope else []), F.explode(index.tokenize(F.col(text))).alias("term"))
    keys = ["scope", "term"] if scope else ["term"]
    wanted = wanted.groupBy("query_id", *keys).agg(F.count("*").alias("times"))
    terms = index.terms.join(wanted.select(*keys).distinct(), keys)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # corpus has one row for each source
    weights = terms.join(index.corpus, "scope").select("scope", "term", idf.alias("idf"), "avg_len")
    asked = wanted.join(weights, keys).select("query_id", "scope", "term", (F.col("times") * F.col("idf")).alias("weight"), "avg_len")
    sent = asked.limit(WEIGHTS + 1).toArrow() if k <= LISTED else None
    if sent is not None and len(sent) <= WEIGHTS and len(sent["query_id"].unique()) * k <= LISTED:
        kinds = dict(asked.dtypes) | dict(index.held.dtypes)
        schema = f"query_id {kinds['query_id']}, scope {kinds['scope']}, doc {kinds['doc']}, score double"
        return ranked(index.held.select("scope", "doc", "len", "terms", "counts").mapInArrow(_scorer(sent, k, k1, b), schema), k)
    hits = asked.join(index.postings, ["scope", "term"])
    part = F.col("weight") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query_id", "scope", "doc").agg(F.sum(part).alias("score"))
    return ranked(scored, k)


def _scorer(sent: pa.Table, k: int, k1: float, b: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best documents of each question among those of a task. sent: query_id, scope, term, weight, avg_len."""
    queries = pc.unique(sent["query_id"])
    scopes = {}
    for name in pc.unique(sent["scope"]).to_pylist():
        own = sent.filter(pc.equal(sent["scope"], name))
        terms = own["term"].combine_chunks().dictionary_encode() if len(own) else None
        who = pc.index_in(own["query_id"], value_set=queries).to_numpy()
        row, weight, order = terms.indices.to_numpy(), own["weight"].to_numpy(), np.argsort(who, kind="stable")
        cut = np.flatnonzero(np.diff(who[order])) + 1
        asked = [(int(who[at[0]]), row[at], weight[at]) for at in np.split(order, cut)]
        scopes[name] = (terms.dictionary, float(own["avg_len"][0].as_py()), asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        names, kinds = list(scopes), None
        for batch in batches:
            kinds = kinds or (batch.schema.field("scope").type, batch.schema.field("doc").type)
            for number, name in enumerate(names):
                mine = batch.filter(pc.equal(batch.column(0), name))
                vocabulary, avg_len, asked = scopes[name]
                step = max(1, CELLS // len(vocabulary))
                for at in range(0, mine.num_rows, step):
                    _add(best, number, mine.slice(at, step), vocabulary, avg_len, asked)
        if not best:
            return
        whose = np.repeat(list(best), [len(x[0]) for x in best.values()])
        scores, docs, numbers = (np.concatenate([x[i] for x in best.values()]) for i in range(3))
        held = pa.array(names, kinds[0]).take(pa.array(numbers))
        yield pa.RecordBatch.from_arrays([queries.take(pa.array(whose)), held, pa.array(docs.tolist() if docs.dtype == object else docs, kinds[1]), pa.array(scores)], ["query_id", "scope", "doc", "score"])

    def _add(best, number, part, vocabulary, avg_len, asked):
        lists = part.column(3)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        row = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy()
        col, tf = np.repeat(np.arange(len(sizes)), sizes)[row >= 0], part.column(4).flatten().to_numpy()[row >= 0].astype(np.float64)
        norm = k1 * (1 - b + b * part.column(2).to_numpy(zero_copy_only=False) / avg_len)
        matrix = np.zeros((len(vocabulary), len(sizes)))
        matrix[row[row >= 0], col] = tf / (tf + norm[col])
        docs = part.column(1)
        docs = docs.to_numpy(zero_copy_only=False) if pa.types.is_integer(docs.type) else np.array(docs.to_pylist(), object)
        for q, rows, weight in asked:
            score = weight @ matrix[rows]
            held = best.get(q)
            full = held is not None and len(held[0]) >= k
            at = np.flatnonzero((score > 0) & (score >= held[0][-1] - 1e-6) if full else score > 0)
            if not len(at):
                continue
            # rounded as the ranks are, so that ties are the same
            found = (np.floor(score[at] * 1e6 + 0.5) / 1e6, docs[at], np.full(len(at), number, np.int32))
            if held is not None:
                found = tuple(np.concatenate(x) for x in zip(held, found, strict=True))
            key = found[1] if found[1].dtype != object else np.unique(found[1], return_inverse=True)[1]
            order = np.lexsort((key, -found[0]))[:k]
            best[q] = tuple(x[order] for x in found)

    return run


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors of a shard and queries of a block, which one task compares; queries whose scores stand in memory at once.
SHARD, BLOCK, ROWS = 8192, 2048, 256


def _tile(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            q, v = (c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in (left["query"], right["v"]))
            who, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, v = ids[order], v[order]
            for at in range(0, len(q), ROWS):
                score = np.round(q[at : at + ROWS] @ v.T, 6)
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else score.min(1)
                row, col = np.nonzero(score >= least[:, None])
                by = np.lexsort((col, -score[row, col], row))
                row, col = row[by], col[by]
                take = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[take], col[take]
                found.append((who[at : at + ROWS][row], ids[col], score[row, col]))
        return pa.table({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "id", "score"))})

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: all queries (query_id, query) against all vectors (id, v). Equal lengths, unit vectors: the
    order by inner product is that of the distance. Blocks of queries meet shards of vectors, both dealt by a hash of the id;
    vectors that are null or hold a null take no part, and those of other lengths aren't compared."""
    part = lambda df, id_, v: df.select(F.col(id_).cast("long").alias(id_), F.col(v).cast("array<double>").alias(v)).where(F.col(id_).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0)).withColumn("dim", F.size(v))
    queries, vectors = part(queries, "query_id", "query"), part(vectors, "id", "v")
    blocks, shards = max(1, -(-queries.count() // BLOCK)), max(1, -(-vectors.count() // SHARD))
    deal = lambda id_, n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = queries.withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))
    vectors = vectors.withColumn("shard", deal("id", shards)).withColumn("block", every(blocks))
    keys = ["shard", "block", "dim"]
    lists = queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(_tile(k), "query_id long, id long, score double")
    return ranked(lists, k, key="id")


def vector_topk_candidates(queries: DataFrame, vectors: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """The same among the candidates (query_id, id) of each query; k may pass their number."""
    pairs = candidates.join(vectors, "id").join(queries, "query_id")
    return ranked(pairs.select("query_id", "id", dot(F.col("v"), F.col("query")).alias("score")), k, key="id")


def overlap(query: Column, text: Column) -> Column:
    """The share of the question's distinct words that the text has: the default scorer of pairs."""
    words = F.array_distinct(tokens(query))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, tokens(text))) / F.size(words))


#: Rows of ids that a search sends to all tasks at most; how many questions and rows a question has is known before.
FEW = 1 << 18


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of `rows` rows at most, to be joined: sent to all tasks if these are few, dealt by key like the other side if not."""
    return F.broadcast(df) if rows <= FEW else df


def words_of(chunks: DataFrame) -> Column:
    """The distinct words of each chunk: stored ones, or those of its content."""
    return F.col("words") if "words" in chunks.columns else F.array_distinct(tokens(F.col("content")))


def of_documents(found: DataFrame, chunks: Chunks, rows: int) -> DataFrame:
    """The chunks of the documents found (doc; `rows` rows at most), each once, with _found: the rows that found its document."""
    others = [c for c in found.columns if c != "doc"]
    by = few(found.groupBy("doc").agg(F.collect_list(F.struct(*others)).alias("_found")), rows)
    return chunks.join(by, "doc") if isinstance(chunks, DataFrame) else chunks(by)


def of_each(held: DataFrame, *keep: str) -> DataFrame:
    """What of_documents() gives, a row for each row that found a chunk's document."""
    return held.select(*keep, F.explode("_found").alias("_f")).select(*keep, "_f.*")


def with_content(found: DataFrame, chunks: Chunks, rows: int) -> DataFrame:
    """Rows found (chunk_id, doc; `rows` at most) with the content of their chunks."""
    if isinstance(chunks, DataFrame):
        return few(found, rows).join(chunks.select("chunk_id", "content"), "chunk_id")
    held = of_each(of_documents(found.withColumnRenamed("chunk_id", "_chunk"), chunks, rows), "chunk_id", "doc", "content")
    return held.where(F.col("chunk_id") == F.col("_chunk")).drop("_chunk")


def overlaps(kept: DataFrame, chunks: Chunks, queries: DataFrame, asked: int, each: int) -> DataFrame:
    """query_id, doc, doc_rank, chunk_id, score: overlap() of each question with the chunks of its documents (kept: query_id, doc,
    doc_rank; `each` of a question at most, `asked` questions). A chunk's words are read once, and only those of documents
    that were found; for a small batch of questions they aren't shuffled."""
    held = of_documents(kept, chunks, asked * each)
    held = of_each(held.select("chunk_id", "doc", words_of(held).alias("_held"), "_found"), "chunk_id", "doc", "_held")
    words = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_words"))
    shared = F.size(F.array_intersect("_words", "_held")) / F.size("_words")
    rows = held.join(few(words, asked * 64), "query_id")
    return rows.withColumn("score", F.when(F.size("_words") == 0, 0.0).otherwise(shared)).drop("_held", "_words")


def nearness(kept: DataFrame, chunks: Chunks, queries: DataFrame, rows: int, embed: Embedder) -> DataFrame:
    """The same with the inner product of the vectors of each question and chunk as score (`rows` of kept at most). Each text of the
    documents found is embedded once, and only vectors go to the questions."""
    vectors = of_documents(kept, chunks, rows).select("chunk_id", "doc", embed(F.col("content")).alias("_v"), "_found")
    asked = queries.select("query_id", embed(F.col("text")).alias("_q"))
    return of_each(vectors, "chunk_id", "doc", "_v").join(asked, "query_id").withColumn("score", dot(F.col("_v"), F.col("_q"))).drop("_v", "_q")


def rerank(rows: DataFrame, score: Column, k: int, query: str = "query_id", before: str = "rank") -> DataFrame:
    """By score, equal ones as they stood; rows that have no score stay as they stood, after the others."""
    rows = rows.withColumn("pair_score", F.round(score, 6)).withColumnRenamed(before, "_before")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc_nulls_last("pair_score"), "_before"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("_before")


def window_scores(rows: DataFrame, score: str, how: str = "max", keys: tuple[str, ...] = ("query_id", "id")) -> DataFrame:
    """One score of a long text from those of its pieces."""
    made = {"max": F.max(score), "mean": F.avg(score), "first": F.min_by(score, "pos")}[how]
    return rows.groupBy(*keys).agg(made.alias(score))


def pieces(text: Column, size: int) -> Column:
    """A text's words in pieces of at most `size` of them."""
    words = tokens(text)
    n = F.greatest(F.ceil(F.size(words) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))


#: Tokens of a pair that a scorer adds itself.
SPECIAL = 3


def pair_windows(pairs: DataFrame, limit: int, tokenize: Tokenizer = tokens) -> DataFrame:
    """query_id, id, pos, q, w: the tokens of a question and of each window of its text. A window and the question together have
    `limit` tokens at most, with SPECIAL ones between them; a question as long as that leaves windows of one token. A text that
    fits, or has no tokens, is one window. pairs: query_id, id, text (the question), content."""
    made = pairs.select("query_id", "id", tokenize(F.col("text")).alias("q"), tokenize(F.col("content")).alias("c"))
    size = F.greatest(F.lit(limit - SPECIAL) - F.size("q"), F.lit(1))
    n = F.greatest(F.ceil(F.size("c") / size).cast("int"), F.lit(1))
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("c", i * size + 1, size))
    return made.select("query_id", "id", "q", F.posexplode(windows).alias("pos", "w"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal tokens, less by each edit that parts them."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def best_matches(q: Column, w: Column, like: PairScorer = likeness) -> Column:
    """The mean, over the tokens of the question, of the best likeness that a token of the window has; 0 without tokens. Each
    different token of the window is compared once."""
    each = F.array_distinct(w)
    best = F.transform(q, lambda a: F.coalesce(F.array_max(F.transform(each, lambda b: like(a, b))), F.lit(0.0)))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q))


def pair_scores(pairs: DataFrame, limit: int, how: str = "max", tokenize: Tokenizer = tokens, like: PairScorer = likeness) -> DataFrame:
    """query_id, id, score: of each question and text, token by token in windows, combined by max, mean or first."""
    windows = pair_windows(pairs, limit, tokenize).withColumn("score", best_matches(F.col("q"), F.col("w"), like))
    return window_scores(windows.select("query_id", "id", "pos", "score"), "score", how)


def find(index: LexicalIndex, docs: DataFrame, chunks: Chunks, queries: DataFrame, settings: Settings = Settings(), filters: SearchFilter | None = None, earlier_first: bool = False, prefilter: bool = False, embed: Embedder | None = None, score: PairScorer | None = None) -> DataFrame:
    """query_id, chunk_id, doc, rank, pair_score: the chunks that answer each question.

    docs: doc, type, create_date. chunks: chunk_id, doc, content, and words (their distinct words) where these are stored, or a
    function that makes the chunks of the documents found. queries: query_id, text. The filter comes after the lexical
    top-k, so it can leave nothing; prefilter=True puts it before. The order by date only changes how ties stand. With an
    embedder the second stage goes by vectors in place of shared words, and with a scorer its best chunks are ranked by that;
    a pair that the scorer gives null stands after the others, and all stand as they stood if it gives null to all.
    """
    first, asked = bm25(index, queries, settings.initial_documents_k if not prefilter else 1 << 30, settings.k1, settings.b), queries.count()
    # the documents that were found go to the table of documents, which isn't shuffled
    kept = (first if prefilter else few(first, asked * settings.initial_documents_k)).join(docs, "doc").where(filters.column() if filters else F.lit(True))
    if prefilter:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        kept = kept.withColumn("place", place).where(F.col("place") <= settings.initial_documents_k).drop("place")
    order = by_date(kept) if earlier_first else [F.col("rank").asc()]
    kept = kept.withColumn("doc_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    kept = kept.select("query_id", "doc", "doc_rank")
    if embed is None:
        scored = overlaps(kept, chunks, queries, asked, settings.initial_documents_k)
    else:
        scored = nearness(kept, chunks, queries, asked * settings.initial_documents_k, embed)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_rank", "chunk_id"))
    near = scored.withColumn("rank", rank).where(F.col("rank") <= settings.initial_chunks_k)
    if score is not None:
        near = with_content(near, chunks, asked * settings.initial_chunks_k).join(queries.select("query_id", "text"), "query_id")
        near = near.withColumn("score", score(F.col("text"), F.col("content"))).drop("content", "text")
    return rerank(near, F.col("score"), settings.final_chunks_k).select("query_id", "chunk_id", "doc", "rank", "pair_score")


#: What a question that can't be searched is told.
NO_SOURCE, NO_DOCUMENTS = "unknown source", "no documents"


def searchable(queries: DataFrame, sources: DataFrame, index: LexicalIndex, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The questions that can be searched, and query_id, error of the others: a source (of queries) that isn't among `sources` (name),
    or one without documents. A question without a source asks all of them. Errors are rows, so one bad question doesn't end a batch."""
    held = index.corpus.where("n > 0").select(F.col("scope").alias("_held"))
    every = held.agg((F.count("*") > 0).alias("_any"))
    rows = queries.join(sources.select(F.col("name").alias("_named")).distinct(), F.col(source) == F.col("_named"), "left").join(held, F.col(source) == F.col("_held"), "left").join(F.broadcast(every))
    asked = F.nullif(F.col(source), F.lit(""))
    error = F.when(asked.isNotNull() & F.col("_named").isNull(), NO_SOURCE).when(F.when(asked.isNull(), F.col("_any")).otherwise(F.col("_held").isNotNull()) == F.lit(False), NO_DOCUMENTS)
    rows = rows.withColumn("error", error)
    return rows.where("error is null").select(*queries.columns), rows.where("error is not null").select("query_id", "error")

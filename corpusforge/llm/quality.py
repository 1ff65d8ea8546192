"""Quality by hierarchical empirical Bayes.

A classifier of the text's form and words gives each document a probability; hosts and the paths below them get posteriors from the
probabilities of all their documents, a sparse path drawn to its host and a sparse host to the whole corpus, as strongly as
the spread between hosts and between paths says. The document's evidence and its site's posterior are then combined.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import ASCII_SPACE, LOWER, Stored, mix, powers, small_batches, text_slices, tidy

#: Labelled rows that the classifier is fitted on, the first by a hash of the id: documented bound of the sample.
SAMPLE = 6000
#: Score from which a document is kept.
KEEP = 0.5
#: Places that words are hashed to, documents' worth of the prior of each place, and tasks that count words (their sums go to the driver).
PLACES, PRIOR, TASKS = 1 << 15, 4.0, 16
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC6BC279692B5C323))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Kinds of bytes counted: capitals, small letters, digits, line ends, bars, other signs of ASCII, marks of a sentence.
_KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", b"|", b"!\"#$%&'()*+-/<=>?@[\\]^_`{}~", b".,;:"]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _k in enumerate(_KINDS):
    _KIND[[*_k]] = _i


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the texts: first byte, end, text, and a hash of the word in small letters."""
    space = ASCII_SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = ~space
    if len(data):
        begin[1:] &= space[:-1] | fresh[1:-1]
    at = np.flatnonzero(begin)
    stop = np.flatnonzero(space | fresh[:-1])
    end = np.append(stop, len(data))[np.searchsorted(stop, at, "right")]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * powers(_BASE, len(data)), dtype=np.uint64, out=sums[1:])
    word = mix((sums[end] - sums[at]) * powers(_INVERSE, len(data))[at]) if len(at) else np.zeros(0, np.uint64)
    return at, end, np.searchsorted(offsets, at, "right") - 1, word


def _distinct(of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts and places of their distinct words."""
    by = np.lexsort((word, of))
    w, o = word[by], of[by]
    first = np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1]))[: len(w)]
    return o[first], (w[first] & np.uint64(PLACES - 1)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, tables: Iterable[np.ndarray] = ()) -> np.ndarray:
    """Numbers that describe the form of each text: shares of kinds of bytes, word repetition, word length, size; and for each table
    the mean log odds of the text's distinct words."""
    docs, tables = len(offsets) - 1, list(tables)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(docs), size)
    kinds = np.bincount(doc * 8 + _KIND[data], minlength=docs * 8).reshape(docs, 8) / np.maximum(size, 1)[:, None]
    at, end, of, word = _words(data, offsets)
    if not len(at):
        return np.concatenate([kinds, np.zeros((docs, 5 + len(tables)))], 1)
    words = np.bincount(of, minlength=docs)
    some = np.maximum(words, 1)
    again = np.append(False, (word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    text, place = _distinct(of, word)
    distinct = np.bincount(text, minlength=docs)
    repeated = np.bincount(of, again, docs) / some
    length = np.bincount(of, end - at, docs) / some
    said = [(np.bincount(text, t[place], docs) / np.maximum(distinct, 1))[:, None] for t in tables]
    return np.concatenate([kinds, repeated[:, None], (distinct / some)[:, None], (np.minimum(length, 40) / 10)[:, None], np.log1p(words)[:, None] / 10, (distinct / np.sqrt(some))[:, None] / 10, *said], 1)


def log_odds(held: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Of each place, how much likelier a good document has one of its words: held (2 x places) counts the bad and the good documents
    that have one, documents all of them. A place that few documents have is drawn to 0, and a word never seen says nothing."""
    share = documents / max(documents.sum(), 1)
    bad, good = held / np.maximum(share, 1e-9)[:, None]
    return np.log((good + PRIOR) / (bad + PRIOR)).astype(np.float32)


@dataclass
class Classifier:
    """Logistic weights of the features; table: log odds of hashed words, whose mean is one more feature (None: form alone)."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    table: np.ndarray | None = None

    def tables(self) -> list[np.ndarray]:
        return [] if self.table is None else [self.table]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


def _featured(df: DataFrame, names: list[str], classifier: Classifier | None = None, tables: Iterable[np.ndarray] = ()) -> DataFrame:
    """The named columns, and of the text (last column) the features, or the probability."""
    kinds = dict(df.dtypes)
    used = list(tables) if classifier is None else classifier.tables()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(data, offsets, used) for _, _, data, offsets in text_slices(batch.column(len(names)))]
            x = np.concatenate(x) if x else np.zeros((0, 13 + len(used)))
            value = pa.array(list(x), pa.list_(pa.float64())) if classifier is None else pa.array(classifier.probability(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], value], [*names, "x" if classifier is None else "p"])

    return df.mapInArrow(tidy(run), ", ".join(f"`{n}` {kinds[n]}" for n in names) + (", x array<double>" if classifier is None else ", p double"))


def _held(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (y, half, text): how many documents of each half and label have a word of each place, and how many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(4 * PLACES, np.int32), np.zeros(4, np.int64)
        for batch in batches:
            kind = batch.column(1).to_numpy().astype(np.int64) * 2 + (batch.column(0).to_numpy() > 0.5)
            documents += np.bincount(kind, minlength=4)
            for i, j, data, offsets in text_slices(batch.column(2)):
                _, _, of, word = _words(data, offsets)
                text, place = _distinct(of, word)
                at = np.unique(text * PLACES + place)
                held += np.bincount(kind[i:j][at // PLACES] * PLACES + at % PLACES, minlength=4 * PLACES).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary()), pa.array([documents.tobytes()], pa.binary())], ["held", "documents"])

    got = rows.select("y", "half", "text").coalesce(TASKS).mapInArrow(tidy(run), "held binary, documents binary").collect()  # a row of fixed size for each of TASKS tasks
    held = sum((np.frombuffer(r["held"], np.int32).astype(np.int64) for r in got), np.zeros(4 * PLACES, np.int64))
    return held.reshape(2, 2, PLACES), sum((np.frombuffer(r["documents"], np.int64) for r in got), np.zeros(4, np.int64)).reshape(2, 2)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier | None:
    """A ridge logistic classifier of form and words, fitted by Newton's method on at most `sample` labelled rows (None without rows of
    both labels). The words' log odds of one half of the rows are the other half's feature, so that their weight is learned on
    documents that they weren't counted on; the classifier's own are those of all rows. Repeated rows count each."""
    small_batches(documents.sparkSession)
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null")
    own = own.orderBy(F.xxhash64("id"), "y").limit(sample)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(own), "id")  # at most `sample` rows
    rows = Stored(rows.select("y", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text"), "labelled")
    held, number = _held(rows.read())
    got = _featured(rows.read(), ["y", "half"], tables=[log_odds(held[k], number[k]) for k in (1, 0)]).collect()
    rows.drop()
    y = np.array([r["y"] > 0.5 for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([[*r["x"][:13], r["x"][13 + r["half"]]] for r in got])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, grad)
    return Classifier(mean, scale, w, log_odds(held.sum(0), number.sum(0)))


def _strength(groups: DataFrame, mean: float) -> float:
    """How many documents' worth the prior of a group is: from the spread of group means around their parents', by moments."""
    r = groups.agg(F.sum(F.col("n") * (F.col("p") - F.col("parent")) ** 2).alias("v"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    between = max((r["v"] or 0.0) - mean * (1 - mean) * (r["k"] or 0), 0.0) / max(r["n"] or 1, 1)
    return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 2.0, 1e4))


def score(documents: DataFrame, classifier: Classifier | None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep: float = KEEP) -> DataFrame:
    """id, p (by the text alone), site (posterior of its host and path), score, keep of every document.

    A table of documents without addresses has its source for a host and its language, within the source, for a path: the
    groups that its documents come in. Null hosts and paths are groups of their own. A null or empty text is scored by its
    form like any other, and a very long one is measured whole, with some tens of bytes for each of its own. Without a
    classifier all documents have 0.5. A score equal to `keep` is kept. Each row has a row; repeated rows count each. An empty
    table gives no rows. Other columns are left out.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))
    scored = _featured(rows, ["id", "host", "path"], classifier) if classifier is not None else rows.select("id", "host", "path", F.lit(0.5).alias("p"))
    scored = Stored(scored, "scored")
    paths = scored.read().groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(np.clip((whole["s"] or 0.5) / (whole["n"] or 1), 1e-4, 1 - 1e-4))
    hosts = hosts.withColumns({"p": F.col("s") / F.col("n"), "parent": F.lit(mean)})
    a = _strength(hosts, mean)
    hosts = hosts.select("host", ((F.col("s") + a * mean) / (F.col("n") + a)).alias("parent"))
    paths = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "p.path", "n", "s", "parent").withColumn("p", F.col("s") / F.col("n"))
    b = _strength(paths, mean)
    sites = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), ((F.col("s") + b * F.col("parent")) / (F.col("n") + b)).alias("site"))
    joined = scored.read().join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    logit = lambda c: F.log(F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9)) / (1 - F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))))
    total = logit(F.col("p")) + logit(F.col("site")) - float(np.log(mean / (1 - mean)))
    value = 1 / (1 + F.exp(-total))
    return joined.select(F.col("id").alias(id_col), "p", "site", value.alias("score"), (value >= keep).alias("keep"))

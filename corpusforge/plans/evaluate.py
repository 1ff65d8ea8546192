"""Measures of retrieval and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall_precision(hits: DataFrame, relevant: DataFrame, ks: list[int], short_circuit: bool = False) -> DataFrame:
    """type, k, recall, precision: means over questions of the ranked hits (query_id, id, rank) against relevant (query_id, type,
    id). Precision is by k; a question without relevant ids has recall 0. short_circuit: once all are found, larger k count as recall 1."""
    wanted = relevant.groupBy("query_id", "type").agg(F.count_if(F.col("id").isNotNull()).alias("n"))
    good = hits.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi")
    grid = wanted.select("query_id", "type", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = grid.join(good.select("query_id", "rank"), "query_id", "left").groupBy("query_id", "type", "n", "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("found"))
    if short_circuit:
        full = F.max((F.col("found") >= F.col("n")) & (F.col("n") > 0)).over(Window.partitionBy("query_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        found = found.withColumn("found", F.when(full, F.col("n")).otherwise(F.col("found")))
    rows = found.select("type", "k", F.when(F.col("n") == 0, 0.0).otherwise(F.col("found") / F.col("n")).alias("r"), (F.col("found") / F.col("k")).alias("p"))
    return rows.groupBy("type", "k").agg(F.avg("r").alias("recall"), F.avg("p").alias("precision"))


def ranking(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over all questions: accuracy, precision and recall at 1 and 5; ndcg, mrr and map at k."""
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = hits.where(F.col("rank") <= k).join(relevant.select("query_id", "id", F.lit(1).alias("rel")), ["query_id", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    so_far = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far)
    at = lambda m: F.sum(F.when(F.col("rank") <= m, F.col("rel")).otherwise(0))
    each = rows.groupBy("query_id").agg(
        at(1).alias("h1"), at(5).alias("h5"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.max(F.when(F.col("rel") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(F.when(F.col("rel") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    full = wanted.join(each, "query_id", "left").na.fill(0).withColumn("ideal", ideal)
    return full.agg(
        F.avg((F.col("h1") > 0).cast("double")).alias("accuracy_1"), F.avg((F.col("h5") > 0).cast("double")).alias("accuracy_5"), F.avg("h1").alias("precision_1"), F.avg(F.col("h5") / 5).alias("precision_5"),
        F.avg(F.col("h1") / F.col("n")).alias("recall_1"), F.avg(F.col("h5") / F.col("n")).alias("recall_5"), F.avg(F.col("dcg") / F.col("ideal")).alias("ndcg"), F.avg("rr").alias("mrr"), F.avg(F.col("ap") / F.least(F.col("n"), F.lit(k))).alias("map"),
    )


def confusion(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    p, y = F.col(predicted) == 1, F.col(label) == 1
    counts = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumn("accuracy", F.when(total > 0, 100.0 * (F.col("tp") + F.col("tn")) / total))


def weighted_scores(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """accuracy and, weighted by how often each label stands, precision, recall and f1."""
    labels = rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), F.count_if(F.col(predicted) == F.col(label)).alias("tp"))
    named = rows.groupBy(F.col(predicted).alias("l")).agg(F.count("*").alias("m"))
    each = labels.join(named, "l", "left").select("n", "tp", F.when(F.coalesce("m", F.lit(0)) > 0, F.col("tp") / F.col("m")).otherwise(0.0).alias("p"), (F.col("tp") / F.col("n")).alias("r"))
    each = each.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    w = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return each.agg((F.sum("tp") / F.sum("n")).alias("accuracy"), w("p").alias("precision"), w("r").alias("recall"), w("f").alias("f1"))


def cleaning_loss(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Words before and after cleaning (columns of counts), removed in all, in percent, and at most from one document."""
    gone = F.col(before) - F.col(after)
    return pairs.agg(F.sum(before).alias("words_before"), F.sum(after).alias("words_after"), F.sum(gone).alias("removed"), F.round(100.0 * F.sum(gone) / F.sum(before), 4).alias("percent"), F.max(gone).alias("most_removed"))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("mode").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))

"""Evaluation of rankings: run (query_id, rank, doc_id) against qrels (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with rel: whether the document is relevant to its query; a document twice in qrels counts once."""
    good = qrels.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    return run.join(good, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _per_query(run: DataFrame, qrels: DataFrame, value, k: int | None = None) -> DataFrame:
    """(query_id, value) for every query of run; n_rel is at hand in value."""
    totals = qrels.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_rel"))
    rows = judged(run, qrels)
    if k is not None:
        rows = rows.withColumn("rel", F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
    seen = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("seen", seen).groupBy("query_id").agg(
        F.sum("rel").alias("hits"),
        F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
    )
    return rows.join(totals, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0))).select("query_id", value.cast("double").alias("value"))


def _part(top, whole):
    return F.when(whole > 0, top / F.when(whole > 0, whole)).otherwise(0.0)


def precision_at_k(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Hits of the first k, over k even where fewer were returned; 0 for k under 1."""
    return _per_query(run, qrels, F.col("hits") / F.lit(k) if k > 0 else F.lit(0.0), max(k, 0))


def recall_at_k(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return _per_query(run, qrels, _part(F.col("hits"), F.col("n_rel")), k)


def dcg_at_k(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return _per_query(run, qrels, F.col("dcg"), k)


def ndcg_at_k(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """DCG over that of min(relevant, k) hits in front."""
    most = F.least(F.col("n_rel"), F.lit(k)).cast("int")
    ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return _per_query(run, qrels, _part(F.col("dcg"), ideal), k)


def average_precision(run: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """Mean precision at the hits over all relevant documents, also those beyond k."""
    return _per_query(run, qrels, _part(F.col("precisions"), F.col("n_rel")), k)


def reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return _per_query(run, qrels, F.coalesce(1 / F.col("first"), F.lit(0.0)))


def _mean(values: DataFrame) -> DataFrame:
    return values.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value"))


def mean_average_precision(run: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    return _mean(average_precision(run, qrels, k))


def mean_reciprocal_rank(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return _mean(reciprocal_rank(run, qrels))

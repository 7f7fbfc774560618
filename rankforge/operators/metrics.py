"""Document-level ranking metrics, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def document_ranking(ranking: DataFrame) -> DataFrame:
    """Documents by their first chunk."""
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).select("query_id", "doc_id", "pos")


def marks(qrels: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, gain, hit, listed`` of every judged document. Hits are documents of ``labels`` (``query_id, doc_id``; a query without any:
    those of positive relevance); gains are relevances (a query without any: 1 for each label). Without ``labels`` relevance says both."""
    if labels is None:
        return qrels.select("query_id", "doc_id", F.col("relevance").alias("gain"), (F.col("relevance") > 0).alias("hit"), (F.col("relevance") > 0).alias("listed"))
    both = labels.select("query_id", "doc_id", F.lit(True).alias("listed")).distinct().join(qrels.select("query_id", "doc_id", "relevance"), ["query_id", "doc_id"], "full")
    own = Window.partitionBy("query_id")
    named, rated = F.max(F.col("listed").isNotNull()).over(own), F.max(F.col("relevance").isNotNull()).over(own)
    listed = F.coalesce("listed", F.lit(False))
    return both.select("query_id", "doc_id", F.when(rated, F.coalesce("relevance", F.lit(0))).otherwise(listed.cast("int")).alias("gain"), F.when(named, listed).otherwise(F.coalesce("relevance", F.lit(0)) > 0).alias("hit"), listed.alias("listed"))


def retrieval_metrics(queries: DataFrame, ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, labels: DataFrame | None = None) -> DataFrame:
    """A row for each query and k; queries without relevant documents have 0 everywhere. ``qrels``: ``query_id, doc_id, relevance``; ``labels``: see
    :func:`marks`."""
    judged = marks(qrels, labels)
    docs = document_ranking(ranking).join(judged, ["query_id", "doc_id"], "left").withColumns({"gain": F.coalesce("gain", F.lit(0)), "hit": F.coalesce("hit", F.lit(False))})
    ideal = judged.where("hit or gain > 0").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")))
    share = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + F.lit(1.0))
    got, best = [], []
    for k in ks:
        top = F.col("pos") <= k
        got += [
            F.count_if(top & F.col("hit")).alias(f"hits{k}"), F.min(F.when(top & F.col("hit"), F.col("pos"))).alias(f"first{k}"),
            F.sum(F.when(top, share(F.col("gain"), F.col("pos"))).otherwise(0.0)).alias(f"dcg{k}"),
        ]
        best.append(F.sum(F.when(top & (F.col("gain") > 0), share(F.col("gain"), F.col("pos"))).otherwise(0.0)).alias(f"ideal{k}"))
    joined = queries.select("query_id").join(docs.groupBy("query_id").agg(*got, F.count("*").alias("retrieved")), "query_id", "left").join(ideal.groupBy("query_id").agg(*best, F.count_if("hit").alias("relevant"), F.count_if("listed").alias("listed")), "query_id", "left")
    rows = []
    for k in ks:
        hits = F.coalesce(f"hits{k}", F.lit(0))
        rows.append(F.struct(
            F.lit(k).alias("k"), F.round(hits / F.greatest(F.lit(1), F.coalesce("relevant", F.lit(0))), 6).alias("recall"), F.round(hits / k, 6).alias("precision"), F.when(hits > 0, 1.0).otherwise(0.0).alias("hit"),
            F.round(F.coalesce(1 / F.col(f"first{k}"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.try_divide(F.coalesce(f"dcg{k}", F.lit(0.0)), F.nullif(f"ideal{k}", F.lit(0.0))), F.lit(0.0)), 6).alias("ndcg"),
        ))
    return joined.select("query_id", F.coalesce("listed", F.lit(0)).alias("num_relevant_docs"), F.coalesce("retrieved", F.lit(0)).alias("num_retrieved_docs"), F.explode(F.array(*rows)).alias("m")).select("query_id", "num_relevant_docs", "num_retrieved_docs", "m.*")


def summary(metrics: DataFrame, *groups: str) -> DataFrame:
    names = ["recall", "precision", "hit", "mrr", "ndcg"]
    return metrics.groupBy(*groups).agg(F.count("*").alias("n_queries"), *[F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(f"mean_{n}") for n in names])


def wide(metrics: DataFrame) -> DataFrame:
    """One row a query: a column ``metric@k`` for each."""
    names = ["recall", "precision", "hit", "mrr", "ndcg"]
    ks = sorted(r["k"] for r in metrics.select("k").distinct().collect())  # a handful
    cells = [F.max(F.when(F.col("k") == k, F.col(n))).alias(f"{n}@{k}") for k in ks for n in names]
    return metrics.groupBy("query_id").agg(F.max("num_relevant_docs").cast("double").alias("num_relevant_docs"), F.max("num_retrieved_docs").cast("double").alias("num_retrieved_docs"), *cells)

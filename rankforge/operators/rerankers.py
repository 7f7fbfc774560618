"""Rerankers: candidates of each query in a new order. Candidates are ``query_id, rank, doc_id, chunk_index, score``; so is what is
returned, with ``candidate_rank`` added. Ties keep the candidates' order; queries without candidates have no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.text import tokenize
from rankforge.operators import models
from rankforge.operators.retrieval import CHUNK, keyword_rerank, ranked

#: English function words that carry no weight. A parameter of :func:`relevance_rerank`; the list is this package's own.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had "
    "has have having he her here hers him his how if in into is it its itself just may me might more most must my no nor not now of off on once only or other our out over own same shall she "
    "should so some such than that the their them then there these they this those through to too under until up upon very was we were what when where which while who whom why will with would you your"
).split()
#: A word: two or more letters, digits or low lines.
WORD = r"[\p{L}\p{N}_]{2,}"


def grams(text: Column, stop_words: list[str]) -> Column:
    """Words and pairs of neighbours, both after stop words are out. Words are found once, as a column of an inner array."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(stop_words))
    both = lambda w: F.concat(w, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))
    return F.flatten(F.transform(F.array(words), both))


def relevance_rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, stop_words: list[str] | None = None) -> DataFrame:
    """Cosine of TF-IDF vectors fitted on each question and its own candidates, plus a quarter of the share of question tokens that the
    chunk has, plus 0.05 over the candidate's rank.

    A query's candidates are as many as its retriever's ``k`` gives, so what is grouped by query and gram stays small; texts meet
    candidates in one join, and only grams and counts go on from there."""
    stop = STOP_WORDS if stop_words is None else stop_words
    asked = queries.select("query_id", F.col("text").alias("question"))
    texts = candidates.withColumnRenamed("rank", "was").join(chunks.select(*CHUNK, "text"), CHUNK).join(asked, "query_id")
    wanted = F.array_distinct(F.filter(tokenize(F.col("question")), lambda t: F.length(t) > 2))
    covered = F.size(F.array_intersect(wanted, tokenize(F.col("text")))) / F.greatest(F.lit(1), F.size(wanted))
    texts = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "query_id", "was")  # few rows, much work each
    # k candidates a query, used three times: kept, so that the search behind them runs once; what an executor loses is computed again
    items = texts.select("query_id", "was", *CHUNK, covered.alias("coverage"), grams(F.col("text"), stop).alias("grams")).persist(StorageLevel.MEMORY_AND_DISK)
    # rank 0 is the question itself, one row a query that has candidates
    question = asked.join(items.select("query_id").distinct(), "query_id").select("query_id", F.lit(0).alias("was"), grams(F.col("question"), stop).alias("grams"))
    every = items.select("query_id", "was", "grams").unionByName(question)
    tf = every.select("query_id", "was", F.explode("grams").alias("gram")).groupBy("query_id", "gram", "was").agg(F.count("*").alias("tf"))
    size = items.groupBy("query_id").agg((F.count("*") + 1).alias("n"))
    same = Window.partitionBy("query_id", "gram")
    weight = F.col("tf") * (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    weighted = tf.withColumn("df", F.count("*").over(same)).join(size, "query_id").withColumn("w", weight).withColumn("q", F.max(F.when(F.col("was") == 0, F.col("w"))).over(same))
    sums = weighted.groupBy("query_id", "was").agg(F.sum(F.col("w") * F.coalesce("q", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    own = F.max(F.when(F.col("was") == 0, F.col("norm"))).over(Window.partitionBy("query_id"))
    near = sums.select("query_id", "was", F.try_divide("dot", F.col("norm") * own).alias("cosine")).where("was > 0")
    scored = items.drop("grams").join(near, ["query_id", "was"], "left")
    score = F.coalesce("cosine", F.lit(0.0)) + 0.25 * F.col("coverage") + 0.05 / F.greatest(F.lit(1), "was")
    return ranked(scored.withColumn("score", F.round(score, 8)), k, "was").select("query_id", "rank", *CHUNK, "score", F.col("was").alias("candidate_rank"))


def model_rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, *, model: models.Generator) -> DataFrame:
    """The order that a model names: it is asked for a JSON list of ``chunk_ids``; unknown identifiers go, repeated ones count once. Questions
    for which it names none that are candidates are reranked by :func:`relevance_rerank`. ``chunks`` need ``chunk_id``."""
    texts = candidates.withColumnRenamed("rank", "was").join(chunks.select(*CHUNK, "chunk_id", "text"), CHUNK)
    line = F.format_string("%d. %s\n%s", F.col("was"), F.col("chunk_id"), F.substring("text", 1, 700))
    listed = texts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("was", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("listed"))
    prompt = F.format_string("Rank the passages by how well they answer the question.\nQuestion: %s\n\nPassages:\n%s\n\nReply with JSON: {\"chunk_ids\": [...]}, at most " + str(k) + ".", F.col("text"), F.col("listed"))
    replies = models.generate(listed.join(queries.select("query_id", "text"), "query_id").select("query_id", prompt.alias("prompt")), model)
    # a model is asked once: both branches read the same replies
    replies = models.kept(replies)
    named = F.array_distinct(F.coalesce(F.from_json("reply", "chunk_ids array<string>")["chunk_ids"], F.array().cast("array<string>")))
    order = replies.select("query_id", F.posexplode(named).alias("pos", "chunk_id"))
    hits = texts.join(order, ["query_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "was"))
    chosen = hits.withColumn("rank", place).where(F.col("rank") <= k).withColumn("score", (k - F.col("rank") + 1).cast("double"))
    chosen = chosen.select("query_id", "rank", *CHUNK, "score", F.col("was").alias("candidate_rank"))
    rest = candidates.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return chosen.unionByName(relevance_rerank(rest, chunks, queries, k))


def make_reranker(name: str | None, model: models.Generator | None = None) -> Callable[..., DataFrame]:
    """``llm``: by a model (which must be given; the offline one names nothing, so it falls back); ``local...`` and ``tfidf...``: by TF-IDF;
    any other name: by shared keywords."""
    name = (name or "").lower()
    if name in ("llm", "llm_reranker"):
        if model is None:
            raise ValueError("this reranker needs a model")
        return lambda *args: model_rerank(*args, model=model)
    return relevance_rerank if name.startswith(("local", "tfidf")) else keyword_rerank

"""Retrieval over chunks for a batch of queries: BM25, hashed vectors, rank fusion, reranking, parents.

Queries are a stated set (``query_id, text``); chunks any number. Rankings are ``query_id, rank, doc_id, chunk_index, score``;
ties go to the earlier chunk (document, index).
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.text import BUCKETS, TOKEN, tokenize

CHUNK = ["doc_id", "chunk_index"]
#: Queries scored at once against all chunks; more come in blocks of this size.
QUERY_BLOCK = 2000


def ranked(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *(F.col(c) for c in (ties or CHUNK)))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens of each chunk, and one row with the number of chunks and their mean length."""
    tokens = chunks.select(*CHUNK, tokenize(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    return tokens, tokens.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))


def hashed_vector(tokens: list[str], known: dict[str, tuple[int, int]]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for t in tokens:
        if t not in known:
            d = int(hashlib.sha256(t.encode()).hexdigest()[:16], 16)
            known[t] = d % BUCKETS, 1 if d // BUCKETS % 2 == 0 else -1
        at, sign = known[t]
        out[at] += sign
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def _top_of_parts(frame: DataFrame, keys: list[str], score_of, n_queries: int, asked, k: int) -> DataFrame:
    """Each partition's best ``k`` rows for each query: what is shuffled then is bounded a task. ``score_of(column, asked, known)`` gives rows by queries; what
    it learns of tokens it may keep in ``known``."""
    sent = frame.sparkSession.sparkContext.broadcast(asked)
    kinds = dict(frame.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", query long, score double"

    def run(batches):
        known = {}
        held, scores = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                new = np.round(score_of(part.column(len(keys)), sent.value, known), 12)  # halves stay halves whatever the order of sums
                new = np.copysign(np.floor(np.abs(new) * 1e6 + 0.5) / 1e6, new) + 0.0  # half away from zero, as SQL rounds
                rows = [part.column(i).to_pandas(integer_object_nulls=True).to_numpy() for i in range(len(keys))]
                if held is None:
                    ids, values = [np.broadcast_to(r[:, None], new.shape) for r in rows], new
                else:
                    ids = [np.concatenate([h, np.broadcast_to(r[:, None], new.shape)]) for h, r in zip(held, rows, strict=True)]
                    values = np.concatenate([scores, new])
                order = np.empty_like(values, dtype="i8")
                for q in range(values.shape[1]):
                    order[:, q] = np.lexsort([*(i[:, q] for i in reversed(ids)), -values[:, q]])
                order = order[:k]
                held, scores = [np.take_along_axis(i, order, 0) for i in ids], np.take_along_axis(values, order, 0)
                if len(known) > 500_000:
                    known.clear()
        if held is not None:
            n = scores.shape[0]
            arrays = [pa.array(h.T.ravel().tolist()) for h in held]
            yield pa.RecordBatch.from_arrays([*(a.cast(batch.schema.field(i).type) for i, a in enumerate(arrays)), pa.array(np.repeat(np.arange(n_queries), n)), pa.array(scores.T.ravel())], names=[*keys, "query", "score"])

    return frame.mapInArrow(run, schema)


def exact_search(frame: DataFrame, keys: list[str], score_of, queries: list, asked_of, k: int) -> DataFrame:
    """The best ``k`` rows of each query (identifiers are unique), queries in blocks; ``asked_of(from, to)`` is what ``score_of`` needs of a block."""
    out = None
    for at in range(0, max(1, len(queries)), QUERY_BLOCK):
        end = min(at + QUERY_BLOCK, len(queries))
        some = _top_of_parts(frame, keys, score_of, end - at, asked_of(at, end), k).withColumn("query", F.col("query") + at)
        out = some if out is None else out.unionByName(some)
    names = frame.sparkSession.createDataFrame([(n, q) for n, q in enumerate(queries)], f"query long, query_id {'long' if not queries or isinstance(queries[0], int) else 'string'}")
    best = out.join(names, "query").drop("query")
    return ranked(best, k, *keys).select("query_id", "rank", *keys, "score")


def document_frequency(chunks: DataFrame, terms: list[str]) -> tuple[np.ndarray, int, float]:
    """In one pass: how many chunks hold each of these terms, the number of chunks, their mean length. Tasks send a count a term, no postings."""
    sent = chunks.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def run(batches):
        place, token, count, rows, length = sent.value, re.compile(TOKEN), np.zeros(len(sent.value), "i8"), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = token.findall(text or "")
                rows, length = rows + 1, length + len(found)
                count[[place[t] for t in {t.lower() for t in found} if t in place]] += 1
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), -1, -2]), pa.array([*count[held].tolist(), rows, length])], names=["term", "n"])

    got = {r["term"]: r["n"] for r in chunks.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = got.get(-1, 0)
    return np.array([got.get(t, 0) for t in range(len(terms))], "f8"), n, got.get(-2, 0) / n if n else 0.0


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, idf: str = "plus_one") -> DataFrame:
    """Top chunks of each query; chunks without a query term have score 0 and fill up to ``k``, earlier ones first.

    The stated queries' terms go to all tasks as postings (term to queries), each task scores its own chunks and keeps ``k`` a query: no
    posting of the corpus is shuffled, and a frequent term burdens no single task."""
    rows = queries.select("query_id", "text").orderBy("query_id").collect()  # the stated query set
    token = re.compile(TOKEN)
    asked = [Counter(t.lower() for t in token.findall(r["text"] or "")) for r in rows]
    place = {t: n for n, t in enumerate(sorted({t for q in asked for t in q}))}
    df, n, mean = document_frequency(chunks, list(place))
    raw = (n - df + 0.5) / (df + 0.5)
    weight = np.where(df > 0, np.log(1 + raw if idf == "plus_one" else np.maximum(raw, 1e-300)), 0.0)

    def postings(at: int, end: int):
        """Queries and weights of each term, terms one after the other, and where each begins."""
        each = sorted((place[t], q, m) for q, terms in enumerate(asked[at:end]) for t, m in terms.items())
        ids = np.array([e[0] for e in each], "i8")
        begins = np.searchsorted(ids, np.arange(len(place) + 1))
        return place, begins, np.array([e[1] for e in each], "i8"), np.array([e[2] for e in each], "f8") * weight[ids], end - at, mean

    def score(texts, asked, _):
        place, begins, query, worth, n_queries, mean = asked
        token, out = re.compile(TOKEN), np.zeros((len(texts), n_queries))
        for row, text in enumerate(texts.to_pylist()):
            found = [t.lower() for t in token.findall(text or "")]
            counted = Counter(t for t in found if t in place)
            if not counted:
                continue
            ids, tf = np.array([place[t] for t in counted]), np.array(list(counted.values()), "f8")
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(found) / max(mean, 1e-9)))
            many = begins[ids + 1] - begins[ids]
            at = np.repeat(begins[ids] - np.cumsum(many) + many, many) + np.arange(many.sum())
            out[row] = np.bincount(query[at], np.repeat(part, many) * worth[at], n_queries)
        return out

    return exact_search(chunks.select(*CHUNK, "text"), CHUNK, score, [r["query_id"] for r in rows], postings, k)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Top chunks by the cosine of hashed token vectors; every chunk is scored, also those with negative scores."""
    rows = queries.select("query_id", "text").orderBy("query_id").collect()  # the stated query set
    token, known = re.compile(TOKEN), {}
    vectors = np.array([hashed_vector([t.lower() for t in token.findall(r["text"] or "")], known) for r in rows]).reshape(-1, BUCKETS)

    def score(texts, asked, known):
        return np.array([hashed_vector([t.lower() for t in token.findall(t_ or "")], known) for t_ in texts.to_pylist()]).reshape(-1, BUCKETS) @ asked.T

    return exact_search(chunks.select(*CHUNK, "text"), CHUNK, score, [r["query_id"] for r in rows], lambda at, end: vectors[at:end], k)


def array_search(items: DataFrame, id_col: str | list[str], vector_col: str, queries: DataFrame, k: int) -> DataFrame:
    """Top rows by inner product of stored vectors; rows are named by one column or several."""
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = queries.select("query_id", vector_col).orderBy("query_id").collect()
    vectors = np.array([r[vector_col] for r in rows], "f8")

    def score(column, asked, _):
        return np.array(column.to_pylist(), "f8").reshape(len(column), -1) @ asked.T if asked.ndim == 2 else np.zeros((len(column), 0))

    return exact_search(items.select(*keys, vector_col), keys, score, [r["query_id"] for r in rows], lambda at, end: vectors[at:end], k)


def fuse(every: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over the sources (``source``, a number) of one table of rankings; ties go to what was seen first (source in
    order, then rank)."""
    fused = every.groupBy("query_id", *CHUNK).agg(F.round(F.sum(1 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("source", "rank")).alias("seen"), F.count("*").alias("n_sources"))
    fused = fused.select("query_id", *CHUNK, "score", "n_sources", F.col("seen.source").alias("s"), F.col("seen.rank").alias("r"))
    return ranked(fused, k, "s", "r").select("query_id", "rank", *CHUNK, "score", "n_sources")


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int = 5, constant: int = 60) -> DataFrame:
    """:func:`fuse` over named rankings."""
    every = None
    for n, frame in enumerate(rankings.values()):
        some = frame.select("query_id", *CHUNK, "rank", F.lit(n).alias("source"))
        every = some if every is None else every.unionByName(some)
    return fuse(every, k, constant)


def best_of_variants(ranking: DataFrame) -> DataFrame:
    """Each chunk once a query, with its best score over variants (``variant``; the first wins ties)."""
    order = Window.partitionBy("query_id", *CHUNK).orderBy(F.col("score").desc(), "variant")
    return ranking.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def candidates(ranking: DataFrame) -> DataFrame:
    """All chunks that a query's variants found, each once with its best score, ranked anew; ties go to what was seen first."""
    best = ranking.groupBy("query_id", *CHUNK).agg(F.max("score").alias("score"), F.min(F.struct("variant", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return best.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", *CHUNK, "score")


def keyword_rerank(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Distinct query tokens of three letters or more in the chunk, then the candidate's rank and score."""
    asked = queries.select("query_id", F.array_distinct(F.filter(tokenize(F.col("text")), lambda t: F.length(t) > 2)).alias("asked"))
    found = candidates.withColumnRenamed("rank", "was").join(chunks.select(*CHUNK, tokenize(F.col("text")).alias("tokens")), CHUNK).join(asked, "query_id")
    score = F.size(F.array_intersect("asked", "tokens")) + 1 / (F.col("was") + 1000) + 0.001 * F.col("score")
    return ranked(found.withColumn("score", F.round(score, 10)), k, "was").select("query_id", "rank", *CHUNK, "score", F.col("was").alias("candidate_rank"))


def parents_of(children: DataFrame, kids: DataFrame, k: int = 4) -> DataFrame:
    """Best child score a parent, with the children that matched in rank order."""
    linked = children.join(kids, CHUNK)
    best = linked.groupBy("query_id", "parent_chunk_id").agg(F.max("score").alias("score"), F.min("rank").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_index"))), lambda c: c["chunk_index"]).alias("matched"))
    return ranked(best, k, "first").select("query_id", "rank", "parent_chunk_id", "score", F.array_join("matched", ",").alias("matched"))

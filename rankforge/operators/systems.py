"""Composite retrieval systems over batches of questions, in one registry.

A system is ``retrieve(docs, queries, options, model) -> query_id, rank, chunk_id, doc_id, text, score``: the contexts of every question. ``docs``:
``doc_id, text``; ``queries``: ``query_id, text``. Options are those of an experiment file's system. Texts join the ranking
at the end only. Questions whose wordings are all too short (see ``query_variants``) find nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.cost import model_cost
from rankforge.functions.queries import query_variants
from rankforge.functions.text import estimate_tokens
from rankforge.operators import chunking, models, retrieval
from rankforge.operators.rerankers import make_reranker
from rankforge.operators.retrieval import CHUNK, ranked

MARK = "\x1f"


@dataclass
class Options:
    """``chunker``, ``retrieval`` and ``features`` of a system, as an experiment file states them."""

    chunker: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)
    features: dict = field(default_factory=dict)
    embedder: models.Embedder | None = None  # none: hashed token vectors

    def number(self, *names: str, default: int) -> int:
        """The first of these retrieval options that is stated and not zero."""
        return next((int(self.retrieval[n]) for n in names if self.retrieval.get(n)), default)


def chunks_of(docs: DataFrame, options: Options) -> DataFrame:
    """The chunk table, once for all uses of it; what an executor loses of it is computed again."""
    made = {"size": options.chunker.get("chunk_size"), "overlap": options.chunker.get("chunk_overlap")}
    out = chunking.make_chunks(docs, options.chunker.get("type", "token"), **{k: int(v) for k, v in made.items() if v is not None})
    return out.select("chunk_id", *CHUNK, "text").persist(StorageLevel.MEMORY_AND_DISK)


def wordings(queries: DataFrame, texts: Column) -> DataFrame:
    """A row for each wording of a question: ``query_id`` (question and number), ``asked`` (the question), ``variant, text``."""
    out = queries.select(F.col("query_id").alias("asked"), F.posexplode(texts).alias("variant", "text"))
    return out.withColumn("query_id", F.concat_ws(MARK, F.col("asked").cast("string"), F.col("variant").cast("string")))


def of_questions(ranking: DataFrame, queries: DataFrame) -> DataFrame:
    """A ranking of wordings with the question's own identifier and ``variant``."""
    parts, kind = F.split("query_id", MARK), dict(queries.dtypes)["query_id"]
    return ranking.withColumns({"variant": parts[1].cast("int"), "query_id": parts[0].cast(kind)})


def _variants(queries: DataFrame, options: Options, default: bool = False) -> DataFrame:
    if options.retrieval.get("multi_query", default):
        return wordings(queries, query_variants(F.col("text"), options.number("max_query_variants", default=4)))
    return wordings(queries, F.array("text"))


def dense(chunks: DataFrame, asked: DataFrame, k: int, options: Options) -> DataFrame:
    """Vector search by the system's embedder, or by hashed tokens."""
    if options.embedder is None:
        return retrieval.vector_search(chunks, asked, k)
    stored = models.embed(chunks.select(*CHUNK, "text"), options.embedder)
    return retrieval.array_search(stored, CHUNK, "embedding", models.embed(asked.select("query_id", "text"), options.embedder), k)


def embedding_tokens(chunks: DataFrame, embedder: models.Embedder | None) -> tuple[int, float]:
    """Estimated tokens of all texts that are embedded, and what they cost at the embedder's price; nothing without one."""
    if embedder is None:
        return 0, 0.0
    n = F.coalesce(F.sum(estimate_tokens(F.col("text"))), F.lit(0))
    row = chunks.agg(n.alias("n"), model_cost(F.lit(embedder.name), n, F.lit(0)).alias("cost")).first()
    return row["n"], row["cost"]


def _with_texts(ranking: DataFrame, chunks: DataFrame) -> DataFrame:
    return ranking.join(chunks, CHUNK).select("query_id", "rank", "chunk_id", "doc_id", "text", "score")


def bm25(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    chunks = chunks_of(docs, options)
    return _with_texts(retrieval.bm25(chunks, queries, options.number("top_k", default=5)), chunks)


def vector(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    chunks = chunks_of(docs, options)
    return _with_texts(dense(chunks, queries, options.number("top_k", default=5), options), chunks)


def hybrid(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    """Reciprocal ranks of BM25 and vectors over all wordings; each wording's BM25 comes before its vectors on ties."""
    chunks, asked = chunks_of(docs, options), _variants(queries, options)
    lexical = of_questions(retrieval.bm25(chunks, asked, options.number("bm25_top_k", default=20)), queries).withColumn("source", F.col("variant") * 2)
    by_vectors = of_questions(dense(chunks, asked, options.number("vector_top_k", default=20), options), queries).withColumn("source", F.col("variant") * 2 + 1)
    fused = retrieval.fuse(lexical.unionByName(by_vectors), options.number("final_top_k", "top_k", default=5), options.number("rrf_k", default=60))
    return _with_texts(fused, chunks)


def rerank(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    """Vectors over all wordings, each chunk with its best score, reranked against the question itself."""
    chunks = chunks_of(docs, options)
    found = of_questions(dense(chunks, _variants(queries, options), options.number("candidate_top_k", default=30), options), queries)
    order = make_reranker(options.retrieval.get("reranker"), model)
    return _with_texts(order(retrieval.candidates(found), chunks, queries, options.number("final_top_k", "top_k", default=5)), chunks)


def parent_doc(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    """Children are searched, their parents returned; a parent's score is its best child's."""
    size = lambda side, *d: tuple(int(options.chunker.get(f"{side}_chunk_{n}", x)) for n, x in zip(("size", "overlap"), d, strict=True))
    parents, kids = chunking.chunk_parents(docs, size("parent", 1000, 150), size("child", 250, 50))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "child_index")) - 1
    kids = kids.withColumn("chunk_index", number).persist(StorageLevel.MEMORY_AND_DISK)
    found = dense(kids, queries, options.number("top_k_children", default=8), options)
    best = retrieval.parents_of(found, kids.select(*CHUNK, "parent_chunk_id"), options.number("top_k_parents", "top_k", default=4))
    return best.join(parents.withColumnRenamed("chunk_id", "parent_chunk_id"), "parent_chunk_id").select("query_id", "rank", F.col("parent_chunk_id").alias("chunk_id"), "doc_id", "text", "score")


def model_heavy(docs: DataFrame, queries: DataFrame, options: Options, model: models.Generator | None = None) -> DataFrame:
    """Chunks enriched by a model (if ``enable_llm_ingestion``) are searched with its wordings of the question (unless ``enable_query_rewrite``
    is false), reranked, and returned with their original texts. Replies that are not the wanted JSON: no enrichment, the question alone."""
    model, wanted = model or models.offline_generator(), options.features
    chunks = chunks_of(docs, options)
    searched, asked = chunks, wordings(queries, F.array("text"))
    if wanted.get("enable_llm_ingestion", False):
        prompt = F.concat(F.lit("Reply with JSON of the keys summary, key_entities (list) and hypothetical_questions (list) for this passage:\n"), F.substring("text", 1, 3500))
        said = models.kept(models.generate(chunks.withColumn("prompt", prompt), model))
        made = F.from_json("reply", "summary string, key_entities array<string>, hypothetical_questions array<string>")
        bad = F.from_json("reply", "map<string,string>").isNull()  # no JSON object at all
        summary = F.when(bad, F.substring("text", 1, 300)).otherwise(F.coalesce(made["summary"], F.lit("")))
        more = F.concat_ws("\n\n", "text", F.concat(F.lit("Summary: "), summary), F.concat(F.lit("Key entities: "), F.array_join(F.coalesce(made["key_entities"], F.array()), ", ")), F.concat(F.lit("Hypothetical questions: "), F.array_join(F.coalesce(made["hypothetical_questions"], F.array()), " ")))
        searched = said.select("chunk_id", *CHUNK, more.alias("text"))
    if wanted.get("enable_query_rewrite", True):
        prompt = F.concat(F.lit("Write 3 to 5 short search queries for the question. Reply with JSON: {\"queries\": [...]}.\nQuestion: "), F.col("text"))
        said = models.kept(models.generate(queries.select("query_id", "text", prompt.alias("prompt")), model))
        named = F.filter(F.transform(F.coalesce(F.from_json("reply", "queries array<string>")["queries"], F.array().cast("array<string>")), F.trim), lambda t: t != "")
        asked = wordings(said, F.when(F.size(named) > 0, F.slice(named, 1, 5)).otherwise(F.array("text")))
    found = of_questions(dense(searched, asked, options.number("per_query_top_k", default=10), options), queries)
    order = make_reranker("llm" if wanted.get("enable_llm_rerank", False) else options.retrieval.get("reranker"), model)
    return _with_texts(order(retrieval.candidates(found), chunks, queries, options.number("top_k", default=5)), chunks)


#: Systems by type; add your own functions of the same form.
SYSTEMS: dict[str, Callable[..., DataFrame]] = {"bm25": bm25, "vector": vector, "hybrid": hybrid, "rerank": rerank, "parent_doc": parent_doc, "llm_heavy": model_heavy}


def retrieve(kind: str, docs: DataFrame, queries: DataFrame, options: Options | None = None, model: models.Generator | None = None) -> DataFrame:
    if kind not in SYSTEMS:
        raise ValueError(f"unknown system: {kind}; known: {', '.join(sorted(SYSTEMS))}")
    return SYSTEMS[kind](docs, queries, options or Options(), model)


def contexts(found: DataFrame) -> DataFrame:
    """One text a question: its chunks in order, each under a header of its document and short identifier."""
    head = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit(" | "), F.element_at(F.split("chunk_id", "::chunk::"), -1), F.lit("]\n"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", head.alias("part"))))
    return found.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "\n\n").alias("context"))


def count_chunks(kind: str, docs: DataFrame, options: Options) -> int:
    """How many chunks a system searches."""
    if kind != "parent_doc":
        return chunks_of(docs, options).count()
    size = [(int(options.chunker.get(f"{s}_chunk_size", a)), int(options.chunker.get(f"{s}_chunk_overlap", b))) for s, a, b in (("parent", 1000, 150), ("child", 250, 50))]
    return chunking.chunk_parents(docs, *size)[1].count()

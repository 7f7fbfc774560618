"""Registered queries of the retrieval-evaluation operators, and their SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.functions.cost import PRICES, model_cost
from rankforge.functions.queries import ASKING, CLAUSE, query_variants
from rankforge.functions.text import estimate_tokens, hashed_bucket, stable_hash, tokenize, truncate
from rankforge.operators import chunking, judging, metrics, rerankers, retrieval, systems
from rankforge.sources.documents import html_text, html_title

SIZE, OVERLAP = 450, 70


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # one chunk table for all uses; what an executor loses of it is computed again
    return chunking.chunk_tokens(_table(spark, sf_dir, "documents"), SIZE, OVERLAP).persist(StorageLevel.MEMORY_AND_DISK)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunk_tokens(spark, sf_dir):
    return _chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_index", "start_char", "end_char", F.sha2("text", 256).alias("text_hash"))


def chunk_chars(spark, sf_dir):
    return chunking.chunk_chars(_table(spark, sf_dir, "documents")).select("chunk_id", "doc_id", "chunk_index", "start_char", "end_char", F.sha2("text", 256).alias("text_hash"))


def chunk_parents(spark, sf_dir):
    _, kids = chunking.chunk_parents(_table(spark, sf_dir, "documents"))
    return kids.select("doc_id", "parent_index", "child_index", "start_char", "end_char", F.sha2("text", 256).alias("text_hash"))


def term_statistics(spark, sf_dir):
    tokens, _ = retrieval.term_statistics(_chunks(spark, sf_dir))
    return tokens.select(F.explode("tokens").alias("term"), *retrieval.CHUNK).groupBy("term", *retrieval.CHUNK).agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_chunks(spark, sf_dir), _queries(spark, sf_dir), 5)


def vector_topk(spark, sf_dir):
    return retrieval.vector_search(_chunks(spark, sf_dir), _queries(spark, sf_dir), 5)


def hybrid_rrf(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    return retrieval.reciprocal_rank_fusion({"bm25": retrieval.bm25(chunks, queries, 20), "vector": retrieval.vector_search(chunks, queries, 20)}, 5)


def keyword_rerank(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    return retrieval.keyword_rerank(retrieval.vector_search(chunks, queries, 30), chunks, queries, 5)


def relevance_rerank(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    return rerankers.relevance_rerank(retrieval.vector_search(chunks, queries, 30), chunks, queries, 5)


def variant_candidates(spark, sf_dir):
    """Each question in two wordings, its text and the text's first eight words; the best score of each chunk over both."""
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    both = systems.wordings(queries, F.array(F.col("text"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ")))
    return retrieval.candidates(systems.of_questions(retrieval.vector_search(chunks, both, 10), queries))


def system_contexts(spark, sf_dir):
    """What the lexical system would hand to a generator: chunks under headers of document and short identifier."""
    options = systems.Options({"chunk_size": SIZE, "chunk_overlap": OVERLAP}, {"top_k": 3})
    found = systems.retrieve("bm25", _table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir), options)
    return systems.contexts(found).select("query_id", F.sha2("context", 256).alias("context_hash"))


def chunk_markdown(spark, sf_dir):
    """Every line of a document as a heading."""
    lined = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n## ").alias("text"))
    return chunking.chunk_markdown(lined, 50, 10).select("chunk_id", "doc_id", "chunk_index", "section", "section_chunk", "start_char", "end_char", F.sha2("text", 256).alias("text_hash"))


def graded_labels(spark, sf_dir):
    """Metrics whose hits (even documents of quality 1; English has none of these) and gains (quality and language) come from two tables; questions are languages."""
    docs, rated = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = docs.select("doc_id", "lang", "n_chars").join(rated, "doc_id")
    ranking = known.withColumnRenamed("lang", "query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n_chars").desc(), "doc_id")))
    qrels = known.where("doc_id % 3 > 0").select(F.col("lang").alias("query_id"), "doc_id", (F.col("quality") * (F.col("doc_id") % 3)).cast("int").alias("relevance"))
    labels = known.where("quality = 1 and lang <> 'en' and doc_id % 2 = 0").select(F.col("lang").alias("query_id"), "doc_id")
    return metrics.retrieval_metrics(known.select(F.col("lang").alias("query_id")).distinct(), ranking, qrels, (5, 10), labels)


def hashed_tokens(spark, sf_dir):
    bucket, sign = hashed_bucket(F.col("term"))
    terms = _queries(spark, sf_dir).select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.select("query_id", bucket.alias("bucket"), sign.alias("sign")).groupBy("query_id", "bucket").agg(F.sum("sign").cast("long").alias("weight"))


def _embedding_metrics(spark, sf_dir):
    items = _table(spark, sf_dir, "embeddings")
    asked = items.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = retrieval.array_search(items, "vec_id", "embedding", asked, 11).where("query_id <> vec_id").withColumnRenamed("vec_id", "doc_id")
    qrels = asked.select("query_id", "label").join(items.select(F.col("vec_id").alias("doc_id"), "label"), "label").where("query_id <> doc_id").select("query_id", "doc_id", F.lit(1).alias("relevance"))
    return asked, metrics.retrieval_metrics(asked, found, qrels)


def retrieval_metrics(spark, sf_dir):
    return _embedding_metrics(spark, sf_dir)[1]


def leaderboard(spark, sf_dir):
    return metrics.summary(_embedding_metrics(spark, sf_dir)[1], "k")


def category_summary(spark, sf_dir):
    asked, rows = _embedding_metrics(spark, sf_dir)
    return metrics.summary(rows.join(asked.select("query_id", "label"), "query_id"), "label", "k")


def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", html_title(F.col("html")).alias("title"), html_text(F.col("html")).alias("text"))


def token_costs(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("role", estimate_tokens(F.col("text")).alias("n"))
    sides = rows.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum("n").alias("tokens"))
    cost = model_cost(F.lit("gpt-4o-mini"), F.when(F.col("role") != "assistant", F.col("tokens")).otherwise(0), F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0))
    return sides.select("role", "n_turns", "tokens", F.round(cost, 9).alias("cost_usd"))


def text_functions(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), 260).alias("preview"), stable_hash(F.col("text"), 10).alias("hash10"), F.size(tokenize(F.col("text"))).alias("n_tokens"))


def query_planning(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(query_variants(F.col("text")), " || ").alias("variants"))


def _answers(spark, sf_dir):
    """Questions from the benchmark, answered from what BM25 finds; every third has no relevant document."""
    chunks, queries = _chunks(spark, sf_dir), _queries(spark, sf_dir)
    found = retrieval.bm25(chunks, queries, 5)
    texts = found.join(chunks.select(*retrieval.CHUNK, "text"), retrieval.CHUNK)
    context = texts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"), F.max(F.when(F.col("rank") == 1, F.col("doc_id"))).alias("top"))
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 3)
    relevant = F.when(F.col("query_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("doc_"), F.col("top").cast("string"))))
    rows = queries.join(context, "query_id").select("query_id", F.col("text").alias("question"), F.when(F.col("query_id") % 4 == 1, F.substring("context", 1, 300)).otherwise(F.col("text")).alias("reference_answer"), F.slice(words, 1, 5).alias("expected_keywords"), relevant.alias("relevant_doc_ids"), "context", "top")
    answer = F.when(F.col("query_id") % 7 == 0, F.lit(judging.REFUSAL)).otherwise(F.concat(F.substring("context", 1, 300), F.lit(" [doc_"), F.col("top").cast("string"), F.lit("]")))
    return found, rows.withColumn("answer", answer)


def _judged(spark, sf_dir):
    found, rows = _answers(spark, sf_dir)
    return found, judging.judge(rows).withColumns({"hit5": (F.col("query_id") % 5 != 0).cast("int"), "recall5": (F.col("query_id") % 5 != 0).cast("double")})


def answer_judging(spark, sf_dir):
    return _judged(spark, sf_dir)[1].select("query_id", "correctness", "faithfulness", "completeness", "relevance", "citation", "answer_score", "supported", "hallucinated", "refused")


def failure_analysis(spark, sf_dir):
    rows = _judged(spark, sf_dir)[1]
    return rows.select("query_id", judging.failure_type(F.col("hit5")).alias("failure_type"))


def failure_summary(spark, sf_dir):
    rows = _judged(spark, sf_dir)[1]
    return judging.failure_summary(rows.withColumn("failure_type", judging.failure_type(F.col("hit5"))))


def extractive_answers(spark, sf_dir):
    rows = _answers(spark, sf_dir)[1]
    return rows.select("query_id", judging.extractive_answer(F.col("question"), F.col("context")).alias("answer"))


def label_audit(spark, sf_dir):
    found, rows = _judged(spark, sf_dir)
    labels = rows.select("query_id", F.col("top").alias("doc_id")).where("query_id % 2 = 0")
    return judging.qrels_audit(rows, found, labels)


def parent_documents(spark, sf_dir):
    _, kids = chunking.chunk_parents(_table(spark, sf_dir, "documents"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "child_index")) - 1
    kids = kids.withColumn("chunk_index", order).persist(StorageLevel.MEMORY_AND_DISK)  # read three times
    best = retrieval.bm25(kids, _queries(spark, sf_dir), 8)
    parents = kids.select(*retrieval.CHUNK, F.concat_ws("/", F.col("doc_id"), F.col("parent_index")).alias("parent_chunk_id"))
    return retrieval.parents_of(best, parents, 4)


def dataset_profile(spark, sf_dir):
    docs, marks = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return docs.join(marks, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.coalesce("quality", F.lit(0)) > 0).alias("relevant"))


QUERIES = {f.__name__: f for f in (
    chunk_tokens, chunk_chars, chunk_parents, term_statistics, bm25_topk, vector_topk, hybrid_rrf, keyword_rerank, relevance_rerank, variant_candidates, system_contexts, chunk_markdown, graded_labels, hashed_tokens, retrieval_metrics, leaderboard,
    category_summary, page_text, token_costs, text_functions, query_planning, answer_judging, failure_analysis, failure_summary, extractive_answers, label_audit, parent_documents, dataset_profile,
)}

# -- the same in SQL ------------------------------------------------------------------------------------------------


def _windows(source: str, size: int, overlap: int, columns: str = "doc_id") -> str:
    """Token windows of ``source(columns, text)``: columns, k, s, e, t."""
    stride = size - overlap
    return f"""SELECT {columns}, k, p + length(raw) - length(t) AS s, p + length(raw) AS e, t FROM (
      SELECT {columns}, k, raw, p, regexp_replace(raw, '^\\s+', '') AS t FROM (
        SELECT {columns}, k, array_to_string(u[k * {stride} + 1 : k * {stride} + {size}], '') AS raw, CASE WHEN k = 0 THEN 0 ELSE length(array_to_string(u[1 : k * {stride}], '')) END AS p FROM (
          SELECT {columns}, u, unnest(range(CASE WHEN len(u) = 0 THEN 0 WHEN len(u) <= {size} THEN 1 ELSE (1 + ceil((len(u) - {size}) / {stride}))::BIGINT END)) AS k FROM (
            SELECT {columns}, regexp_extract_all(coalesce(text, ''), '\\s*\\S+') AS u FROM {source}))))"""


def _id(doc: str, k: str, s: str, e: str, t: str) -> str:
    return f"format('{{}}::chunk::{{:04d}}::{{}}', {doc}, {k}, substr(sha256(concat({s}, ':', {e}, ':', {t})), 1, 10))"


_CHUNKS = f"c AS (SELECT doc_id, k::INT AS chunk_index, t AS text FROM ({_windows('documents', SIZE, OVERLAP)}))"
_TOKENS = "x AS (SELECT doc_id, chunk_index, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM c)"
_TERMS = "q AS (SELECT query_id, term, count(*) AS m FROM (SELECT item_id AS query_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM benchmark) GROUP BY ALL)"


def _bm25(chunks: str, k: int, name: str = "bm") -> str:
    return f"""{chunks}, {_TOKENS}, {_TERMS}, z AS (SELECT count(*) AS n, avg(len(w)) AS a FROM x),
      tf AS (SELECT doc_id, chunk_index, l, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, len(w) AS l, unnest(w) AS term FROM x) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      h AS (SELECT query_id, doc_id, chunk_index, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / greatest(a, 1e-9)))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), z GROUP BY ALL),
      o AS (SELECT item_id AS query_id, c.doc_id, c.chunk_index, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN c LEFT JOIN h ON h.query_id = item_id AND h.doc_id = c.doc_id AND h.chunk_index = c.chunk_index),
      {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS rank FROM o) WHERE rank <= {k})"""


def _hashed(source: str, key: str) -> str:
    """Sparse unit vectors of ``source(key, w)``: key, b, v."""
    return f"""SELECT {key}, b, s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS v FROM (
      SELECT {key}, m % 384 AS b, sum(CASE WHEN m < 384 THEN 1 ELSE -1 END)::DOUBLE AS s FROM (
        SELECT {key}, (((('0x' || substr(d, 1, 8))::BIGINT % 768) * 256 + ('0x' || substr(d, 9, 8))::BIGINT) % 768) AS m FROM (SELECT {key}, sha256(unnest(w)) AS d FROM {source})) GROUP BY {key}, m % 384) WHERE s <> 0"""


def _vector(k: int, name: str = "ve", chunks: bool = True, asked: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    return f"""{_CHUNKS + ', ' + _TOKENS + ',' if chunks else ''} aq AS ({asked}), y AS (SELECT query_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM aq),
      vc AS ({_hashed('x', 'doc_id, chunk_index')}), vq AS ({_hashed('y', 'query_id')}),
      vs AS (SELECT query_id, doc_id, chunk_index, sum(vq.v * vc.v) AS score FROM vq JOIN vc USING (b) GROUP BY ALL),
      vo AS (SELECT aq.query_id, c.doc_id, c.chunk_index, round(round(coalesce(score, 0.0), 12), 6) + 0.0 AS score FROM aq CROSS JOIN c LEFT JOIN vs ON vs.query_id = aq.query_id AND vs.doc_id = c.doc_id AND vs.chunk_index = c.chunk_index),
      {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index)::INT AS rank FROM vo) WHERE rank <= {k})"""


_METRICS = """a AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 20 = 0),
  s AS (SELECT query_id, vec_id AS doc_id, i.label = a.label AS rel, round(round(list_dot_product(a.e::DOUBLE[], i.embedding::DOUBLE[]), 12), 6) AS score FROM a CROSS JOIN embeddings i),
  t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 11 AND query_id <> doc_id),
  p AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY r) AS pos FROM t),
  n AS (SELECT query_id, label, (SELECT count(*) FROM embeddings i WHERE i.label = a.label AND i.vec_id <> a.query_id) AS num FROM a),
  g AS (SELECT n.query_id, n.label, n.num, k, (SELECT count(*) FROM p WHERE p.query_id = n.query_id) AS got, (SELECT count(*) FROM p WHERE p.query_id = n.query_id AND rel AND pos <= k) AS hits,
    (SELECT min(pos) FROM p WHERE p.query_id = n.query_id AND rel AND pos <= k) AS f, (SELECT coalesce(sum(1 / log2(pos + 1)), 0) FROM p WHERE p.query_id = n.query_id AND rel AND pos <= k) AS dcg,
    (SELECT sum(1 / log2(i + 1)) FROM range(1, least(k, num) + 1) z(i)) AS ideal FROM n CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k)),
  m AS (SELECT query_id, label, num AS num_relevant_docs, got AS num_retrieved_docs, k::INT AS k, round(hits / greatest(1, num), 6) AS recall, round(hits / k, 6) AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1 / f, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM g)"""
_MEANS = "count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, round(avg(hit), 6) AS mean_hit, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg), 6) AS mean_ndcg"
_CHAR_STRIDE = 1200 - 150

_ANSWERS = f"""{_bm25(_CHUNKS, 5)},
  v AS (SELECT query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS context, max(CASE WHEN rank = 1 THEN bm.doc_id END) AS top FROM bm JOIN c USING (doc_id, chunk_index) GROUP BY query_id),
  r AS (SELECT query_id, text AS question, list_filter(string_split(text, ' '), lambda w: length(w) > 3)[1:5] AS kw, query_id % 3 <> 0 AS answerable, context, top,
    CASE WHEN query_id % 7 = 0 THEN '{judging.REFUSAL}' ELSE substr(context, 1, 300) || ' [doc_' || top || ']' END AS answer FROM v JOIN benchmark ON item_id = query_id),
  w AS (SELECT *, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS low, lower(trim(regexp_replace(context, '\\s+', ' ', 'g'))) AS ctx, list_transform(regexp_extract_all(answer, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS said, list_distinct(list_transform(regexp_extract_all(CASE WHEN query_id % 4 = 1 THEN substr(context, 1, 300) ELSE question END, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS ref FROM r),
  u AS (SELECT *, low LIKE '%could not find the answer%' OR low LIKE '%not available%' AS refused, list_filter(said, lambda t: length(t) > 3 AND t NOT IN ('could', 'provided', 'documents', 'answer')) AS content FROM w),
  j0 AS (SELECT *, least(5.0, 5 * greatest(len(list_filter(kw, lambda x: contains(low, lower(x)))) / greatest(1, len(kw)), len(list_intersect(ref, said)) / greatest(1, len(ref)))) AS c0, 5 * least(1.0, len(list_filter(content, lambda t: contains(ctx, t))) / greatest(1, len(content))) AS f0 FROM u),
  j1 AS (SELECT *, round(CASE WHEN NOT answerable THEN CASE WHEN refused THEN 5.0 ELSE 1.0 END WHEN refused THEN least(1.0, c0) ELSE c0 END::DOUBLE, 6) AS correctness, round(CASE WHEN NOT answerable THEN CASE WHEN refused THEN 5.0 ELSE 1.0 END WHEN refused THEN 4.0 ELSE f0 END::DOUBLE, 6) AS faithfulness,
    CASE WHEN NOT answerable THEN CASE WHEN refused THEN 5.0 ELSE 0.0 END WHEN refused THEN 0.0 ELSE 5.0 END::DOUBLE AS citation FROM j0),
  j AS (SELECT *, round((correctness * 3 + faithfulness + citation) / 5, 6) AS answer_score, CASE WHEN NOT answerable THEN refused ELSE faithfulness >= 3 END AS supported, CASE WHEN NOT answerable THEN NOT refused ELSE faithfulness < 2 AND NOT refused END AS hallucinated, query_id % 5 <> 0 AS hit5 FROM j1),
  fl AS (SELECT *, CASE WHEN NOT answerable THEN CASE WHEN refused THEN 'no_failure' ELSE 'answer_hallucination' END WHEN NOT hit5 AND answer_score >= 4 AND faithfulness >= 4 AND NOT refused THEN 'possible_qrels_gap' WHEN NOT hit5 THEN 'retrieval_miss' WHEN refused THEN 'over_refusal' WHEN hallucinated THEN 'answer_hallucination'
    WHEN correctness >= 3.5 AND faithfulness >= 3 THEN 'no_failure'
    WHEN len(list_filter(kw, lambda x: regexp_matches(x, '(^|\\s)\\p{{Lu}}'))) > 0 AND len(list_filter(kw, lambda x: regexp_matches(x, '(^|\\s)\\p{{Lu}}') AND contains(lower(answer), lower(x)))) = 0 THEN 'wrong_entity'
    WHEN correctness > 1.5 THEN 'partial_answer' ELSE 'insufficient_context' END AS failure_type FROM j)"""

_STOP = ", ".join(f"'{w}'" for w in rerankers.STOP_WORDS)
_TOKENS_OF = "list_transform(regexp_extract_all({}, '[A-Za-z0-9_]+'), lambda t: lower(t))"
_HALVES = "SELECT item_id || '/0' AS query_id, text FROM benchmark UNION ALL SELECT item_id || '/1', array_to_string(string_split(text, ' ')[1:8], ' ') FROM benchmark"
_MD = """SELECT doc_id, section, text FROM (SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) AS section FROM (SELECT doc_id, CASE WHEN len(a) > 1 THEN a[2:] ELSE a END AS p FROM (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), chr(10), chr(10) || '## ', 'g'), '(?m)^(#{1,4}[ \\t]+\\S)', chr(1) || '\\1', 'g'), chr(1)) AS a FROM documents)))"""

ORACLE_SQL: dict[str, str] = {
    "relevance_rerank": f"""WITH {_vector(30)}, it AS (SELECT ve.query_id, ve.rank AS was, doc_id, chunk_index, c.text, b.text AS question FROM ve JOIN c USING (doc_id, chunk_index) JOIN benchmark b ON b.item_id = ve.query_id),
      al AS (SELECT query_id, was, text FROM it UNION ALL SELECT DISTINCT query_id, 0, question FROM it),
      wo AS (SELECT query_id, was, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM al),
      tf AS (SELECT query_id, was, g, count(*) AS tf FROM (SELECT query_id, was, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM wo) GROUP BY ALL),
      df AS (SELECT query_id, g, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT query_id, count(*) AS n FROM al GROUP BY query_id),
      we AS (SELECT query_id, was, g, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (query_id, g) JOIN nn USING (query_id)),
      no AS (SELECT query_id, was, sqrt(sum(w * w)) AS norm FROM we GROUP BY ALL), co AS (SELECT a.query_id, a.was, sum(a.w * b.w) AS dot FROM we a JOIN we b ON a.query_id = b.query_id AND a.g = b.g AND b.was = 0 WHERE a.was > 0 GROUP BY ALL),
      ta AS (SELECT *, list_distinct(list_filter({_TOKENS_OF.format('question')}, lambda t: length(t) > 2)) AS asked, {_TOKENS_OF.format('text')} AS said FROM it),
      sc AS (SELECT ta.query_id, ta.was, doc_id, chunk_index, round(coalesce(dot / (n1.norm * n0.norm), 0.0) + 0.25 * len(list_intersect(asked, said)) / greatest(1, len(asked)) + 0.05 / greatest(1, ta.was), 8) AS score
        FROM ta LEFT JOIN co ON co.query_id = ta.query_id AND co.was = ta.was LEFT JOIN no n1 ON n1.query_id = ta.query_id AND n1.was = ta.was LEFT JOIN no n0 ON n0.query_id = ta.query_id AND n0.was = 0)
      SELECT query_id, rank, doc_id, chunk_index, score, was AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was)::INT AS rank FROM sc) WHERE rank <= 5""",
    "variant_candidates": f"""WITH {_vector(10, asked=_HALVES)}, sp AS (SELECT split_part(query_id, '/', 1)::BIGINT AS query_id, split_part(query_id, '/', 2)::INT AS variant, doc_id, chunk_index, rank, score FROM ve),
      be AS (SELECT query_id, doc_id, chunk_index, max(score) AS score, min(variant * 1000 + rank) AS seen FROM sp GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank, doc_id, chunk_index, score FROM be""",
    "system_contexts": f"""WITH cw AS (SELECT doc_id, k::INT AS chunk_index, t AS text, {_id('doc_id', 'k', 's', 'e', 't')} AS chunk_id FROM ({_windows('documents', SIZE, OVERLAP)})), {_bm25('c AS (SELECT doc_id, chunk_index, text FROM cw)', 3)}
      SELECT query_id, sha256(string_agg('[' || bm.doc_id || ' | ' || split_part(chunk_id, '::chunk::', 2) || ']' || chr(10) || cw.text, chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM bm JOIN cw ON cw.doc_id = bm.doc_id AND cw.chunk_index = bm.chunk_index GROUP BY query_id""",
    "chunk_markdown": f"""WITH md AS ({_MD}), wi AS (SELECT * FROM ({_windows('md', 50, 10, 'doc_id, section')})), nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, k) - 1 AS i FROM wi)
      SELECT {_id('doc_id', 'i', 's', 'e', 't')} AS chunk_id, doc_id, i::INT AS chunk_index, section::INT AS section, k::INT AS section_chunk, s::INT AS start_char, e::INT AS end_char, sha256(t) AS text_hash FROM nu""",
    "graded_labels": """WITH kn AS (SELECT doc_id, lang, n_chars, quality FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)),
      po AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pos, CASE WHEN doc_id % 3 > 0 THEN quality * (doc_id % 3) ELSE 0 END AS gain, quality = 1 AND lang <> 'en' AND doc_id % 2 = 0 AS listed FROM kn),
      ma AS (SELECT *, CASE WHEN max(listed) OVER (PARTITION BY lang) THEN listed ELSE gain > 0 END AS hit FROM po),
      id AS (SELECT lang, gain, row_number() OVER (PARTITION BY lang ORDER BY gain DESC) AS i FROM ma WHERE gain > 0),
      ks AS (SELECT DISTINCT lang, k FROM ma CROSS JOIN (SELECT unnest([5, 10])::INT AS k)),
      a AS (SELECT lang, k, count_if(listed)::BIGINT AS num_relevant_docs, count(*) AS num_retrieved_docs, count_if(hit) AS n, count_if(hit AND pos <= k) AS hits, min(CASE WHEN hit AND pos <= k THEN pos END) AS f, sum(CASE WHEN pos <= k THEN (2 ** gain - 1) / log2(pos + 1) ELSE 0 END) AS dcg FROM ks JOIN ma USING (lang) GROUP BY ALL),
      b AS (SELECT lang, k, sum((2 ** gain - 1) / log2(i + 1)) AS best FROM ks JOIN id USING (lang) WHERE i <= k GROUP BY ALL)
      SELECT lang AS query_id, num_relevant_docs, num_retrieved_docs, k, round(hits / greatest(1, n), 6) AS recall, round(hits / k, 6) AS precision, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(1 / f, 0.0), 6) AS mrr, round(coalesce(dcg / best, 0.0), 6) AS ndcg FROM a LEFT JOIN b USING (lang, k)""",
    "query_planning": f"""WITH cl AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '^[ ?]+|[ ?]+$', '', 'g') AS c FROM conversations WHERE role = 'user'),
      pa AS (SELECT *, string_split(regexp_replace(c, '(?i)\\s+(?:vs\\.?|versus)\\s+', chr(1)), chr(1)) AS v, regexp_extract(c, '(?i)\\bcompare\\s+(.+?)\\s+\\band\\s+(.+?)(?:\\s+\\bby\\b|\\s+\\bfor\\b|$)', 1) AS g1, regexp_extract(c, '(?i)\\bcompare\\s+(.+?)\\s+\\band\\s+(.+?)(?:\\s+\\bby\\b|\\s+\\bfor\\b|$)', 2) AS g2,
        regexp_replace(regexp_extract(c, '(?i)\\b(?:by|for)\\s+(.+)$', 1), '^[ ?]+|[ ?]+$', '', 'g') AS b, string_split(regexp_replace(c, '(?i)\\s+\\band\\s+((?:{CLAUSE})\\b)', chr(1) || '\\1', 'g'), chr(1)) AS l, regexp_extract_all(c, '\\b[A-Z][A-Za-z0-9]*(?:[-\\s]+[A-Z][A-Za-z0-9]*)*\\b') AS p FROM cl),
      al AS (SELECT conv_id, turn, list_concat([c], CASE WHEN regexp_matches(lower(c), ' (vs|versus) ') THEN list_transform(v, lambda x: regexp_replace(x, '^[ ?]+|[ ?]+$', '', 'g')) ELSE [] END, CASE WHEN g1 <> '' THEN [trim(regexp_replace(g1, '^[ ?]+|[ ?]+$', '', 'g') || ' ' || b), trim(regexp_replace(g2, '^[ ?]+|[ ?]+$', '', 'g') || ' ' || b)] ELSE [] END,
        CASE WHEN len(l) > 1 THEN list_transform(l, lambda x: regexp_replace(x, '^[ ?]+|[ ?]+$', '', 'g')) ELSE [] END, list_filter(p, lambda x: length(x) > 2 AND NOT regexp_matches(x, '(?i)^(?:{ASKING})\\b'))) AS every FROM pa)
      SELECT conv_id, turn, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i AND contains(x, ' '))[1:4], ' || ') AS variants FROM al""",
    "chunk_tokens": f"SELECT {_id('doc_id', 'k', 's', 'e', 't')} AS chunk_id, doc_id, k::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, sha256(t) AS text_hash FROM ({_windows('documents', SIZE, OVERLAP)})",
    "chunk_chars": f"""WITH w AS (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1200 THEN 1 ELSE (1 + ceil((length(text) - 1200) / {_CHAR_STRIDE}))::BIGINT END)) AS i FROM documents),
      v AS (SELECT doc_id, i * {_CHAR_STRIDE} AS s, least(i * {_CHAR_STRIDE} + 1200, length(text)) AS e, substr(text, i * {_CHAR_STRIDE} + 1, 1200) AS t FROM w),
      n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k FROM v WHERE regexp_matches(t, '\\S'))
      SELECT {_id('doc_id', 'k', 's', 'e', 't')} AS chunk_id, doc_id, k::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char, sha256(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS text_hash FROM n""",
    "chunk_parents": f"""WITH p AS (SELECT doc_id, k AS parent_index, t AS text FROM ({_windows('documents', 1000, 150)}))
      SELECT doc_id, parent_index::INT AS parent_index, k::INT AS child_index, s::INT AS start_char, e::INT AS end_char, sha256(t) AS text_hash FROM ({_windows('p', 250, 50, 'doc_id, parent_index')})""",
    "term_statistics": f"WITH {_CHUNKS}, {_TOKENS}, f AS (SELECT doc_id, chunk_index, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, unnest(w) AS term FROM x) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM f GROUP BY term",
    "bm25_topk": f"WITH {_bm25(_CHUNKS, 5)} SELECT query_id, rank, doc_id, chunk_index, score FROM bm",
    "vector_topk": f"WITH {_vector(5)} SELECT query_id, rank, doc_id, chunk_index, score FROM ve",
    "hybrid_rrf": f"""WITH {_bm25(_CHUNKS, 20)}, {_vector(20, chunks=False)}, e AS (SELECT query_id, doc_id, chunk_index, rank, 0 AS src FROM bm UNION ALL SELECT query_id, doc_id, chunk_index, rank, 1 FROM ve),
      f AS (SELECT query_id, doc_id, chunk_index, round(sum(1 / (60 + rank)), 9) AS score, min(src * 100 + rank) AS seen, count(*) AS n_sources FROM e GROUP BY ALL)
      SELECT query_id, rank, doc_id, chunk_index, score, n_sources FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM f) WHERE rank <= 5""",
    "keyword_rerank": f"""WITH {_vector(30)}, a AS (SELECT query_id, list_distinct(list_filter(w, lambda t: length(t) > 2)) AS asked FROM y),
      k AS (SELECT ve.query_id, doc_id, chunk_index, ve.rank AS was, round(len(list_intersect(asked, x.w)) + 1 / (ve.rank + 1000) + 0.001 * score, 10) AS score FROM ve JOIN x USING (doc_id, chunk_index) JOIN a ON a.query_id = ve.query_id)
      SELECT query_id, rank, doc_id, chunk_index, score, was AS candidate_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was)::INT AS rank FROM k) WHERE rank <= 5""",
    "hashed_tokens": """SELECT query_id, (m % 384)::INT AS bucket, sum(CASE WHEN m < 384 THEN 1 ELSE -1 END)::BIGINT AS weight FROM (SELECT query_id, (((('0x' || substr(d, 1, 8))::BIGINT % 768) * 256 + ('0x' || substr(d, 9, 8))::BIGINT) % 768) AS m
      FROM (SELECT item_id AS query_id, sha256(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')))) AS d FROM benchmark)) GROUP BY ALL""",
    "retrieval_metrics": f"WITH {_METRICS} SELECT query_id, num_relevant_docs, num_retrieved_docs, k, recall, precision, hit, mrr, ndcg FROM m",
    "leaderboard": f"WITH {_METRICS} SELECT k, {_MEANS} FROM m GROUP BY k",
    "category_summary": f"WITH {_METRICS} SELECT label, k, {_MEANS} FROM m GROUP BY label, k",
    "page_text": """SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title>.*?</title>') THEN trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) END AS title,
      trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""",
    "token_costs": f"""WITH t AS (SELECT role, greatest(1, floor(len(regexp_extract_all(coalesce(text, ''), '\\S+')) * 1.3))::BIGINT AS n FROM conversations), s AS (SELECT role, count(*) AS n_turns, sum(n)::BIGINT AS tokens FROM t GROUP BY role)
      SELECT role, n_turns, tokens, round(CASE WHEN role = 'assistant' THEN tokens * {PRICES['gpt-4o-mini'][1]} / 1e6 ELSE tokens * {PRICES['gpt-4o-mini'][0]} / 1e6 END, 9)::DOUBLE AS cost_usd FROM s""",
    "text_functions": """WITH n AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)
      SELECT doc_id, CASE WHEN length(f) <= 260 THEN f ELSE rtrim(substr(f, 1, 257)) || '...' END AS preview, substr(sha256(text), 1, 10) AS hash10, len(regexp_extract_all(text, '[A-Za-z0-9_]+'))::INT AS n_tokens FROM n""",
    "answer_judging": f"WITH {_ANSWERS} SELECT query_id, correctness, faithfulness, correctness AS completeness, correctness AS relevance, citation, answer_score, supported, hallucinated, refused FROM j",
    "failure_analysis": f"WITH {_ANSWERS} SELECT query_id, failure_type FROM fl",
    "failure_summary": f"WITH {_ANSWERS} SELECT failure_type, count(*) AS n, min_by(question, query_id) AS example FROM fl WHERE failure_type <> 'no_failure' GROUP BY failure_type",
    "label_audit": f"""WITH {_ANSWERS}, un AS (SELECT DISTINCT query_id, doc_id FROM bm WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.query_id = bm.query_id AND j.top = bm.doc_id AND j.query_id % 2 = 0)),
      l AS (SELECT query_id, string_agg(doc_id::VARCHAR, ', ' ORDER BY doc_id::VARCHAR) AS unlabelled_docs FROM un GROUP BY query_id)
      SELECT j.query_id, 'high' AS severity, unlabelled_docs FROM j JOIN l USING (query_id) WHERE answerable AND NOT hit5 AND answer_score >= 4 AND faithfulness >= 4""",
    "dataset_profile": "SELECT lang, count(*) AS documents, count(quality) AS labelled, count_if(coalesce(quality, 0) > 0) AS relevant FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "extractive_answers": f"""WITH {_ANSWERS}, se AS (SELECT query_id, question, string_split(regexp_replace(context, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM j),
      sp AS (SELECT query_id, question, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM se),
      so AS (SELECT query_id, s, i, len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all(question, '[A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: length(t) > 2)), list_transform(regexp_extract_all(s, '[A-Za-z0-9_]+'), lambda t: lower(t)))) AS n FROM sp),
      sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, i) AS r FROM so WHERE n > 0),
      sa AS (SELECT query_id, substr(string_agg(trim(s, ' '), ' ' ORDER BY r), 1, 1200) AS answer FROM sr WHERE r <= 2 GROUP BY query_id)
      SELECT j.query_id, coalesce(sa.answer, '{judging.REFUSAL}') AS answer FROM j LEFT JOIN sa USING (query_id)""",
    "parent_documents": f"""WITH pa AS (SELECT doc_id, k AS parent_index, t AS text FROM ({_windows('documents', 1000, 150)})),
      ki AS (SELECT doc_id, parent_index, k, t, (row_number() OVER (PARTITION BY doc_id ORDER BY parent_index, k) - 1)::INT AS chunk_index FROM ({_windows('pa', 250, 50, 'doc_id, parent_index')})),
      {_bm25('c AS (SELECT doc_id, chunk_index, t AS text FROM ki)', 8)},
      be AS (SELECT query_id, bm.doc_id || '/' || parent_index AS parent_chunk_id, max(score) AS score, min(rank) AS f, string_agg(bm.chunk_index::VARCHAR, ',' ORDER BY rank) AS matched FROM bm JOIN ki ON ki.doc_id = bm.doc_id AND ki.chunk_index = bm.chunk_index GROUP BY ALL)
      SELECT query_id, rank, parent_chunk_id, score, matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f)::INT AS rank FROM be) WHERE rank <= 4""",
}

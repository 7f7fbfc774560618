"""Rerankers, systems, model adapters, experiment files, runs and the command line on small inputs."""

import csv
import json
import math
import re

import pytest
import yaml
from pyspark.sql import functions as F

from rankforge.__main__ import inspect, main
from rankforge.operators import collections, evaluation, judging, metrics, models, reports, rerankers, retrieval, systems
from rankforge.sources import experiment
from rankforge.sources.demo import DOCS, QUESTIONS, write_demo

TEXTS = ["Red Bus. The red bus costs 20 coins.", "Blue car. The blue car costs 30 coins.", "Weather is fine in Berlin today.", ""]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(f"doc_{n}", t) for n, t in enumerate(TEXTS)] + [("doc_null", None)], "doc_id string, text string")
    asked = [("q1", "What does the red bus cost?"), ("q2", "word"), ("q3", "Compare Red Bus and Blue Car by price"), ("q4", None), ("q5", "")]
    return docs, spark.createDataFrame(asked, "query_id string, text string")


def replying(**replies):
    return models.Generator("fake", lambda prompts: [(json.dumps(replies), 7, 3) for _ in prompts])


def tfidf(question, texts, ranks):
    """The reranker's score from its definition, with plain loops."""
    words = lambda t: [w for w in re.findall(r"\w{2,}", t.lower()) if w not in rerankers.STOP_WORDS]
    grams = lambda t: [*words(t), *(" ".join(p) for p in zip(words(t), words(t)[1:], strict=False))]
    items = [grams(question), *map(grams, texts)]
    df = {g: sum(g in i for i in items) for i in items for g in i}
    vec = lambda i: {g: i.count(g) * (math.log((1 + len(items)) / (1 + df[g])) + 1) for g in i}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    first, out = vec(items[0]), []
    low = lambda t: {w.lower() for w in re.findall("[A-Za-z0-9_]+", t)}
    asked = {w for w in low(question) if len(w) > 2}
    for text, item, rank in zip(texts, items[1:], ranks, strict=True):
        v = vec(item)
        size = norm(first) * norm(v)
        cosine = sum(x * first.get(g, 0) for g, x in v.items()) / size if size else 0
        out.append(cosine + 0.25 * len(asked & low(text)) / max(1, len(asked)) + 0.05 / max(1, rank))
    return out


def test_relevance_rerank_is_its_definition(spark):
    texts = TEXTS + ["the of and", "Red red RED bus bus Gr\u00fc\u00dfe"]
    chunks = spark.createDataFrame([(n, 0, t) for n, t in enumerate(texts)], "doc_id long, chunk_index int, text string")
    questions = {1: "What does the red bus cost?", 2: "the", 3: None}
    queries = spark.createDataFrame(list(questions.items()), "query_id long, text string")
    found = spark.createDataFrame([(q, n + 1, n, 0, 1.0) for q in questions for n in range(len(texts))], "query_id long, rank int, doc_id long, chunk_index int, score double")
    got = {}
    for r in rerankers.relevance_rerank(found, chunks, queries, 10).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for q, text in questions.items():
        want = tfidf(text or "", texts, range(1, len(texts) + 1))
        assert [got[q][n] for n in range(len(texts))] == pytest.approx(want, abs=1e-7)
    assert rerankers.relevance_rerank(found.limit(0), chunks, queries).count() == 0


def test_model_rerank_orders_and_falls_back(spark):
    chunks = spark.createDataFrame([(f"c{n}", n, 0, t) for n, t in enumerate(TEXTS[:3])], "chunk_id string, doc_id long, chunk_index int, text string")
    queries = spark.createDataFrame([(1, "red bus")], "query_id long, text string")
    found = spark.createDataFrame([(1, n + 1, n, 0, 1.0) for n in range(3)], "query_id long, rank int, doc_id long, chunk_index int, score double")
    order = lambda model, k: [(r["rank"], r["doc_id"], r["score"]) for r in rerankers.model_rerank(found, chunks, queries, k, model=model).orderBy("rank").collect()]
    assert order(replying(chunk_ids=["c2", "unknown", "c2", "c0"]), 3) == [(1, 2, 3.0), (2, 0, 2.0)]
    plain = [(r["rank"], r["doc_id"], r["score"]) for r in rerankers.relevance_rerank(found, chunks, queries, 2).orderBy("rank").collect()]
    assert order(replying(chunk_ids=["unknown"]), 2) == order(models.offline_generator(), 2) == plain
    assert order(models.Generator("bad", lambda prompts: [("no json", 1, 1) for _ in prompts]), 2) == plain
    assert rerankers.make_reranker("other") is retrieval.keyword_rerank and rerankers.make_reranker("tfidf_x") is rerankers.relevance_rerank
    with pytest.raises(ValueError):
        rerankers.make_reranker("llm")


@pytest.mark.parametrize("kind", sorted(systems.SYSTEMS))
def test_systems(small, kind):
    docs, queries = small
    options = systems.Options({"chunk_size": 8, "chunk_overlap": 2}, {"multi_query": True, "reranker": "local_relevance"})
    rows = systems.retrieve(kind, docs, queries, options).orderBy("query_id", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert by["q1"][0]["doc_id"] == "doc_0" and "red bus" in by["q1"][0]["text"]
    assert all([r["rank"] for r in some] == list(range(1, len(some) + 1)) for some in by.values())
    # with several wordings a question of one word has none; the other systems search it as it is
    assert ("q2" in by) == (kind not in ("hybrid", "rerank"))
    assert systems.retrieve(kind, docs.limit(0), queries, options).count() == 0 == systems.retrieve(kind, docs, queries.limit(0), options).count()


def test_model_heavy_uses_the_model_and_returns_original_texts(small):
    docs, queries = small
    options = systems.Options({}, {"top_k": 2}, {"enable_llm_ingestion": True, "enable_llm_rerank": True})
    model = replying(queries=["  blue car ", ""], summary="about", key_entities=["x"], hypothetical_questions=["y?"])
    rows = systems.retrieve("llm_heavy", docs, queries.where("query_id = 'q1'"), options, model).orderBy("rank").collect()
    assert len(rows) == 2 and {r["text"] for r in rows} <= set(TEXTS)
    with pytest.raises(ValueError):
        systems.retrieve("other", docs, queries)


def test_hybrid_fuses_all_wordings(small):
    docs, queries = small
    chunks = systems.chunks_of(docs, systems.Options())
    both = systems.wordings(queries.where("query_id = 'q3'"), F.array(F.lit("red bus"), F.lit("blue car")))
    want = {}
    for find in (retrieval.bm25, retrieval.vector_search):
        for r in find(chunks, both, 20).collect():
            want[r["doc_id"]] = want.get(r["doc_id"], 0) + 1 / (60 + r["rank"])
    lexical = systems.of_questions(retrieval.bm25(chunks, both, 20), queries).withColumn("source", F.col("variant") * 2)
    dense = systems.of_questions(retrieval.vector_search(chunks, both, 20), queries).withColumn("source", F.col("variant") * 2 + 1)
    got = {r["doc_id"]: r["score"] for r in retrieval.fuse(lexical.unionByName(dense)).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_embedder_scales_and_counts_batches(spark):
    def call(texts):
        assert len(texts) <= models.EMBED_BATCH
        return [[3.0, 4.0] if t else [0.0, 0.0] for t in texts]

    frame = spark.createDataFrame([(n, "a" if n else None) for n in range(250)], "n long, text string").coalesce(1)
    got = {r["n"]: r["embedding"] for r in models.embed(frame, models.Embedder("fake", call)).collect()}
    assert len(got) == 250 and got[0] == [0, 0] and got[7] == pytest.approx([0.6, 0.8])


def letters():
    """Counts of a few letters as vectors."""
    return models.Embedder("text-embedding-3-small", lambda texts: [[1.0 + t.lower().count(c) for c in "rbceu"] for t in texts])


def test_collections_are_stored_and_searched(spark, small, tmp_path):
    docs, queries = small
    chunks = systems.chunks_of(docs, systems.Options()).withColumns({"more": F.array(F.lit(1), F.lit(2)), "day": F.lit("2020-01-02").cast("date"), "none": F.lit(None).cast("string")})
    path = collections.write_collection(chunks, f"file://{tmp_path}", "a b!", letters())
    assert path.endswith("/a_b")
    stored = spark.read.parquet(path)
    first = stored.first()
    assert (first["more"], first["day"], first["none"]) == ("[1,2]", '"2020-01-02"', None) and stored.count() == chunks.count()
    asked = queries.where("query_id in ('q1', 'q3')")
    got = [tuple(r) for r in collections.search_collection(spark, path, asked, 2, letters()).orderBy("query_id", "rank").collect()]
    vector = lambda t: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])(letters().call([t])[0])
    for q, rank, doc, _, score in got:
        scores = sorted((round(sum(a * b for a, b in zip(vector(dict(asked.collect())[q]), vector(t), strict=True)), 6) for t in TEXTS[:3]), reverse=True)
        assert score == pytest.approx(scores[rank - 1], abs=2e-6)
    assert len(got) == 4
    by_system = systems.retrieve("vector", docs, asked, systems.Options({}, {"top_k": 2}, {}, letters())).orderBy("query_id", "rank")
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in by_system.collect()] == [g[:3] for g in got]
    assert systems.embedding_tokens(chunks, letters())[0] == sum(models.words(t) for t in TEXTS[:3]) and systems.embedding_tokens(chunks, None) == (0, 0.0)


@pytest.mark.parametrize("name, made", [("ab", "collection_ab"), ("", "collection"), ("__x y__", "x_y"), ("-abc-", "abc"), ("a" * 70, "a" * 63), ("doc set/1", "doc_set_1")])
def test_collection_names(name, made):
    assert collections.collection_name(name) == made


def test_labels_and_gains_may_disagree(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    ranking = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (3, 1, "a")], "query_id long, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "a", 3), (2, "a", 1)], "query_id long, doc_id string, relevance int")
    labels = spark.createDataFrame([(1, "b"), (3, "a")], "query_id long, doc_id string")
    got = {r["query_id"]: r for r in metrics.wide(metrics.retrieval_metrics(queries, ranking, qrels, (1,), labels)).collect()}
    assert (got[1]["hit@1"], got[1]["ndcg@1"], got[1]["num_relevant_docs"]) == (0, 1, 1)  # labels say b, gains a
    assert (got[2]["hit@1"], got[2]["num_relevant_docs"]) == (1, 0)  # no labels: positive relevance
    assert (got[3]["hit@1"], got[3]["ndcg@1"]) == (1, 1)  # no relevance: labels


def test_answers_cite_documents_of_the_context(spark):
    say = lambda q, c: spark.range(1).select(judging.extractive_answer(F.lit(q), F.lit(c)).alias("a")).first()["a"]
    assert say("red bus", "[doc_b | 1]\nA red bus.\n\n[doc_a | 2]\nNothing.").endswith("A red bus. [doc_a] [doc_b]")
    assert say("red bus", "[doc_b | 1]\nA red bus [doc_z].") == "[doc_b | 1]\nA red bus [doc_z]."
    assert say("red bus", "") == judging.REFUSAL == say("of", "of course.")


def experiment_file(folder, **more):
    made = {
        "run": {"name": "t", "output_dir": str(folder / "results")}, "dataset": {"documents_path": str(folder / "docs"), "questions_path": str(folder / "questions.jsonl"), "qrels_path": str(folder / "qrels.jsonl")},
        "systems": [{"type": "bm25", "name": "one"}, {"type": "rerank", "retrieval": {"reranker": "local_relevance", "multi_query": True}}],
    } | more
    (folder / "run.yaml").write_text(yaml.safe_dump(made))
    return folder / "run.yaml"


def test_run_writes_all_results(spark, tmp_path):
    assert write_demo(tmp_path) == {"documents": len(DOCS), "questions": len(QUESTIONS), "qrels": sum(len(q[3]) for q in QUESTIONS), "written_docs": len(DOCS)}
    assert write_demo(tmp_path)["written_docs"] == 0
    assert inspect(spark, str(tmp_path / "docs"), str(tmp_path / "questions.jsonl"), None)["unanswerable"] == 1
    out = evaluation.run(spark, experiment_file(tmp_path))
    assert {p.name for p in out.iterdir()} == {
        "config.yaml", "per_question_results.jsonl", "retrieval_metrics.csv", "answer_metrics.csv", "cost_breakdown.csv", "system_runtime.csv", "metrics_summary.csv", "leaderboard.md", "failures.md", "qrels_audit.csv",
        "qrels_audit.md", "run_summary.json", "report.html",
    }
    rows = [json.loads(line) for line in (out / "per_question_results.jsonl").read_text().splitlines()]
    assert [r["question_id"] for r in rows] == [f"q_{n:03d}" for n in range(1, len(QUESTIONS) + 1)] * 2
    assert json.loads((out / "run_summary.json").read_text())["num_question_rows"] == len(rows)
    board = list(csv.DictReader((out / "metrics_summary.csv").open()))
    assert [b["system"] for b in board] == ["one", "rerank"]
    for b in board:
        own = [r["retrieval_metrics"]["recall@5"] for r in rows if r["system"] == b["system"]]
        assert float(b["retrieval_recall@5"]) == pytest.approx(sum(own) / len(own)) and 0.8 <= sum(own) / len(own) <= 0.9
    costs = list(csv.DictReader((out / "cost_breakdown.csv").open()))
    assert [c["stage"] for c in costs].count("ingestion") == 2 and len(costs) == 2 + len(rows)
    assert "Cheap lexical baseline" in (out / "leaderboard.md").read_text() and "<h2>Leaderboard</h2>" in (out / "report.html").read_text()


def test_run_with_a_model_judge_and_without_five(spark, tmp_path):
    write_demo(tmp_path)
    judge = {"k_values": [1, 3], "max_questions": 2, "judge_model": "gpt-4o-mini"}
    judged = models.Generator("gpt-4o-mini", lambda prompts: [(json.dumps({"correctness": 9, "faithfulness": 4, "is_supported_by_context": True, "reasoning": "r"}) if "Marlow" in p else "no", 1000, 100) for p in prompts])
    path = experiment_file(tmp_path, evaluation=judge, systems=[{"type": "vector", "models": {"generator": "none"}}])
    out = evaluation.run(spark, path, {"gpt-4o-mini": judged})
    rows = [json.loads(line) for line in (out / "per_question_results.jsonl").read_text().splitlines()]
    assert len(rows) == 2
    first = rows[0]["answer_judge"]
    assert (first["correctness"], first["faithfulness"], first["relevance"], first["answer_score"], first["reasoning"]) == (5, 4, 0, 1.8, "r")
    assert rows[0]["cost"]["judge_cost"] == pytest.approx((1000 * 0.15 + 100 * 0.60) / 1e6) == rows[0]["cost"]["total_cost"]
    assert all(r["failure_type"] in ("retrieval_miss", "possible_qrels_gap") for r in rows)  # hits are looked up at 5


def test_experiment_files(tmp_path, monkeypatch):
    path = experiment_file(tmp_path, systems=[{"type": "bm25", "unknown": 1}])
    plan = experiment.load_experiment(path)
    assert plan.systems[0].resolved_name == "bm25" and plan.systems[0].extra == {"unknown": 1} and plan.evaluation.k_values == [1, 3, 5, 10]
    for wrong in ({"systems": [{"type": "bm25"}, {"type": "bm25"}]}, {"systems": [{"name": "x"}]}, {"systems": 3}, {"dataset": {}}):
        with pytest.raises(ValueError):
            experiment.load_experiment(experiment_file(tmp_path, **wrong))
    (tmp_path / "empty.yaml").write_text("")
    assert experiment.load_experiment_dict(tmp_path / "empty.yaml") == {}
    with pytest.raises(ValueError):
        experiment.load_experiment(tmp_path / "empty.yaml")
    with pytest.raises(FileNotFoundError):
        experiment.load_experiment(tmp_path / "none.yaml")
    monkeypatch.setenv("RANKFORGE_HELD", "own")
    monkeypatch.delenv("RANKFORGE_NEW", raising=False)
    (tmp_path / ".env").write_text("# x\nexport RANKFORGE_NEW='a=b'\nRANKFORGE_HELD=other\nno line\n")
    (tmp_path / "a").mkdir()
    assert experiment.load_settings(tmp_path / "a") == {"RANKFORGE_NEW": "a=b"}
    monkeypatch.delenv("RANKFORGE_NEW")


def test_command_line(tmp_path, capsys):
    assert main(["demo", "-o", str(tmp_path / "d")]) == 0 and main(["list-systems"]) == 0
    said = capsys.readouterr().out
    assert "10 documents" in said and all(k in said for k in systems.SYSTEMS)
    with pytest.raises(SystemExit):
        main(["other"])


def test_reports_of_nothing(tmp_path):
    assert "No qrels audit candidates found." in reports.audit_report([])
    assert "No classified failures." in reports.failure_report([{"system": "s", "failure_type": "no_failure", "n": 2, "example": "q"}])
    assert reports.html_table([], 1, "None.") == "<p>None.</p>" and "&lt;b&gt;" in reports.html_table([{"a": "<b>"}], 1, "")
    reports.write_table(tmp_path / "x.csv", [])
    assert (tmp_path / "x.csv").read_text() == ""

"""Operators on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from rankforge.functions import text
from rankforge.functions.queries import query_variants
from rankforge.operators import chunking, judging, metrics, reports, retrieval
from rankforge.sources import documents


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_token_chunks_overlap_and_keep_the_slice(spark):
    words = [f"w{i}" for i in range(12)]
    odd = "  a b  c \U0001f642\td\r\ne\x1cf  "
    rows = chunking.chunk_tokens(docs(spark, "  ".join(words), "", None, odd), 5, 2).orderBy("doc_id", "chunk_index").collect()
    first = [r for r in rows if r["doc_id"] == 0]
    assert len(first) == 4 and len({r["chunk_id"] for r in rows}) == len(rows)
    assert first[0]["text"].split()[-2:] == first[1]["text"].split()[:2]
    own = [r for r in rows if r["doc_id"] == 3]
    assert all(odd[r["start_char"] : r["end_char"]] == r["text"] for r in own)
    assert [r["text"].split() for r in own] == [["a", "b", "c", "\U0001f642", "d"], ["\U0001f642", "d", "e", "f"]]
    assert not [r for r in rows if r["doc_id"] in (1, 2)]
    with pytest.raises(ValueError):
        chunking.chunk_tokens(docs(spark, "a"), 5, 5)
    with pytest.raises(ValueError):
        chunking.make_chunks(docs(spark, "a"), "other")


def test_char_chunks_leave_blank_windows_out(spark):
    body = "abcd" + " " * 8 + "efgh"
    rows = chunking.chunk_chars(docs(spark, body, "", "abcd"), 4, 0).orderBy("doc_id", "chunk_index").collect()
    assert [(r["doc_id"], r["chunk_index"], r["start_char"], r["text"]) for r in rows] == [(0, 0, 0, "abcd"), (0, 1, 12, "efgh"), (2, 0, 0, "abcd")]


def test_markdown_sections(spark):
    rows = chunking.chunk_markdown(docs(spark, "before\n# One\na b\n##### no\n## Two\nc", "plain text"), 50, 0).orderBy("doc_id", "section").collect()
    assert [(r["doc_id"], r["title"], r["text"].split("\n")[0]) for r in rows] == [(0, "One", "# One"), (0, "Two", "## Two"), (1, None, "plain text")]


def test_bm25_pads_and_ranks(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha alpha alpha gamma"), (3, 0, ""), (4, 0, "delta")], "doc_id long, chunk_index int, text string")
    queries = spark.createDataFrame([(1, "alpha"), (2, "unknown"), (3, "alpha alpha delta"), (4, None)], "query_id long, text string")
    got = {}
    for r in retrieval.bm25(chunks, queries, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    assert [d for d, _ in got[1]] == [2, 1, 3] and got[1][2][1] == 0
    assert got[2] == [(1, 0.0), (2, 0.0), (3, 0.0)] == got[4]
    assert all(len(g) == 3 for g in got.values())


def test_fusion_and_variants(spark):
    ranking = lambda *d: spark.createDataFrame([(1, n + 1, x, 0, 1.0) for n, x in enumerate(d)], "query_id long, rank int, doc_id long, chunk_index int, score double")
    rows = retrieval.reciprocal_rank_fusion({"a": ranking(10, 20), "b": ranking(30, 10)}, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [10, 30, 20] and rows[0]["n_sources"] == 2
    one = ranking(1, 2).withColumn("variant", F.lit(0)).unionByName(ranking(2, 1).withColumn("variant", F.lit(1)))
    assert {r["variant"] for r in retrieval.best_of_variants(one).collect()} == {0}


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b")], "query_id long, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "b", 3), (3, "z", 1)], "query_id long, doc_id string, relevance int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = {(r["query_id"], r["k"]): r for r in metrics.retrieval_metrics(queries, ranking, qrels, (1, 2)).collect()}
    assert (rows[1, 2]["recall"], rows[1, 2]["precision"], rows[1, 2]["hit"], rows[1, 2]["mrr"]) == (1.0, 0.5, 1.0, 0.5)
    assert rows[1, 1]["hit"] == 0 and rows[1, 2]["ndcg"] == pytest.approx(0.63093, abs=1e-5)
    assert all(rows[q, k][c] == 0 for q in (2, 3) for k in (1, 2) for c in ("recall", "precision", "hit", "mrr", "ndcg"))


def test_judging_and_failures(spark):
    schema = "query_id long, question string, answer string, context string, reference_answer string, expected_keywords array<string>, relevant_doc_ids array<string>"
    rows = [
        (1, "q", "Paris is in France [doc_a]", "[doc_a | 1] Paris is in France", "Paris", ["Paris"], ["doc_a"]),
        (2, "q", "purple elephants dancing wildly", "nothing here", "Paris", ["Paris"], ["doc_a"]),
        (3, "q", judging.REFUSAL, "x", None, [], []),
        (4, "q", "invented thing", "x", None, [], []),
        (5, "q", judging.REFUSAL, "x", "Paris", ["Paris"], ["doc_a"]),
        (6, "q", "", "", None, [], ["doc_a"]),
    ]
    judged = judging.judge(spark.createDataFrame(rows, schema)).withColumn("hit5", F.lit(1))
    got = {r["query_id"]: r for r in judged.withColumn("f", judging.failure_type(F.col("hit5"))).collect()}
    assert got[1]["answer_score"] == 5 and got[1]["f"] == "no_failure"
    assert got[2]["hallucinated"] and got[2]["f"] == "answer_hallucination"
    assert got[3]["answer_score"] == 5 and got[3]["f"] == "no_failure"
    assert got[4]["answer_score"] <= 1 and got[4]["f"] == "answer_hallucination"
    assert got[5]["faithfulness"] == 4 and got[5]["f"] == "over_refusal"
    assert {r["f"] for r in got.values()} <= set(judging.LABELS)
    answer = spark.range(1).select(judging.extractive_answer(F.lit("where is Paris"), F.lit("No. Paris is here. Paris is where it is!")).alias("a")).first()["a"]
    assert answer.startswith("Paris is where")


def test_judging_by_hand(spark):
    schema = "query_id long, question string, answer string, context string, reference_answer string, expected_keywords array<string>, relevant_doc_ids array<string>"
    rows = [
        (1, "q", "this with that from alpha", "alpha text", "zeta", [], ["doc_1"]),  # five content words, of which one is supported: three letters or fewer and four words don't count
        (2, "q", "alpha [doc_1 | ab]", "alpha", "alpha", [], ["doc_1"]),  # no closed citation
        (3, "q", "alpha [doc_1] [doc_9]", "alpha", "alpha", [], ["doc_1"]),
        (4, "q", "alpha [doc_9]", "alpha", "alpha", [], ["doc_1"]),
        (5, "q", "could provided documents answer alpha", "alpha", "alpha", [], ["doc_1"]),
        (6, "q", "alpha beta", "alpha beta", "zeta eta theta iota kappa lambda alpha", ["été", "Élan"], ["doc_1"]),
        (7, "q", "in 2021 alpha", "in 2021 alpha", "in 2020 zeta eta theta iota", [], ["doc_1"]),
    ]
    judged = judging.judge(spark.createDataFrame(rows, schema))
    got = {r["query_id"]: r for r in judged.withColumn("f", judging.failure_type(F.lit(1))).collect()}
    assert got[1]["faithfulness"] == 1.0 and got[1]["f"] == "answer_hallucination"
    assert [got[n]["citation"] for n in (2, 3, 4)] == [0.0, 5.0, 2.0]
    assert got[5]["faithfulness"] == 5.0
    assert got[6]["f"] == "wrong_entity" and got[7]["f"] == "wrong_date"


def test_query_variants_by_hand(spark):
    one = lambda q: spark.range(1).select(query_variants(F.lit(q)).alias("v")).first()["v"]
    assert one("red bus vs. blue car") == ["red bus vs. blue car"]
    assert one("red bus vs blue car?") == ["red bus vs blue car", "red bus", "blue car"]
    assert one("Red bus Versus blue car") == ["Red bus Versus blue car", "Red bus", "blue car"]
    assert one(None) == [] == one(" ? ")


def test_a_long_text_is_cut_in_time_that_grows_with_it(spark):
    import time

    took = []
    for n in (100_000, 400_000):
        frame = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("word "), n).alias("text"))
        chunking.chunk_tokens(frame, 450, 70).agg(F.max("end_char")).first()
        began = time.time()
        last = chunking.chunk_tokens(frame, 450, 70).orderBy(F.col("chunk_index").desc()).first()
        took.append(time.time() - began)
        assert last["end_char"] == 5 * n - 1 and last["start_char"] == 5 * 380 * last["chunk_index"]
    assert took[1] < 10 * took[0] + 2


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.normalize(F.lit("  a  b\n"))) == "a b"
    assert one(text.tokenize(F.lit("Café A_1K x"))) == ["caf", "a_1", "x"]
    assert one(text.truncate(F.lit("a" * 20), 10)) == "aaaaaaa..."
    assert one(text.estimate_tokens(F.lit(""))) == 1 and one(text.estimate_tokens(F.lit("a b c"))) == 3
    assert one(query_variants(F.lit("Compare Red Bus and Blue Car by price"))) == ["Compare Red Bus and Blue Car by price", "Red Bus price", "Blue Car price", "Blue Car"]  # "Compare ..." opens a question: no phrase
    assert one(query_variants(F.lit("What is A and when is B?")))[1:3] == ["What is A", "when is B"]
    assert one(query_variants(F.lit("word"))) == []


def test_sources(spark, tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "doc_1.md").write_text("# Title\r\nbody")
    (folder / "sub" / "my-page.HTML").write_text("<title> A  b </title><script>x</script><p>Hi <b>you</b></p>")
    (folder / "skip.pdf").write_text("no")
    got = {r["extension"]: r for r in documents.read_documents(spark, str(folder)).collect()}
    (tmp_path / "3d-model_x.txt").write_text("# no heading here")
    single = documents.read_documents(spark, f"file://{tmp_path}/3d-model_x.txt").first()
    assert single["title"] == "3D Model X" and single["path"] == f"{tmp_path}/3d-model_x.txt"
    assert set(got) == {".md", ".html"} and got[".md"]["doc_id"] == "doc_1" and got[".md"]["title"] == "Title" and got[".md"]["text"] == "# Title\nbody"
    assert got[".html"]["title"] == "A b" and got[".html"]["text"] == "A b Hi you" and got[".html"]["doc_id"].startswith("doc_")
    with pytest.raises(FileNotFoundError):
        documents.read_documents(spark, str(tmp_path / "none"))
    (tmp_path / "q.jsonl").write_text(json.dumps({"id": "q1", "question": "x", "relevant_doc_ids": ["a", "b"]}) + "\n\n")
    questions = documents.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert questions.first()["category"] == "unknown"
    assert documents.read_qrels(spark, None, questions).count() == 2 == documents.read_qrels(spark, str(tmp_path / "none.jsonl"), questions).count()
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\n{"id": \n')
    with pytest.raises(ValueError, match="bad.jsonl at line 3"):
        documents.read_questions(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"query_id": "q1", "doc_id": "a", "relevance": n}) for n in (1, 3)))
    assert [tuple(r) for r in documents.read_qrels(spark, str(tmp_path / "r.jsonl"), questions).collect()] == [("q1", "a", 3)]


def test_reports(spark, tmp_path):
    frame = spark.createDataFrame([("b", 0.5), ("a\nc", 1.0)], "system string, score double")
    assert reports.leaderboard(frame, ["system", "score"]).splitlines()[2] == "| a c | 1.000 |"
    reports.write_results({"x.csv": frame, "y.jsonl": frame}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/y.jsonl").count() == 2

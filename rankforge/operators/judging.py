"""Extractive answers, heuristic judging, failure classes and label audit, as column expressions.

Rows have ``question, answer, context, reference_answer, expected_keywords, relevant_doc_ids`` (arrays of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.text import WS, normalize, sentences, strip, tokenize

REFUSAL = "I could not find the answer in the provided documents."
#: Answer words that do not count as content, and the failure classes (fixed values).
PLAIN = ["could", "provided", "documents", "answer"]
LABELS = [
    "no_failure", "retrieval_miss", "bad_reranking", "insufficient_context", "answer_hallucination", "wrong_entity", "wrong_date", "partial_answer", "over_refusal", "format_error", "possible_qrels_gap",
]


def refused(text: Column) -> Column:
    low = F.lower(text)
    return low.contains("could not find the answer") | low.contains("not available")


def extractive_answer(question: Column, context: Column) -> Column:
    """The two sentences of the context that share most question tokens (three letters or more), earlier ones first on
    ties; a refusal if none shares any. An answer that cites no document gets the first three, by name, of those in the context's headers."""
    asked = F.array_distinct(F.filter(tokenize(question), lambda t: F.length(t) > 2))
    whole = F.coalesce(context, F.lit(""))
    scored = F.transform(sentences(whole), lambda s, i: F.struct((-F.size(F.array_intersect(asked, tokenize(s)))).alias("o"), i.alias("i"), strip(s).alias("s")))
    best = F.slice(F.array_sort(F.filter(scored, lambda x: x["o"] < 0)), 1, 2)
    said = F.array_join(F.transform(best, lambda x: x["s"]), " ")
    heads = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit(r"\[(doc_[A-Za-z0-9_-]+)\s*\|"), F.lit(1)))), 1, 3)
    cites = F.when(said.rlike(r"\[doc_[A-Za-z0-9_-]+\]") | (F.size(heads) == 0), "").otherwise(F.concat(F.lit(" ["), F.array_join(heads, "] ["), F.lit("]")))
    return F.when(F.size(best) > 0, F.substring(F.concat(said, cites), 1, 1200)).otherwise(F.lit(REFUSAL))


def judge(rows: DataFrame) -> DataFrame:
    """Five scores from 0 to 5, their mean, ``supported``, ``hallucinated`` and ``refused`` added."""
    answer, low = normalize(F.col("answer")), F.lower(normalize(F.col("answer")))
    context = F.lower(normalize(F.col("context")))
    said, reference = tokenize(F.col("answer")), F.array_distinct(tokenize(F.col("reference_answer")))
    hits = F.size(F.filter("expected_keywords", lambda k: low.contains(F.lower(k))))
    by_word = hits / F.greatest(F.lit(1), F.size("expected_keywords"))
    by_text = F.size(F.array_intersect(reference, said)) / F.greatest(F.lit(1), F.size(reference))
    content = F.filter(said, lambda t: (F.length(t) > 3) & ~t.isin(PLAIN))
    support = F.size(F.filter(content, lambda t: context.contains(t))) / F.greatest(F.lit(1), F.size(content))
    cited = F.regexp_extract_all(F.col("answer"), F.lit(r"\[(doc_[A-Za-z0-9_-]+)\]"), F.lit(1))
    out = rows.withColumns({"answerable": F.size("relevant_doc_ids") > 0, "refused": refused(answer), "_c": F.least(F.lit(5.0), 5 * F.greatest(by_word, by_text)), "_f": 5 * F.least(F.lit(1.0), support), "_cited": cited})
    given = F.when(F.col("refused"), 5.0).otherwise(1.0)
    correct = F.when(~F.col("answerable"), given).otherwise(F.when(F.col("refused"), F.least(F.lit(1.0), "_c")).otherwise(F.col("_c")))
    faithful = F.when(~F.col("answerable"), given).otherwise(F.when(F.col("refused"), 4.0).otherwise(F.col("_f")))
    cites = F.when(~F.col("answerable"), F.when(F.col("refused"), 5.0).otherwise(0.0)).when(F.arrays_overlap("_cited", "relevant_doc_ids"), 5.0).when(F.size("_cited") > 0, 2.0).otherwise(0.0)
    out = out.withColumns({"correctness": F.round(correct, 6), "faithfulness": F.round(faithful, 6), "citation": cites})
    out = out.withColumns({"completeness": F.col("correctness"), "relevance": F.col("correctness")})
    axes = ["correctness", "faithfulness", "completeness", "relevance", "citation"]
    out = out.withColumn("answer_score", F.round(sum((F.col(a) for a in axes[1:]), F.col(axes[0])) / 5, 6))
    out = out.withColumn("supported", F.when(~F.col("answerable"), F.col("refused")).otherwise(F.col("faithfulness") >= 3))
    out = out.withColumn("hallucinated", F.when(~F.col("answerable"), ~F.col("refused")).otherwise((F.col("faithfulness") < 2) & ~F.col("refused")))
    return out.drop("_c", "_f", "_cited")


def failure_type(hit5: Column) -> Column:
    """The first rule that holds, over judged rows; ``hit5``: hit among the first five documents."""
    refusal = refused(F.coalesce("answer", F.lit("")))
    years = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\b(20\d\d)\b"), F.lit(1)))
    apart = (F.size(years("answer")) > 0) & (F.size(years("reference_answer")) > 0) & ~F.arrays_overlap(years("answer"), years("reference_answer"))
    capital = F.filter("expected_keywords", lambda k: k.rlike(rf"(?:^|{WS})\p{{IsUppercase}}"))
    absent = (F.size(capital) > 0) & ~F.exists(capital, lambda k: F.lower("answer").contains(F.lower(k)))
    good = (F.col("answer_score") >= 4) & (F.col("faithfulness") >= 4) & ~refusal
    return (
        F.when(~F.col("answerable"), F.when(refusal, "no_failure").otherwise("answer_hallucination"))
        .when((hit5 == 0) & good, "possible_qrels_gap")
        .when(hit5 == 0, "retrieval_miss")
        .when(refusal, "over_refusal")
        .when(F.col("hallucinated"), "answer_hallucination")
        .when((F.col("correctness") >= 3.5) & (F.col("faithfulness") >= 3), "no_failure")
        .when(apart, "wrong_date")
        .when(absent, "wrong_entity")
        .when(F.col("correctness") > 1.5, "partial_answer")
        .otherwise("insufficient_context")
    )


def failure_summary(rows: DataFrame, *groups: str) -> DataFrame:
    """Counts of each failure, and the first question that shows it."""
    bad = rows.where(F.col("failure_type") != "no_failure")
    return bad.groupBy(*groups, "failure_type").agg(F.count("*").alias("n"), F.min_by("question", "query_id").alias("example"))


def qrels_audit(rows: DataFrame, retrieved: DataFrame, qrels: DataFrame) -> DataFrame:
    """Answerable questions, well answered from documents that no label names. ``rows`` have ``recall5, hit5``."""
    unlabelled = retrieved.select("query_id", "doc_id").distinct().join(qrels.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    listed = unlabelled.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), ", ").alias("unlabelled_docs"))
    suspect = rows.where(F.col("answerable") & (F.col("recall5") < 1) & (F.col("answer_score") >= 4) & (F.col("faithfulness") >= 4))
    return suspect.join(listed, "query_id").select("query_id", F.when(F.col("hit5") == 0, "high").otherwise("medium").alias("severity"), "unlabelled_docs")

"""The corpus pipeline: operators of ``rankforge.llm`` in stages, each over all that the one before it kept.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Null texts, repeated rows and
null identifiers are handled as the operators say; empty tables go through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import bpe_lexicon, line_spread, positional_index, shared, simhash_copies, toxicity_ssk

TOKENIZER = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored as toxic go."""
    model = toxicity_ssk.fit(docs, shared.table(spark, sf_dir, "labels"))
    return toxicity_ssk.score(docs, model).where("__predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay only where they stand first; no document goes."""
    out = line_spread.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash candidates that a pivot distance table leaves, five-word shingles, Jaccard similarity of 0.8 or more) stays."""
    return simhash_copies.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    named = docs.withColumn("__key", key)
    found = positional_index.contamination(named, shared.table(spark, sf_dir, "benchmark"), id_col="__key")
    leaks = found.where(F.size("hit") > 0).select("__key").distinct()
    return named.join(leaks, "__key", "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document that is left."""
    return bpe_lexicon.encode_documents(docs, public_tokenizers.path(TOKENIZER), digests=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: String kernels, fingerprints and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import positional_index, toxicity_ssk
from rankforge.llm.bpe_lexicon import encode_documents
from rankforge.llm.line_spread import ORACLE as LINE_SQL
from rankforge.llm.line_spread import line_report
from rankforge.llm.quality_mcd import judge
from rankforge.llm.sentence_spans import span_report
from rankforge.llm.shared import table
from rankforge.llm.simhash_pivots import near_duplicates
from rankforge.llm.token_counts import count_tokens
from rankforge.llm.token_sst import token_tables
from rankforge.llm.warc_zst import ORACLE as WARC_SQL
from rankforge.llm.warc_zst import archived


def op1_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op2_toxicity_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_ssk.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op4_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op8_warc_zst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


QUERIES = {
    "op1_bpe_lexicon": op1_bpe_lexicon,
    "op2_toxicity_ssk": op2_toxicity_ssk,
    "op3_line_spread": op3_line_spread,
    "op4_token_sst": op4_token_sst,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_simhash_pivots": op6_simhash_pivots,
    "op7_quality_mcd": op7_quality_mcd,
    "op8_warc_zst": op8_warc_zst,
    "op9_positional_index": op9_positional_index,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {"op3_line_spread": LINE_SQL, "op8_warc_zst": WARC_SQL}

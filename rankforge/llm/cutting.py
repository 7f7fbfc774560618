"""Taking pieces (lines, sentences) out of documents; shared by the line and the span operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What names a document in the operators that cut: equal identifier and equal text count as one document.
KEY = ["__id", "__th"]


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Identifier, hash of the text, text (null: empty) under names that clash with no column of the input."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"), *more)


def cut_positions(covered: DataFrame) -> DataFrame:
    """``__id, __th, __from, __to`` (positions, inclusive) -> a sorted set of positions a document. A document's list
    is bounded by its own pieces."""
    spread = covered.groupBy(*KEY).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("__from", "__to"))))).alias("__cut"))
    return spread


def with_cuts(df: DataFrame, cuts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows and columns of ``df`` with ``__cut`` (empty where nothing is cut) added.

    The rows of one document name (exact repeats) may be many; the join's other side has one row a name, so adaptive
    execution can split them.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    left = df.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(text)})
    right = cuts.select(F.col("__id").alias("__rid"), F.col("__th").alias("__rth"), "__cut")
    joined = left.join(right, left["__id"].eqNullSafe(right["__rid"]) & (left["__th"] == right["__rth"]), "left")
    return joined.drop("__id", "__th", "__rid", "__rth").withColumn("__cut", F.coalesce("__cut", F.array().cast("array<int>")))


def without(df: DataFrame, cuts: DataFrame, id_col: str, text_col: str, pieces) -> DataFrame:
    """As :func:`with_cuts`, with the text's ``__pieces`` too."""
    return with_cuts(df, cuts, id_col, text_col).withColumn("__pieces", pieces(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def kept_pieces() -> Column:
    """The pieces whose positions are not cut; untouched documents skip the filter."""
    kept = F.filter("__pieces", lambda x, i: ~F.array_contains(F.col("__cut"), i))
    return F.when(F.size("__cut") == 0, F.col("__pieces")).otherwise(kept)

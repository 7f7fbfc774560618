"""Stored vector collections: the vectors of a chunk table, written once as Parquet and searched as often as wanted.

Search is exact: every stored vector is scored against every question, in the order of :func:`rankforge.operators.retrieval.array_search`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import models, retrieval

#: A store's names: letters, digits, low lines and hyphens, a letter or digit at both ends, 63 characters at most.
NAME = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_-]{0,61}[A-Za-z0-9])?")


def collection_name(name: str) -> str:
    """The first part of ``name`` that is a store's name, other characters taken as low lines; of fewer than three characters, behind
    ``collection``."""
    found = NAME.search("_".join(re.findall(r"[A-Za-z0-9_-]+", name)))
    own = found[0] if found else ""
    return own if len(own) > 2 else "_".join(filter(None, ("collection", own)))


def flat_metadata(frame: DataFrame) -> DataFrame:
    """Columns that a flat store takes: texts, numbers and booleans as they are, all others as JSON text. Nulls stay null, which a store
    leaves out."""
    plain = re.compile(r"string|boolean|tinyint|smallint|int|bigint|float|double|varchar.*|char.*")

    def flat(name: str, kind: str) -> Column:
        own = F.col(f"`{name}`")
        if plain.fullmatch(kind):
            return own
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(own).alias(name)
        return F.when(own.isNotNull(), F.concat(F.lit('"'), own.cast("string"), F.lit('"'))).alias(name)

    return frame.select(*[flat(n, k) for n, k in frame.dtypes])


def write_collection(chunks: DataFrame, folder: str, name: str, embedder: models.Embedder) -> str:
    """Embed ``chunks`` (``doc_id, chunk_index, text`` and more) and write them with their ``embedding``; an older collection of that name is
    replaced. Returns its path, in any store that Spark writes."""
    path = f"{folder.rstrip('/')}/{collection_name(name)}"
    models.embed(flat_metadata(chunks), embedder).write.mode("overwrite").parquet(path)
    return path


def search_collection(spark: SparkSession, path: str, queries: DataFrame, k: int, embedder: models.Embedder) -> DataFrame:
    """The best ``k`` stored chunks of each question (``query_id, text``)."""
    asked = models.embed(queries.select("query_id", "text"), embedder)
    return retrieval.array_search(spark.read.parquet(path), retrieval.CHUNK, "embedding", asked, k)

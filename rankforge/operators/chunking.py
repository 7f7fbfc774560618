"""Chunkers: documents to rows of text windows, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.text import NWS, WS, chunk_id, strip


def _checked(size: int, overlap: int) -> int:
    if size <= 0 or overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return size - overlap


def units_of(text: Column) -> Column:
    """Each token with the white space before it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{WS}*{NWS}+"), F.lit(0))


def token_windows(units: Column, size: int, overlap: int) -> Column:
    """Array of ``(start_char, end_char, text)`` windows over :func:`units_of` (a column, not an expression: it is used many times); the text is
    the original slice."""
    stride = _checked(size, overlap)
    n = F.size(units)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")

    # characters of each stride, then their running sums: a window's start without reading again what is before it
    strides = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.length(F.array_join(F.slice(units, k * stride + 1, stride), "")))
    starts = F.aggregate(strides, F.array(F.lit(0)), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))

    def window(before: Column, k: Column) -> Column:
        raw = F.array_join(F.slice(units, k * stride + 1, size), "")
        return F.struct(before.alias("before"), raw.alias("raw"), F.regexp_replace(raw, f"^{WS}+", "").alias("text"))

    placed = lambda w: F.struct((w["before"] + F.length(w["raw"]) - F.length(w["text"])).alias("start_char"), (w["before"] + F.length(w["raw"])).alias("end_char"), w["text"].alias("text"))
    none = F.array().cast("array<struct<start_char:int,end_char:int,text:string>>")
    return F.when(count == 0, none).otherwise(F.transform(F.transform(F.slice(starts, 1, count), window), placed))


def spread(docs: DataFrame) -> DataFrame:
    """A table of fewer splits than the cluster has cores, dealt out; others as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of characters; blank ones are left out and take no index."""
    stride = _checked(size, overlap)
    n = F.length(text)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((k * stride).alias("start_char"), F.least(k * stride + size, n).alias("end_char"), F.substring(text, k * stride + 1, F.lit(size)).alias("text")))
    return F.filter(F.when(count > 0, windows).otherwise(F.array().cast("array<struct<start_char:int,end_char:int,text:string>>")), lambda w: F.length(strip(w["text"])) > 0)


def _rows(docs: DataFrame, windows: Column, id_col: str) -> DataFrame:
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(windows).alias("chunk_index", "w")).select("doc_id", "chunk_index", "w.*")
    own = chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("start_char"), F.col("end_char"), F.col("text"))
    return out.select(own.alias("chunk_id"), "doc_id", "chunk_index", "start_char", "end_char", strip(F.col("text")).alias("text"))


def chunk_tokens(docs: DataFrame, size: int = 500, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    cut = spread(docs.select(id_col, text_col)).select(id_col, units_of(F.col(text_col)).alias("__u"))
    return _rows(cut, token_windows(F.col("__u"), size, overlap), id_col)


def chunk_chars(docs: DataFrame, size: int = 1200, overlap: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _rows(spread(docs.select(id_col, text_col)), char_windows(F.coalesce(F.col(text_col), F.lit("")), size, overlap), id_col)


def chunk_markdown(docs: DataFrame, size: int = 500, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sections at headings of level one to four (text before the first is left out; none: the whole text), then token windows. Offsets
    are the section's own; ``section`` numbers sections within the document, ``section_chunk`` windows within the section, and
    ``chunk_index`` all of the document's."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(whole, r"(?dm)^(?=#{1,4}[ \t]+\S)")
    headed = F.filter(parts, lambda s: s.rlike(r"^#{1,4}[ \t]+\S"))
    sections = F.when(F.size(headed) > 0, headed).otherwise(F.array(whole))
    cut = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), F.transform(sections, lambda s: F.struct(s.alias("body"), units_of(s).alias("units"))).alias("__s"))
    title = lambda body: strip(F.nullif(F.regexp_extract(body, r"^#{1,4}[ \t]+([^\n]+)", 1), F.lit("")))
    placed = lambda s, i: F.transform(token_windows(s["units"], size, overlap), lambda w, j: F.struct(i.alias("section"), title(s["body"]).alias("title"), j.alias("section_chunk"), w["start_char"].alias("start_char"), w["end_char"].alias("end_char"), w["text"].alias("text")))
    out = cut.select("doc_id", F.posexplode(F.flatten(F.transform("__s", placed))).alias("chunk_index", "w")).select("doc_id", "chunk_index", "w.*")
    own = chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("start_char"), F.col("end_char"), F.col("text"))
    return out.select(own.alias("chunk_id"), "doc_id", "chunk_index", "section", "title", "section_chunk", "start_char", "end_char", strip(F.col("text")).alias("text"))


def chunk_parents(docs: DataFrame, parent: tuple[int, int] = (1000, 150), child: tuple[int, int] = (250, 50), id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Parent chunks, and their child chunks with offsets inside the parent and the parent's identifier."""
    parents = chunk_tokens(docs, *parent, id_col=id_col, text_col=text_col)
    kids = parents.select("doc_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("chunk_index").alias("parent_index"), units_of(F.col("text")).alias("__u"))
    kids = kids.select("doc_id", "parent_chunk_id", "parent_index", F.posexplode(token_windows(F.col("__u"), *child)).alias("child_index", "w"))
    return parents, kids.select("doc_id", "parent_chunk_id", "parent_index", "child_index", "w.start_char", "w.end_char", strip(F.col("w.text")).alias("text"))


CHUNKERS = {name: f for names, f in ((("token", "tokenish", "word"), chunk_tokens), (("fixed", "fixed_char", "character"), chunk_chars), (("markdown", "md"), chunk_markdown)) for name in names}


def make_chunks(docs: DataFrame, kind: str = "token", **options) -> DataFrame:
    if kind not in CHUNKERS:
        raise ValueError(f"unknown chunker: {kind}")
    return CHUNKERS[kind](docs, **options)

"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by documents: a shard of at most about ``SHARD_WORDS`` positions (a longer text is a shard of its own)
holds, for every term, its sorted positions, and a table of its documents; it is stored as Parquet rows ``(shard, term,
postings)``. Test terms select rows by a join, and a shard's rows meet in one bounded group, where each window's lists, moved by
their offsets, are intersected from the rarest on. Exact phrases come out, or with ``slop`` proximity matches: a window matches where
each of its terms has a position in one document such that the positions, each less its term's place in the window, lie within ``slop`` of each
other. That names no term first, so it doesn't depend on how documents are dealt to shards.

The test items are the stated query set: they come to the driver in blocks of about ``BLOCK_WORDS`` words, each run against the
whole index; with several blocks each one's matches are written before the next.

Defined cases: a null text has no words; items without words give no window; an item of fewer words than a window is one
window; items that repeat an identifier add to the same one; a null item identifier counts as the text ``null``; rows that
repeat are kept, a row each; empty tables give no hits or an empty frame; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import released, slices, written

WINDOW, SHARD_WORDS, BLOCK_WORDS = 10, 1_000_000, 300_000
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of letters, digits and characters beyond ASCII."""
    return (text or "").encode("utf-8").translate(TABLE).split()


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, gap: int = 1) -> DataFrame:
    """The stored index: ``shard, term, postings``. A row without term holds the shard's documents: identifiers as
    Arrow, and their numbers of words. Positions run on through a shard with a ``gap`` between documents: at least a window's words and
    the slop, if proximity is to be asked."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        released()
        part, state = TaskContext.get().partitionId() << 32, [0]

        def shard(ids, kind, words, sizes):
            vocabulary: dict[bytes, int] = {}
            codes = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for ws in words for w in ws), "i4", sum(sizes))
            positions = np.arange(len(codes), dtype="i4") + gap * np.repeat(np.arange(len(sizes), dtype="i4"), sizes)
            order = np.argsort(codes, kind="stable")
            ends = np.cumsum(np.bincount(codes, minlength=len(vocabulary))) if vocabulary else np.array([], "i8")
            placed = positions[order].tobytes()
            number = part + state[0]
            state[0] += 1
            table = pa.table({"id": pa.array(ids, kind), "n": pa.array(sizes, pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([None], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "term", "postings"])
            names = list(vocabulary)
            for at in range(0, len(names), 20_000):
                some = ends[at : at + 20_000]
                begin = 4 * int(ends[at - 1]) if at else 0
                offsets = np.concatenate([[0], 4 * some - begin]).astype("i4")
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(placed[begin : 4 * int(some[-1])])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(names[at : at + 20_000], pa.binary()), lists], names=["shard", "term", "postings"])

        ids, words, sizes, total, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for some in slices(batch):
                for identifier, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    found = terms(text)
                    if ids and total + len(found) > shard_words:
                        yield from shard(ids, kind, words, sizes)
                        ids, words, sizes, total = [], [], [], 0
                    ids.append(identifier)
                    words.append(found)
                    sizes.append(len(found))
                    total += len(found) + gap
        if ids:
            yield from shard(ids, kind, words, sizes)
        del ids, words, sizes
        released()

    return written(src.mapInArrow(run, "shard long, term binary, postings binary"), "positions")


def windows_of(items: list[tuple], window: int) -> dict[tuple[bytes, ...], set[str]]:
    """Each different window and the identifiers of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for identifier, text in items:
        words = terms(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found[tuple(words[i : i + window])].add("null" if identifier is None else str(identifier))
    return dict(found)


def phrase_places(window: tuple[bytes, ...], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Positions where the window starts: the offset-adjusted lists of its terms, intersected from the rarest on."""
    places = None
    for offset in sorted(range(len(window)), key=lambda i: len(lists.get(window[i], ()))):
        postings = lists.get(window[offset])
        if postings is None:
            return np.array([], "i8")
        if places is None:
            places = postings.astype("i8") - offset
            places = places[places >= 0]
            continue
        wanted = places + offset
        at = np.searchsorted(postings, wanted)
        inside = at < len(postings)
        ok = np.zeros(len(places), bool)
        ok[inside] = postings[at[inside]] == wanted[inside]
        places = places[ok]
        if not len(places):
            break
    return places


def near_places(window: tuple[bytes, ...], lists: dict[bytes, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the proximity matches: for every adjusted position that is the least of a match, each term's
    nearest one from there on."""
    adjusted = [lists[t].astype("i8") - i for i, t in enumerate(window)] if all(t in lists for t in window) else []
    if not adjusted:
        return np.array([], "i8"), np.array([], "i8")
    starts = np.unique(np.concatenate(adjusted))
    found = []
    for a in sorted(adjusted, key=len):  # the rarest term leaves the fewest starts
        at = np.searchsorted(a, starts)
        ok = at < len(a)
        ok[ok] = a[at[ok]] <= starts[ok] + slop
        starts = starts[ok]
        if not len(starts):
            return starts, starts
    for i, a in enumerate(adjusted):
        found.append(a[np.searchsorted(a, starts)] + i)
    return np.min(found, axis=0), np.max(found, axis=0)


def match_block(index: DataFrame, windows: dict[tuple[bytes, ...], set[str]], kind: str, id_col: str, slop: int = 0, gap: int = 1) -> DataFrame:
    """Each document of the index with ``n_words``, the spans that windows cover and the items that match."""
    spark = index.sparkSession
    wanted = sorted({t for w in windows for t in w})
    asked = spark.createDataFrame([(t,) for t in wanted], "term binary") if wanted else spark.createDataFrame([], "term binary")
    # the block bounds these terms, and with them what is broadcast
    rows = index.join(F.broadcast(asked), "term", "left_semi").unionByName(index.where(F.col("term").isNull()))
    listed = spark.sparkContext.broadcast(sorted(windows.items()))
    schema = f"shard long, place int, `{id_col}` {kind}, n_words long, hit array<struct<a:int,b:int>>, items array<string>"

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        documents = frame.loc[frame["term"].isna(), "postings"].iloc[0]
        table = pa.ipc.open_stream(bytes(documents)).read_all()
        sizes = table.column("n").to_numpy()
        start = np.cumsum(sizes + gap) - sizes - gap
        rest = frame[~frame["term"].isna()]
        lists = {bytes(t): np.frombuffer(p, "<i4") for t, p in zip(rest["term"], rest["postings"], strict=True)}
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for window, names in listed.value:
            if not all(t in lists for t in window):
                continue
            if slop:
                first, last = near_places(window, lists, slop)
            else:
                first = phrase_places(window, lists)
                last = first + len(window) - 1
            if not len(first):
                continue
            doc = np.searchsorted(start, first, "right") - 1
            inside = last < start[doc] + sizes[doc]
            for d, a, b in zip(doc[inside].tolist(), first[inside].tolist(), last[inside].tolist(), strict=True):
                spans[d].append((a - int(start[d]), b + 1 - int(start[d])))
                items[d] |= names
        merged = [_merged(spans[d]) if d in spans else [] for d in range(len(sizes))]
        n = len(sizes)
        return pd.DataFrame({
            "shard": np.full(n, frame["shard"].iloc[0]), "place": np.arange(n), id_col: table.column("id").to_pandas(integer_object_nulls=True), "n_words": sizes,
            "hit": merged, "items": [sorted(items[d]) if d in items else [] for d in range(n)],
        })

    return rows.groupBy("shard").applyInPandas(shard, schema)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for every row: ``id_col, n_words, hit`` (word spans from, up to), ``items`` (sorted texts of identifiers)."""
    gap = 1 if not slop else window + slop + 1
    index = build_index(df, id_col, text_col, shard_words, gap)
    kind = dict(df.dtypes)[id_col]
    paths, block, words = [], [], 0

    def matched():
        return match_block(index, windows_of(block, window), kind, id_col, slop, gap)

    for row in benchmark.select(F.col(item_col), F.col(item_text).cast("string")).toLocalIterator():
        own = len(terms(row[1]))
        if block and words + own > block_words:
            paths.append(written(matched(), "matches"))
            block, words = [], 0
        block.append((row[0], row[1]))
        words += own
    if not paths:
        return matched().select(id_col, "n_words", "hit", "items")
    found = written(matched(), "matches")
    for more in paths:
        found = found.unionByName(more)
    # a document's place in the index names it; a row a block meets here
    found = found.groupBy("shard", "place").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit")).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    schema = found.select(id_col, "n_words", "hit", "items").schema

    def joined(batches):
        for batch in batches:
            hits = [_merged([(x["a"], x["b"]) for x in spans]) for spans in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, batch.schema.field(2).type), batch.column(3)], names=batch.schema.names)

    return found.select(id_col, "n_words", "hit", "items").mapInArrow(joined, schema)


def report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    found = contamination(df, benchmark, id_col, **options)
    hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )

"""Helpers that the training-data operators share: the shared folder, table access and mergeable summaries."""

from __future__ import annotations

import ctypes
import gc
import os
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (local tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Rows turned into Python objects at once; summaries that one task merges.
SLICE, FAN = 64, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = LOCAL_CHECKPOINTS
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The frame, written once to the shared folder and read again: later readers don't compute it anew, and
    executors may be lost."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(folder: str):
    """A pyarrow file system and path for a folder of the shared store; the folder is made if missing."""
    import re

    from pyarrow import fs

    local = re.match(r"^(?:file:)?(/.*)$", re.sub(r"^file:/*", "file:/", folder))
    store, path = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def put_file(folder: str, name: str, data_parts: Iterable[bytes]) -> int:
    """Write parts under a name of this attempt, then move it to its own name: a lost or repeated task leaves one
    whole file. Returns the bytes written."""
    store, path = filesystem(folder)
    attempt = f"{path}/.{name}.{uuid.uuid4().hex}"
    size = 0
    with store.open_output_stream(attempt, compression=None) as out:
        for part in data_parts:
            out.write(part)
            size += len(part)
    store.move(attempt, f"{path}/{name}")
    return size


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def space_chunks(text: str) -> list[str]:
    """Pieces between blanks and line feeds (some may be empty)."""
    return (text.replace("\n", " ") if "\n" in text else text).split(" ")


def lowered(text: str) -> str:
    """The text in lower case where that cannot change its tokens in a lower-casing vocabulary, else as it is."""
    if "<|" in text or "Σ" in text:
        return text
    if text.isascii():
        return text.lower()
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


def lower_chunks(text: str) -> list[str]:
    return space_chunks(lowered(text))


def forget(known: dict, limit: int, coming: int) -> None:
    """Make room: the oldest half of what is remembered goes."""
    if len(known) + coming > limit:
        for key in list(islice(known, max(len(known) // 2, len(known) + coming - limit))):
            del known[key]


class ChunkCoder:
    """Ids of whole texts, put together from the ids of their chunks, of which a bounded number is remembered.

    For vocabularies that lower-case, drop white space and part letters from signs, so that texts may be cut at blanks
    and before closing signs that follow a letter. ``new_ids`` encodes chunks that are not remembered.
    """

    TAIL = ",.;:!?|"

    def __init__(self, new_ids: Callable[[list[str]], list[list[int]]], vocabulary: int, remembered: int):
        self.new, self.limit = new_ids, remembered
        self.kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> list[str]:
        """Make all of ``chunks`` known; returns those to forget again at once: a word with signs behind it, seen with the
        word itself for the first time, is not worth the room."""
        known, whole, parted = self.known, [], []
        for chunk in chunks:
            body = chunk.rstrip(self.TAIL)
            if len(body) < len(chunk) and body and body[-1].lower().isalpha():
                parted.append((chunk, body, chunk[len(body) :]))
            else:
                whole.append(chunk)
        missing = {*whole, *(x for _, body, tail in parted for x in (body, tail))}
        missing = [x for x in missing if x not in known]
        if missing:
            ids = self.new(missing)
            flat = np.fromiter((i for x in ids for i in x), self.kind).tobytes()
            wide, at = int(self.kind[-1]), 0
            for chunk, x in zip(missing, ids, strict=True):
                end = at + wide * len(x)
                known[chunk] = flat[at:end]
                at = end
        fresh = set(missing)
        for chunk, body, tail in parted:
            known[chunk] = known[body] + known[tail]
        return [chunk for chunk, body, _ in parted if body in fresh]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [lower_chunks(t) if t else [] for t in texts]
        every = set().union(*split)
        new = list(every.difference(self.known))
        if len(self.known) + 2 * len(new) > self.limit:
            forget(self.known, self.limit, 2 * len(new))
            new = list(every.difference(self.known))
        once = self.learn(new) if new else []
        known = self.known
        out = [np.frombuffer(b"".join([known[c] for c in chunks]), self.kind) for chunks in split]
        for chunk in once:
            known.pop(chunk, None)
        return out


# -- frequent chunks: bounded summaries, merged without moving the chunks themselves ------------------------------


def merged_by_tree(parts: DataFrame, merge: Callable, fan: int = FAN) -> DataFrame:
    """Summaries, one a partition with its number as ``p``, merged by ``merge(frame) -> frame`` in groups of at most ``fan``, and these
    again, until one is left: no task reads more than ``fan`` summaries, however many partitions there are."""
    n, kinds = parts.rdd.getNumPartitions(), ", ".join(f"{c} {t}" for c, t in parts.dtypes)
    while n > 1:
        parts = parts.withColumn("p", F.floor(F.col("p") / fan).cast("long")).groupBy("p").applyInPandas(merge, kinds)
        n = -(-n // fan)
    return parts


def _pruned(counts: Counter, capacity: int) -> Counter:
    return Counter(dict(counts.most_common(capacity))) if len(counts) > capacity else counts


def _packed(counts: Counter) -> tuple[str, bytes]:
    items = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    return " ".join(k for k, _ in items), np.array([v for _, v in items], "<i8").tobytes()


def _unpacked(keys: str, values: bytes) -> dict[str, int]:
    return dict(zip(keys.split(" "), np.frombuffer(values, "<i8").tolist(), strict=True)) if keys else {}


def frequent_chunks(df: DataFrame, text_col: str, split: Callable[[str], list[str]], capacity: int) -> list[tuple[str, int]]:
    """The about ``capacity`` most frequent chunks of all texts, with lower bounds of their counts.

    Every row is read. A partition keeps a summary of at most ``8 * capacity`` counters (pruned to ``capacity`` when
    full) and sends ``capacity`` of them; summaries are merged on executors by :func:`merged_by_tree`, and the driver is sent one. Chunks
    hold no blanks. Used for caches, never for results. Nulls and empty tables give no chunks.
    """

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        counts.update(split(text))
                if len(counts) > 8 * capacity:
                    counts = _pruned(counts, capacity)
        counts.pop("", None)
        keys, values = _packed(_pruned(counts, capacity))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([keys]), pa.array([values], pa.binary())], names=["p", "k", "v"])

    def merge(frame):
        import pandas as pd

        total: Counter = Counter()
        for k, v in zip(frame["k"], frame["v"], strict=True):
            total.update(_unpacked(k, v))
            total = _pruned(total, 4 * capacity)
        return pd.DataFrame([(frame["p"].iloc[0], *_packed(_pruned(total, capacity)))], columns=["p", "k", "v"])

    total: Counter = Counter()
    for row in merged_by_tree(df.select(F.col(text_col)).mapInArrow(summarise, "p long, k string, v binary"), merge).collect():  # one row at most
        total.update(_unpacked(row["k"], bytes(row["v"])))
    return sorted(_pruned(total, capacity).items(), key=lambda x: (-x[1], x[0]))


# -- what a worker process holds: it outlives its tasks, and those of one operator those of the next ---------------

_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """What ``make`` gives, held by this worker process for later tasks. It holds one such thing: another key, or :func:`released`, ends it."""
    if key not in _KEPT:
        released()
        _KEPT[key] = make()
    return _KEPT[key]


def released() -> None:
    """What earlier tasks of this worker process hold goes, and free memory goes back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def worker_threads_off() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")

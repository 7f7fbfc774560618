"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

The first tier is a compact hash table of the token counts of the corpus's frequent pre-tokens, broadcast (at most
``TABLE`` entries of a sorted 128-bit hash and a count: 18 bytes each). Each partition counts its pre-tokens, encodes its own most
frequent ones and sends hashes, counts and lengths, never a pre-token; these summaries are merged on executors. What the table lacks
is encoded by the sentencepiece library and remembered in a bounded cache of the worker. Exact because no piece of the vocabulary holds a word-start mark behind another character (checked when the
model is loaded): merges never cross the point between a non-blank and a blank.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated or null identifiers are kept, a
row each; an empty table gives an empty frame; further columns are ignored. Texts are counted whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import forget, merged_by_tree, slices

MARK = "▁"
#: Entries of the broadcast table and of a worker's cache: bounds of memory, not of results.
TABLE, CACHE = 50_000, 500_000
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, each without the one mark that the library puts before it."""
    if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return [run[1:].replace(MARK, " ") for run in RUNS.findall(MARK + text.replace(" ", MARK))]


#: A pre-token in a summary: its 128-bit hash, its number of tokens, how often it was seen. The table has all but the last.
SEEN = np.dtype([("h", "<u8"), ("g", "<u8"), ("tokens", "<u2"), ("n", "<i8")])
LENGTH = np.dtype([("h", "<u8"), ("g", "<u8"), ("tokens", "<u2")])


def hashes_of(tokens: list[str]) -> np.ndarray:
    """The 128-bit hashes of pre-tokens, as rows of two words."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in tokens]), "<u8").reshape(-1, 2)


def merged_seen(parts: list[np.ndarray], capacity: int) -> np.ndarray:
    """Summaries put together: counts of equal hashes added up, the ``capacity`` most frequent kept."""
    every = np.sort(np.concatenate([np.zeros(0, SEEN), *parts]), order=["h", "g"])
    if not len(every):
        return every
    start = np.flatnonzero(np.r_[True, (every["h"][1:] != every["h"][:-1]) | (every["g"][1:] != every["g"][:-1])])
    total = every[start]
    total["n"] = np.add.reduceat(every["n"], start)
    return total[np.lexsort((total["g"], total["h"], -total["n"]))[:capacity]]


class PieceCounter:
    def __init__(self, model: str, table: bytes = b"", cache: int = CACHE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())):
            raise ValueError("pieces of this vocabulary cross word starts")
        self.table, self.limit = np.frombuffer(table, LENGTH), cache
        self.first = np.ascontiguousarray(self.table["h"])
        self.known: dict[str, int] = {}

    def encoded(self, tokens: list[str]) -> list[int]:
        # an empty pre-token stands for a mark alone, which the library gives for no text of its own
        return [len(x) if t else 1 for t, x in zip(tokens, self.model.encode(tokens, num_threads=1), strict=True)]

    def looked_up(self, tokens: list[str]) -> list[int]:
        """Counts from the broadcast table, of what it lacks from the library."""
        if not len(self.table):
            return self.encoded(tokens)
        found = hashes_of(tokens)
        at = np.minimum(np.searchsorted(self.first, found[:, 0]), len(self.first) - 1)
        hit = (self.first[at] == found[:, 0]) & (self.table["g"][at] == found[:, 1])
        out = self.table["tokens"][at].astype("i8")
        missed = np.flatnonzero(~hit).tolist()
        if missed:
            out[missed] = self.encoded([tokens[i] for i in missed])
        return out.tolist()

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [pre_tokens(t) if t else [] for t in texts]
        every = set().union(*split)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > self.limit:
            forget(self.known, self.limit, len(new))
            new = list(every.difference(self.known))
        if new:
            self.known.update(zip(new, self.looked_up(new), strict=True))
        known = self.known
        return [sum([known[t] for t in tokens]) for tokens in split]


_COUNTERS: dict[tuple, PieceCounter] = {}


def worker_counter(model: str, table) -> PieceCounter:
    key = (model, table.id if hasattr(table, "id") else id(table))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PieceCounter(model, table.value)
    return _COUNTERS[key]


def frequent_lengths(df: DataFrame, text_col: str, model: str, size: int = TABLE) -> bytes:
    """The table (:data:`LENGTH`, sorted by hash) of the about ``size`` most frequent pre-tokens of all texts. Every row is read; a
    partition holds at most ``8 * size`` counters."""

    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        counts.update(pre_tokens(text))
                if len(counts) > 8 * size:
                    counts = Counter(dict(counts.most_common(size)))
        tokens = [t for t, n in counts.most_common(size) if n > 1]
        out = np.zeros(len(tokens), SEEN)
        if tokens:
            lengths = PieceCounter(model).encoded(tokens)
            out["h"], out["g"] = hashes_of(tokens).T
            out["tokens"], out["n"] = np.minimum(lengths, 65535), [counts[t] for t in tokens]
            out = out[np.array(lengths) < 65535]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["p", "v"])

    def merge(frame):
        import pandas as pd

        total = np.zeros(0, SEEN)
        for v in frame["v"]:
            total = merged_seen([total, np.frombuffer(v, SEEN)], 4 * size)
        return pd.DataFrame([(frame["p"].iloc[0], merged_seen([total], size).tobytes())], columns=["p", "v"])

    rows = merged_by_tree(df.select(F.col(text_col)).mapInArrow(summarise, "p long, v binary"), merge).collect()  # one row at most
    total = merged_seen([np.frombuffer(bytes(r["v"]), SEEN) for r in rows], size)
    table = np.zeros(len(total), LENGTH)
    for c in LENGTH.names:
        table[c] = total[c]
    return np.sort(table, order=["h", "g"]).tobytes()


def count_tokens(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, table_size: int = TABLE) -> DataFrame:
    """Returns ``id_col, n_bytes, n_tokens, over_limit`` of every whole text."""
    spark = df.sparkSession
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    table = spark.sparkContext.broadcast(frequent_lengths(src, "__text", model, table_size))

    def run(batches):
        counter = worker_counter(model, table)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1)
                n = counter.counts(texts.to_pylist())
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, n_bytes long, n_tokens long, over_limit boolean")

"""Substring dedup by sliding sentence spans.

Texts are parted into sentences (the parts put together are the text again). Every run of several consecutive
sentences (two of ``WORDS_OF_TWO`` words or more together, three of ``WORDS_OF_THREE`` or more, and from each start whose three
are fewer the run of more than three that first reaches ``WORDS_OF_THREE``) is hashed; equal runs meet by aggregation over all
documents, which finds the first of each (by identifier, hash of the text, position); a join marks every further
one, and the sentences that any of them covers are taken out. The word floors keep runs of very short sentences, which repeat
by chance, from counting.

Defined cases: a null text counts as empty; letter case and the amount of white space don't matter when runs are compared;
rows that repeat identifier and text are one document and get the same result; null identifiers sort first; an empty
table gives an empty frame; other columns pass through. A text is cut as a whole, however long. Runs are told
apart by 128 bits of hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.cutting import KEY, cut_positions, keyed, with_cuts
from rankforge.llm.shared import slices, written

WORDS_OF_TWO, WORDS_OF_THREE = 25, 15
#: Places from which a run is dealt out to ``SALTS`` tasks, and runs up to which these are broadcast (17 bytes each).
HOT, SALTS, FEW_HOT = 2_000, 64, 100_000
#: Ends behind a closing sign with white space after it, or behind a line feed, where something follows.
BOUNDARY = re.compile(r"[.!?][ \t\r\n]{1,8}(?=[^ \t\r\n])|\n(?=[^ \t\r\n])")
#: Odd multipliers that mix the sentences' hashes into a run's (64-bit golden ratio and its like).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "u8")


def sentences(text: str) -> list[str]:
    """The text's sentences; put together they are the text."""
    cuts = [m.end() for m in BOUNDARY.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if cuts else [text]


def run_hashes(parts: list[str], two: int, three: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence and two 64-bit hashes of each run that is long enough."""
    words = [s.split() for s in parts]
    size = np.fromiter(map(len, words), "i8", len(words))
    digests = b"".join([xxhash.xxh3_128_digest(" ".join(w).lower().encode("utf-8", "surrogatepass")) for w in words])
    hashes = np.frombuffer(digests, "<u8").reshape(-1, 2)
    first, last, mixed = [], [], []
    for k, least in ((2, two), (3, three)):
        n = len(parts) - k + 1
        if n < 1:
            continue
        total = sum(size[j : j + n] for j in range(k))
        at = np.flatnonzero(total >= least)
        out = np.full((len(at), 2), k, "u8")
        for j in range(k):
            out = (out ^ hashes[at + j]) * MIX[j]
            out ^= out >> np.uint64(29)
        first.append(at)
        last.append(at + k - 1)
        mixed.append(out)
    ends = np.concatenate([[0], np.cumsum(size)])
    start = np.arange(len(parts))
    stop = np.searchsorted(ends, ends[:-1] + three)  # the run's sentences end before it
    longer = (stop <= len(parts)) & (stop - start > 3)
    start, stop = start[longer], stop[longer]
    if len(start):
        out = np.repeat((stop - start).astype("u8")[:, None], 2, axis=1)
        for j in range(int((stop - start).max())):
            on = np.flatnonzero(start + j < stop)
            out[on] = (out[on] ^ hashes[start[on] + j]) * MIX[j % 3]
            out[on] ^= out[on] >> np.uint64(29)
        first.append(start)
        last.append(stop - 1)
        mixed.append(out)
    if not first:
        return np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0, "i8"), np.zeros(0, "i8")
    both = np.concatenate(mixed)
    return np.concatenate(first).astype("i4"), np.concatenate(last).astype("i4"), both[:, 0].copy().view("i8"), both[:, 1].copy().view("i8")


def runs_of(df: DataFrame, id_col: str, text_col: str, two: int, three: int) -> DataFrame:
    """A row for each run: document, first and last sentence, hashes."""
    docs = keyed(df, id_col, text_col)
    kind = dict(docs.dtypes)["__id"]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [run_hashes(sentences(t), two, three) for t in part.column(2).to_pylist()]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), *(pa.array(np.concatenate(c)) for c in zip(*found, strict=True))], names=[*KEY, "__from", "__to", "__h", "__g"])

    return docs.mapInArrow(run, f"__id {kind}, __th long, __from int, __to int, __h long, __g long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", two: int = WORDS_OF_TWO, three: int = WORDS_OF_THREE) -> DataFrame:
    """All rows and columns of ``df``, the text without covered sentences, with ``__n_sentences`` and ``__n_removed``."""
    runs = runs_of(df, id_col, text_col, two, three)
    place = F.struct(*KEY, "__from", "__to")
    # a run may occur many times in one document, or in rows that repeat: equal places are one occurrence
    groups = runs.groupBy("__h", "__g").agg(F.min(place).alias("__first"), F.max(place).alias("__last"), F.count("*").alias("__n"))
    repeated = written(groups.where(F.col("__first") != F.col("__last")).select("__h", "__g", "__first", "__n"), "repeated-runs")
    hot = repeated.where(F.col("__n") > HOT).select("__h", "__g", F.lit(True).alias("__hot"))
    if n_hot := hot.count():  # a very common run's places go to many tasks
        runs = runs.join(F.broadcast(hot) if n_hot <= FEW_HOT else hot, ["__h", "__g"], "left")
        runs = runs.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*KEY, "__from"), F.lit(SALTS))).otherwise(0)).drop("__hot")
    else:
        runs = runs.withColumn("__salt", F.lit(0).cast("long"))
    salts = F.when(F.col("__n") > HOT, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    repeated = repeated.select("__h", "__g", "__first", F.explode(salts).alias("__salt"))
    again = runs.join(repeated, ["__h", "__g", "__salt"]).where(place != F.col("__first"))
    cuts = cut_positions(again.select(*KEY, "__from", "__to"))
    joined = with_cuts(df, cuts, id_col, text_col)
    names = list(df.columns)
    at = names.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", __n_sentences long, __n_removed long"

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                texts, n, gone = part.column(at).to_pylist(), [], []
                for i, (text, positions) in enumerate(zip(texts, part.column(len(names)).to_pylist(), strict=True)):
                    if positions:
                        parts, out = sentences(text), set(positions)
                        texts[i] = "".join([s for k, s in enumerate(parts) if k not in out])
                        n.append(len(parts))
                    else:
                        n.append(1 + sum(1 for _ in BOUNDARY.finditer(text or "")))
                    gone.append(len(positions))
                columns = list(part.columns)[: len(names)]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "__n_sentences", "__n_removed"])

    return joined.mapInArrow(cut, schema)


def span_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = remove_repeats(df.select(id_col, text_col), id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return out.select(id_col, F.col("__n_sentences").alias("n_sentences"), F.col("__n_removed").alias("n_removed"), (F.col("__n_removed") > 0).alias("has_repeat"), F.sha2(text, 256).alias("text_sha256"))

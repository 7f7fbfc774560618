"""SimHash near-dedup with pivot distance tables.

A text's fingerprint has a bit where over half of its shingles' hashes have it. Fingerprints that differ in
``max_bits`` bits or fewer are linked. Equal fingerprints meet by aggregation, so only different ones are compared.

The pivot table is written once: for each different fingerprint its Hamming distances to ``PIVOTS`` reference
fingerprints. Pairs meet in buckets: the 64 bits are cut into ``max_bits + r`` blocks, of which two linked fingerprints
must share at least ``r``, so each fingerprint goes to one bucket for each choice of ``r`` blocks (``r`` follows from
their number, so that buckets stay small). A pair that meets is discarded when any of its two rows of the pivot table
differ by more than ``max_bits`` in a coordinate, which the triangle inequality proves too far; survivors are verified by
their bits. The table alone could not bring pairs together: distances of 64-bit fingerprints to any reference lie
around 32 +- 4, so cells of ``max_bits`` part almost nothing. Of a bucket's links a spanning forest goes on: connectivity
is whole, rows stay linear. Buckets of more than about ``CHUNK`` fingerprints are dealt as pairs of chunks to many tasks, so no
bucket is ever one task's. Components come from :mod:`rankforge.llm.components`.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other;
repeated rows are kept, a row each; a null identifier never names a component unless it has no other (then the name is
null); an empty table gives an empty frame; other columns are ignored by :func:`near_duplicates` and passed on by
:func:`first_of_each`, whose columns may have any names. Texts are read whole, however long.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.components import components
from rankforge.llm.shared import slices, written

SHINGLE, SEED, MAX_BITS, PIVOTS, CHUNK = 4, 42, 4, 24, 8192
#: Keys of large buckets up to which these are broadcast (16 bytes each).
FEW_HOT = 10_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash (unsigned) of ASCII-lower-cased words between ASCII white space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    return int(majority(hashes)[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes (rows of 64-bit words) have, as words."""
    rows = hashes.reshape(len(hashes), -1)
    bits = np.zeros(64 * rows.shape[1], "i8")
    for at in range(0, len(rows), 8192):
        some = np.ascontiguousarray(rows[at : at + 8192]).view("u1")
        bits += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return np.packbits(2 * bits > len(rows), bitorder="little").view("<u8")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``__id, __th`` (hash of the text), ``__node`` (the fingerprint as a signed long) of every row."""
    src = rows_of(df, id_col, text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(t, shingle) for t in part.column(3).to_pylist()], "<u8")
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(found.view("<i8"))], names=["__id", "__th", "__row", "__node"])

    return src.mapInArrow(run, f"__id {dict(df.dtypes)[id_col]}, __th long, __row long, __node long")


def rows_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, hash of the text, hash of the whole row, text."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), text.alias("__text"))


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(n)], "<u8")


def pivot_table(distinct: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Different fingerprints (``__node``) as ``__w0`` with ``__d``: their distances to the references, a byte each."""
    reference = pivot_fingerprints(pivots)

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view("<u8")
            rows = np.bitwise_count(fps[:, None] ^ reference[None, :]).astype("u1")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["__node", "__w0", "__d"])

    return written(distinct.select("__node").mapInArrow(run, "__node long, __w0 long, __d binary"), "pivot-table")


def block_masks(max_bits: int, shared: int) -> list[tuple[int]]:
    """For each choice of ``shared`` of the ``max_bits + shared`` blocks, the mask of its bits."""
    n = max_bits + shared
    edges = [round(i * 64 / n) for i in range(n + 1)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(n)]
    return [(sum(masks[i] for i in chosen),) for chosen in combinations(range(n), shared)]


def shared_blocks(rows: int, max_bits: int) -> int:
    """The fewest shared blocks for which a bucket of evenly spread fingerprints holds about one."""
    for r in range(1, 9):
        if 64 * r / (max_bits + r) >= log2(max(2, rows)) + 2 or comb(max_bits + r + 1, r + 1) > 200:
            return max(2, r)
    return 8


def bucket_links(keys: np.ndarray, sides: np.ndarray, nodes: np.ndarray, prints: np.ndarray, max_bits: int, distances: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links inside each bucket, and how many pairs met, were discarded by their ``distances`` to
    the references, and were verified as links. ``prints``: rows of words. ``keys`` are sorted; rows of a bucket that stands for two
    chunks (``sides`` 0 and 1) are compared across; -1: with all others. Rows of one node are connected from the start, and pairs that are
    connected already don't meet. ``distances``: rows of references, and of parts of the fingerprint that a reference is compared with by
    itself; each part's largest difference is a lower bound of its bits, and parts have no bit in common, so the bounds add up."""
    order, tally = np.lexsort((nodes, keys)), np.zeros(3, "i8")
    fresh = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (nodes[order][1:] != nodes[order][:-1])][: len(keys)]
    root = np.empty(len(keys), "i8")
    root[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    alive = np.arange(len(keys) - 1)
    step = 1
    while len(alive):
        alive = alive[alive < len(keys) - step]
        alive = alive[keys[alive] == keys[alive + step]]
        first, second = alive, alive + step
        pairs = (root[first] != root[second]) & ((sides[first] < 0) | (sides[first] != sides[second]))
        first, second = first[pairs], second[pairs]
        tally[0] += len(first)
        if len(first) and distances is not None:
            near = np.abs(distances[first] - distances[second]).max(axis=1).sum(axis=1) <= max_bits
            tally[1] += len(first) - near.sum()
            first, second = first[near], second[near]
        if len(first):
            close = np.bitwise_count(prints[first] ^ prints[second]).sum(axis=1) <= max_bits
            first, second = first[close], second[close]
            tally[2] += len(first)
        while len(first):
            a, b = root[first], root[second]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low != high
            if not open_.any():
                break
            np.minimum.at(root, high[open_], low[open_])
            while True:
                above = root[root]
                if (above == root).all():
                    break
                root = above
        step += 1
    linked = np.flatnonzero(nodes != nodes[root])
    return list(zip(nodes[linked].tolist(), nodes[root[linked]].tolist(), strict=True)), tally


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fingerprint_links(distinct: DataFrame, masks: list[tuple[int, ...]], max_bits: int = MAX_BITS, chunk: int = CHUNK, tally=None, unpacked=None) -> DataFrame:
    """Edges ``u, v`` between different nodes that connect what links connect. ``distinct``: ``__node`` (fingerprints of one node are
    connected already), the fingerprint's words ``__w0, ...`` and, if there is a pivot table, ``__d``. Two nodes meet if they agree in the bits of one of ``masks`` (a mask a
    word). ``tally``: an accumulator a count of :func:`bucket_links`, for measurements. ``unpacked``: makes what :func:`bucket_links` takes of
    ``__d`` as rows of bytes (none: a byte a reference, compared with the whole fingerprint)."""
    words = [c for c in distinct.columns if c.startswith("__w")]
    listed = F.array(*[F.struct(F.lit(t).alias("t"), *[F.lit(_signed(m)).alias(f"m{i}") for i, m in enumerate(mask)]) for t, mask in enumerate(masks)])
    key = F.transform(listed, lambda m: F.xxhash64(m["t"], *[F.col(w).bitwiseAND(m[f"m{i}"]) for i, w in enumerate(words)]))
    keyed = distinct.select("*", F.explode(key).alias("k"))
    # how large buckets are is only asked to deal them out; one node of ``rate`` tells
    rate = max(1, chunk // 128)
    asked = keyed.where(F.pmod(F.xxhash64(*words, F.lit(1)), F.lit(rate)) == 0) if rate > 1 else keyed
    hot = written(asked.groupBy("k").agg((F.count("*") * rate).alias("n")).where(F.col("n") > chunk * 3 // 4), "hot-buckets")
    n_hot = hot.count()
    side = F.lit(-1).cast("byte").alias("side")
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= FEW_HOT else hot, "k", "left")
        parts = F.coalesce(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
        mine = F.pmod(F.xxhash64(*words), parts).cast("int")
        pair = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.when(parts == 1, F.col("k")).otherwise(F.xxhash64("k", F.least(o, mine), F.greatest(o, mine))).alias("k"), F.when(o == mine, -1).otherwise((mine > o).cast("int")).cast("byte").alias("side")))
        keyed = keyed.select(*distinct.columns, F.explode(pair).alias("p")).select(*distinct.columns, "p.k", "p.side")
    else:
        keyed = keyed.select("*", side)
    dealt = keyed.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")
    has_table, unpacked = "__d" in distinct.columns, unpacked or (lambda rows: rows[:, :, None].astype("i2"))

    def run(batches):
        names, rest = ["k", "side", "__node", *words], None
        for batch in _and_end(batches):
            if batch is not None:
                new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                if has_table:
                    new.append(np.frombuffer(b"".join(batch.column("__d").to_pylist()), "u1").reshape(batch.num_rows, -1))
                rest = new if rest is None else [np.concatenate(p) for p in zip(rest, new, strict=True)]
                if len(rest[0]) < 50_000:
                    continue
            if rest is None or not len(rest[0]):
                continue
            change = np.r_[False, rest[0][1:] != rest[0][:-1]]
            end = len(change) if batch is None else int(np.flatnonzero(change)[-1]) if change.any() else 0
            if not end:
                continue
            keys = np.cumsum(change[:end])
            same = keys[1:] == keys[:-1]
            grouped = np.zeros(end, bool)
            grouped[1:] |= same
            grouped[:-1] |= same
            at = np.flatnonzero(grouped)
            prints = np.stack([rest[3 + i][at].astype("<i8").view("<u8") for i in range(len(words))], axis=1)
            links, counts = bucket_links(keys[at], rest[1][at], rest[2][at], prints, max_bits, unpacked(rest[-1][at]) if has_table else None)
            for t, n in zip(tally or (), counts.tolist(), strict=False):
                t.add(n)
            rest = [column[end:] for column in rest]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def _and_end(batches):
    yield from batches
    yield None


def classes_of(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``__node, root, component_id`` of every different node of ``prints``; ``roots``: ``node, root`` of those that are linked."""
    distinct = prints.groupBy("__node").agg(F.min("__id").alias("__rep"))
    named = distinct.join(roots.withColumnRenamed("node", "__node"), "__node", "left").select("__node", F.coalesce("root", "__node").alias("root"), "__rep")
    least = named.groupBy("root").agg(F.min("__rep").alias("component_id"))
    return named.select("__node", "root").join(least, "root")


def _classes(df: DataFrame, id_col: str, text_col: str, max_bits: int, shingle: int, tally=None) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows and the classes of their fingerprints, both written."""
    prints = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    table = pivot_table(prints.select("__node").distinct())
    masks = block_masks(max_bits, shared_blocks(table.count(), max_bits))
    return prints, written(classes_of(prints, components(fingerprint_links(table, masks, max_bits, tally=tally))), "classes")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE, tally=None) -> DataFrame:
    """A row for every row: ``id_col, fingerprint`` (16 hex digits), ``component_id`` (least identifier reachable)."""
    prints, classes = _classes(df, id_col, text_col, max_bits, shingle, tally)
    out = prints.join(classes, "__node")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__node"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, prints: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df``, all columns, one of each class of ``classes`` (``__node, root``): the first by identifier (null last), hash of
    the text and hash of the whole row. Of rows that are alike in all columns any one stays."""
    place = F.struct(F.col("__id").isNull().alias("__none"), F.col("__id"), F.col("__th"), F.col("__row"))
    first = prints.join(classes.select("__node", "root"), "__node").groupBy("root").agg(F.min(place).alias("p"), F.count("*").alias("n"))
    first = written(first.select(F.col("p.__id").alias("__id"), F.col("p.__th").alias("__th"), F.col("p.__row").alias("__row"), "n"), "first-rows")
    marked = df.withColumns({"__df_th": F.xxhash64(F.col(text_col).cast("string")), "__df_row": F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])})
    same = F.col(f"`{id_col}`").eqNullSafe(first["__id"]) & (F.col("__df_th") == first["__th"]) & (F.col("__df_row") == first["__row"])
    kept = marked.join(first, same, "left_semi")
    chosen = prints.join(first.where("n > 1").select("__th", "__row"), ["__th", "__row"], "left_semi").groupBy("__id", "__th", "__row").count()
    if chosen.where("count > 1").limit(1).count():  # rows alike in all columns
        kept = kept.dropDuplicates([id_col, "__df_th", "__df_row"])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``df``, all columns, one of each component, as :func:`one_of_each` says."""
    prints, classes = _classes(df, id_col, text_col, max_bits, shingle)
    return one_of_each(df, prints, classes, id_col, text_col)

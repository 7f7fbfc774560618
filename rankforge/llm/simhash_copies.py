"""Near copies by SimHash candidates and exact similarity: :mod:`rankforge.llm.simhash_pivots` with wider links.

Two texts are linked when their sets of ``SHINGLE`` consecutive words are at least ``NEAR`` tenths alike (overlap over union); one
text of each connected group stays. Equal sets meet by a hash of the set. Such pairs differ in about 15 % of the bits of a SimHash
(19 of ``BITS``, with a spread of 4), so links of ``MAX_BITS`` bits are looked for. Blocks that all such pairs must share don't exist at
that width, so fingerprints meet in buckets of random choices of bits: as many
choices as leave a pair at the limit of similarity out with a probability of ``MISSED``, for fingerprints with the expected number
of different bits (some 0.3 % of pairs exactly at the limit, whose bits happen to differ more, are missed; more alike pairs practically
never). The pivot table, written once, discards there: it holds each fingerprint's Hamming distances to the references ``PIVOTS``, taken
byte by byte, as distances of whole fingerprints lie too close together to tell anything at ``MAX_BITS``. By the triangle inequality two
bytes differ in at least as many bits as their distances to any reference differ, and the bounds of the bytes add up; a pair whose bounds come
to more than ``MAX_BITS`` is proved too far, and only the rest are verified by their bits. What is connected so is a family. Its sets are compared exactly; no candidate is taken unverified. Families of more than ``FAMILY``
sets are dealt as pairs of parts to many tasks.

Defined cases: words are as in :mod:`rankforge.llm.simhash_pivots` (ASCII lower case, ASCII white space); a text of fewer words
is one shingle; null and empty texts are copies of each other; rows that stay are chosen as ``simhash_pivots.one_of_each`` says, so null, equal
and repeated identifiers lose no text; an empty table gives an empty frame; columns may have any names. Shingles are told apart by 64 bits of
hash. Texts are read whole; what a task holds of them are 8 bytes a shingle.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.components import components
from rankforge.llm.shared import released, slices, written
from rankforge.llm.simhash_pivots import classes_of, fingerprint_links, majority, one_of_each, rows_of

SHINGLE, NEAR, BITS, MAX_BITS, MISSED, FAMILY, FIRST = 5, 8, 128, 36, 1e-5, 2000, 12
#: References of a byte, each at 4 bits from the others: between them they tell more of a byte than random ones.
PIVOTS = np.array([0xFF, 0x55, 0x33, 0x0F], "u1")
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Members of families up to which their keys and identifiers are broadcast (some tens of bytes each).
FEW = 300_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted, different hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    digest = xxhash.xxh3_64_intdigest
    known = {w: digest(w) for w in set(words)}
    hashes = np.fromiter((known[w] for w in words), "u8", len(words))
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), "u8")
    for j in range(min(size, len(words))):
        out = mixed(out ^ hashes[j : j + n])
    return np.unique(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * MIX
    return x ^ x >> np.uint64(29)


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def wide_print(found: np.ndarray) -> np.ndarray:
    """The SimHash of ``BITS`` bits of a set of hashes, as words."""
    columns, now = [], found
    for _ in range(BITS // 64):
        now = mixed(now + np.uint64(0xD1B54A32D192ED03))
        columns.append(mixed(now ^ now >> np.uint64(32)))
    return majority(np.stack(columns, axis=1)) if len(found) else np.zeros(BITS // 64, "<u8")


def packed_distances(prints: np.ndarray) -> np.ndarray:
    """Rows of the pivot table of fingerprints (rows of words): two distances (0 to 8) a byte."""
    found = np.bitwise_count(np.ascontiguousarray(prints).view("u1")[:, None, :] ^ PIVOTS[None, :, None])
    return (found[:, : len(PIVOTS) // 2] | found[:, len(PIVOTS) // 2 :] << 4).reshape(len(prints), -1)


def unpacked_distances(rows: np.ndarray) -> np.ndarray:
    """Row, reference, byte of the fingerprint -> distance."""
    two = rows.reshape(len(rows), len(PIVOTS) // 2, BITS // 8)
    return np.concatenate([two & 15, two >> 4], axis=1).view("i1")


def pivot_table(distinct: DataFrame) -> DataFrame:
    """Different sets (``__node``) with their fingerprints' words and ``__d``: the distances to the references."""
    words = [f"__w{i}" for i in range(BITS // 64)]

    def run(batches):
        for batch in batches:
            prints = np.stack([batch.column(w).to_numpy(zero_copy_only=False).astype("<i8").view("<u8") for w in words], axis=1)
            rows = pa.array([r.tobytes() for r in packed_distances(prints)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=["__node", *words, "__d"])

    return written(distinct.select("__node", *words).mapInArrow(run, "__node long, " + ", ".join(f"{w} long" for w in words) + ", __d binary"), "pivot-table")


def bit_choices(rows: int, near: float = NEAR / 10, missed: float = MISSED) -> list[tuple[int, ...]]:
    """Masks of random bits. A bucket of evenly spread fingerprints holds about sixteen; a pair that is ``near`` alike shares no
    bucket with a probability of ``missed``."""
    bits = max(8, ceil(log2(max(2, rows))) - 4)
    alike = 1 - acos(2 * near / (1 + near)) / pi
    rng, out = np.random.default_rng(42), []
    for _ in range(ceil(log(1 / missed) / alike**bits)):
        chosen = sum(1 << int(b) for b in rng.choice(BITS, min(bits, BITS), replace=False))
        out.append(tuple(chosen >> 64 * i & (1 << 64) - 1 for i in range(BITS // 64)))
    return out


def linked(sets: list[np.ndarray], near: int = NEAR) -> np.ndarray:
    """For each set the first one of its group, by exact similarities."""
    sizes = np.fromiter(map(len, sets), "i8", len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    owners, (_, start, count) = owner[order], np.unique(flat[order], return_index=True, return_counts=True)
    place = np.empty(len(flat), "i8")
    place[order] = np.repeat(np.arange(len(start)), count)
    ends, root = np.cumsum(sizes), np.arange(len(sets))
    for i in range(len(sets)):
        mine = place[ends[i] - sizes[i] : ends[i]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        # a text is at most once among a shingle's owners
        many = count[mine]
        at = np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.bincount(owners[at], minlength=len(sets))
        like = np.flatnonzero(10 * both >= near * (sizes + sizes[i] - both))
        roots = np.unique(root[like])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]
    return root


def _printed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = [f"__w{i}" for i in range(BITS // 64)]

    def run(batches):
        released()
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column(3).to_pylist()]
                prints = np.stack([wide_print(s) for s in sets]).view("<i8")
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([set_key(s) for s in sets], pa.int64()), *(pa.array(c) for c in prints.T.copy()), pa.array([len(s) > 0 for s in sets])], names=["__id", "__th", "__row", "__node", *words, "__some"])

    schema = f"__id {dict(df.dtypes)[id_col]}, __th long, __row long, __node long, " + ", ".join(f"{w} long" for w in words) + ", __some boolean"
    return written(rows_of(df, id_col, text_col).mapInArrow(run, schema), "shingle-prints")


def _verified(df: DataFrame, prints: DataFrame, families: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, root`` of the similar sets of each family (``families``: ``node, root``)."""
    spark = df.sparkSession
    roots = families.select("root").distinct().select(F.col("root").alias("node"), "root")
    members = families.unionByName(roots).withColumnRenamed("node", "__node")
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("parts"))
    one = prints.where("__some").groupBy("__node").agg(F.min(F.struct("__id", "__th", "__row")).alias("__rep"))
    members = written(members.join(sizes, "root").join(one, "__node").select("__node", "root", "parts", "__rep.__id", "__rep.__th", "__rep.__row"), "families")
    sent = (lambda d: F.broadcast(d)) if members.count() <= FEW else (lambda d: d)
    # one row a member, but for rows that are alike in all columns
    texts = rows_of(df, id_col, text_col)
    wanted = sent(members.select("__node", "root", "parts", F.col("__id").alias("__mid"), F.col("__th").alias("__mth"), F.col("__row").alias("__mrow")))
    texts = texts.join(wanted, F.col("__id").eqNullSafe(F.col("__mid")) & (F.col("__th") == F.col("__mth")) & (F.col("__row") == F.col("__mrow")))

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([s.tobytes() for s in found], pa.binary())], names=["__node", "root", "parts", "__set"])

    held = texts.select("__node", "root", "parts", "__text").mapInArrow(sets, "__node long, root long, parts int, __set binary")
    mine = F.pmod(F.xxhash64("__node"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("root", F.least(o, mine), F.greatest(o, mine)))
    # a part alone is compared in the first pair that it is in
    pair = F.when(F.col("parts") == 1, F.array("root")).otherwise(F.filter(pair, lambda k: k != F.xxhash64("root", mine, mine)))
    dealt = held.select("__node", "__set", F.explode(pair).alias("k")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "__node")

    def run(batches):
        key, nodes, some = None, [], []

        def done():
            first = linked(some)
            at = np.flatnonzero(first != np.arange(len(first)))
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at.tolist()], pa.int64()), pa.array([nodes[i] for i in first[at].tolist()], pa.int64())], names=["u", "v"])

        for batch in batches:
            for k, n, s in zip(*(batch.column(c).to_pylist() for c in ("k", "__node", "__set")), strict=True):
                if k != key and nodes:
                    yield done()
                    nodes, some = [], []
                key = k
                if not nodes or nodes[-1] != n:  # rows that repeat are next to each other
                    nodes.append(n)
                    some.append(np.frombuffer(s, "u8"))
        if nodes:
            yield done()

    edges = dealt.mapInArrow(run, "u long, v long")
    if members.where("parts > 1").limit(1).count():  # links of a large family come from several tasks
        return components(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(df: DataFrame, id_col: str, text_col: str, tally=None) -> tuple[DataFrame, DataFrame]:
    prints = _printed(df, id_col, text_col)
    words = [f"__w{i}" for i in range(BITS // 64)]
    distinct = pivot_table(prints.where("__some").groupBy("__node").agg(*[F.first(w).alias(w) for w in words]))
    links = lambda table, masks: fingerprint_links(table, masks, MAX_BITS, tally=tally, unpacked=unpacked_distances)
    masks = bit_choices(distinct.count())
    # a few choices connect most copies; the others look for links between what is not connected yet, so edges stay few
    first = components(links(distinct, masks[:FIRST]))
    known = written(distinct.join(first.withColumnRenamed("node", "__node"), "__node", "left").withColumn("root", F.coalesce("root", "__node")), "known")
    more = components(links(known.select(F.col("root").alias("__node"), *words, "__d"), masks[FIRST:]))
    whole = known.select(F.col("__node").alias("node"), F.col("root").alias("was")).join(more.withColumnRenamed("node", "was"), "was", "left")
    families = written(whole.select("node", F.coalesce("root", "was").alias("root")).where("node <> root"), "near-families")
    return prints, written(classes_of(prints, _verified(df, prints, families, id_col, text_col)), "classes")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tally=None) -> DataFrame:
    """A row for every row: ``id_col, component_id`` (least identifier of its group). ``tally``: as in :func:`fingerprint_links`."""
    prints, classes = _classes(df, id_col, text_col, tally)
    return prints.select("__id", "__node").join(classes, "__node").select(F.col("__id").alias(id_col), "component_id")


def first_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, one of each group of near copies."""
    prints, classes = _classes(df, id_col, text_col)
    return one_of_each(df, prints, classes, id_col, text_col)

"""Token-id output as sorted-string-table shards.

Documents are range-partitioned by identifier; each partition writes one shard in ascending order. A shard holds
prefix-compressed data blocks (restart points inside), a sparse index with the first key of each block, a Bloom filter
over all keys and a footer. :class:`Table` reads one: ``get`` consults the filter, bisects the index and then the
restart points; ``scan`` goes through all blocks in order.

    block   := zstd(entry* restart_offset:u32* n_restarts:u32)
    entry   := shared:varint unshared:varint value_length:varint key_suffix value
    value   := the ids, as little-endian unsigned 16- or 32-bit numbers (the footer says which)
    shard   := MAGIC block* index bloom footer

Keys are a 0 byte for a null identifier, else a 1 byte and the identifier (integers: 8 bytes, big-endian, sign bit
flipped), so bytes sort as identifiers do, nulls first. Defined cases: a null or empty text has only the end id;
repeated identifiers are all kept, in order of their texts (null first); an empty table makes no shard and an empty result;
further columns are ignored. Texts are encoded whole, however long; a document is one entry of one block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import ChunkCoder, filesystem, new_folder, put_file, slices, worker_threads_off, written

MAGIC, FOOTER = b"RFSST01\n", struct.Struct("<6qI8s")
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
#: Chunks a worker remembers: bounds memory.
REMEMBERED = 1_400_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_of(identifier: int | str | None) -> bytes:
    if identifier is None:
        return b"\x00"
    return b"\x01" + (struct.pack(">Q", identifier + (1 << 63)) if isinstance(identifier, int) else identifier.encode("utf-8"))


def identifier_of(key: bytes, kind: str) -> int | str | None:
    if key == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if kind != "string" else key[1:].decode("utf-8")


def bloom_positions(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


def table_parts(rows: Iterator[tuple[bytes, bytes]], width: int) -> Iterator[bytes]:
    """The parts of a shard file of sorted (key, value) rows; one block is held at a time."""
    pack = zstandard.ZstdCompressor(level=1).compress
    yield MAGIC
    at, index, hashes = len(MAGIC), [], []
    block, restarts, n, last, first = bytearray(), [], 0, b"", b""

    def closed() -> bytes:
        return pack(bytes(block) + struct.pack(f"<{len(restarts)}I", *restarts) + struct.pack("<I", len(restarts)))

    for key, value in rows:
        if block and len(block) + len(value) > BLOCK_BYTES:
            data = closed()
            index.append((first, at, len(data)))
            at += len(data)
            yield data
            block, restarts, n = bytearray(), [], 0
        if n % RESTART == 0:
            restarts.append(len(block))
            shared = 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(last, key, strict=False)) if x != y), min(len(last), len(key)))
        first = key if not n else first
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        hashes.append(key)
        last, n = key, n + 1
    if n:
        data = closed()
        index.append((first, at, len(data)))
        at += len(data)
        yield data
    listed = b"".join(_varint(len(k)) + k + _varint(a) + _varint(size) for k, a, size in index)
    bits = max(64, BLOOM_BITS * len(hashes))
    bloom = bytearray((bits + 7) // 8)
    for key in hashes:
        for p in bloom_positions(key, bits):
            bloom[p >> 3] |= 1 << (p & 7)
    filtered = bytes(bloom)
    yield listed
    yield filtered
    yield FOOTER.pack(at, len(listed), at + len(listed), bits, len(hashes), width, zlib.crc32(listed + filtered), MAGIC)


class Table:
    """A shard, read through a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        at, listed, bloom_at, self.bits, self.rows, self.width, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        index, bloom = self._read(at, listed), self._read(bloom_at, (self.bits + 7) // 8)
        if zlib.crc32(index + bloom) != crc:
            raise ValueError("damaged index")
        self.bloom, self.blocks, at = bloom, [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            where, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            self.blocks.append((key, where, length))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, n: int) -> tuple[bytes, list[int], int]:
        data = self.unpack(self._read(*self.blocks[n][1:]))
        count = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 - 4 * count
        return data, list(struct.unpack_from(f"<{count}I", data, end)), end

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.blocks)):
            data, _, end = self._block(n)
            yield from self._entries(data, 0, end)

    def get(self, identifier: int | str | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier; [] if there is none."""
        key = key_of(identifier)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_positions(key, self.bits)):
            return []
        out = []
        for n in range(max(0, bisect.bisect_left(self.blocks, key, key=lambda b: b[0]) - 1), len(self.blocks)):
            if self.blocks[n][0] > key:
                break
            data, restarts, end = self._block(n)
            low = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, at, end))[0])
            for k, value in self._entries(data, restarts[max(0, low - 1)], end):
                if k > key:
                    break
                if k == key:
                    out.append(np.frombuffer(value, f"<u{self.width}"))
        return out


_CODERS: dict[str, ChunkCoder] = {}


def library_coder(tokenizer: str) -> ChunkCoder:
    """A worker's coder that has the tokenizers library encode what is not remembered."""
    if tokenizer not in _CODERS:
        worker_threads_off()
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.no_truncation()
        tok.no_padding()
        ids = lambda *texts: [i for t in texts for i in tok.encode(t, add_special_tokens=False).ids]
        if ids("Ab, cD\nEf.") != ids("ab", ",", "cd", "ef", "."):
            raise ValueError("this vocabulary does not lower-case and cut at blanks and signs")
        _CODERS.clear()
        _CODERS[tokenizer] = ChunkCoder(lambda chunks: [e.ids for e in tok.encode_batch_fast(chunks, add_special_tokens=False)], tok.get_vocab_size(with_added_tokens=True), REMEMBERED)
    return _CODERS[tokenizer]


def write_tables(df: DataFrame, tokenizer: str, end_id: int | None, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text and write shards into ``folder``; returns the manifest (written, read again):
    ``shard, file, docs, tokens, bytes``, shards in ascending order of identifiers."""
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    ends = [] if end_id is None else [end_id]

    def run(batches):
        coder, shard = library_coder(tokenizer), TaskContext.get().partitionId()
        width, seen = int(coder.kind[-1]), [0, 0]
        closing = np.asarray(ends, coder.kind).tobytes()

        def rows():
            for batch in batches:
                for part in slices(batch):
                    for identifier, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist()), strict=True):
                        seen[0] += 1
                        seen[1] += len(ids) + len(ends)
                        yield key_of(identifier), ids.tobytes() + closing

        name, it = f"shard-{shard:06d}.sst", rows()
        head = next(it, None)
        if head is not None:
            size = put_file(folder, name, table_parts((r for r in _chain(head, it)), width))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "docs": pa.array([seen[0]], pa.int64()), "tokens": pa.array([seen[1]], pa.int64()), "bytes": pa.array([size], pa.int64())})

    ranged = src.repartitionByRange(n, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), F.col("__text").asc_nulls_first())
    return written(ranged.mapInArrow(run, "shard int, file string, docs long, tokens long, bytes long"), "sst-manifest")


def _chain(head, rest):
    yield head
    yield from rest


def read_tables(manifest: DataFrame, folder: str, kind: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Every document of the shards: its identifier, where its ids start among all, how many there are and their
    checksum (``with_ids``: the ids too). The driver sees a row a shard, whose number is the writer's partitions."""
    spark = manifest.sparkSession
    shards = sorted(manifest.select("shard", "file", "tokens").collect())
    starts = np.cumsum([0, *(s["tokens"] for s in shards)]).tolist()
    jobs = spark.createDataFrame([(s["file"], at) for s, at in zip(shards, starts, strict=False)], "file string, at long").repartition(max(1, len(shards)))

    def run(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for name, at in zip(*batch.to_pydict().values(), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    table, out = Table(file), []
                    for key, value in table.scan():
                        ids = np.frombuffer(value, f"<u{table.width}").astype("<u4")
                        out.append((identifier_of(key, kind), at, len(ids), zlib.crc32(ids.tobytes()), ids.astype("<i8") if with_ids else None))
                        at += len(ids)
                        if len(out) >= (SLICE_IDS if with_ids else 4096):
                            yield packed(out)
                            out = []
                    if out:
                        yield packed(out)

    def packed(rows):
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], pa.string() if kind == "string" else pa.int64()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
        names = [id_col, "start", "n_tokens", "ids_crc32"]
        if with_ids:
            arrays, names = [*arrays, pa.array(columns[4], pa.list_(pa.int64()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id_col}` {'string' if kind == 'string' else 'long'}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return jobs.mapInArrow(run, schema)


SLICE_IDS = 32


def token_tables(df: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write shards and read them back."""
    folder = folder or new_folder(df.sparkSession, "sst")
    kind = dict(df.dtypes)[id_col]
    return read_tables(write_tables(df, tokenizer, end_id, folder, id_col, text_col), folder, kind, id_col, with_ids)

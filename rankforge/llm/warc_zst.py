"""WARC archives compressed record by record with a Zstandard dictionary.

A dictionary is trained from archived records (a bounded sample: at most ``SAMPLE_ROWS`` identifiers, the first by hash, ``SAMPLE_BYTES`` of
each; it changes sizes, never contents). Each archive starts with the dictionary in a skippable frame (magic number
0x184D2A5D, little-endian length, dictionary); every record is a frame of its own, so a record can be read from its
offset with the dictionary alone. Of records with equal payloads of ``revisit_from`` bytes or more, that with the largest identifier is a
``response``; the others are ``revisit`` records, without payload, that refer to it.

Defined cases: a null payload counts as empty; a null identifier sorts before all others and is written as ``null``; every
row that holds the largest identifier of its payload is a response; repeated rows are kept; an empty table writes no archive; a
null address is written empty; line ends inside addresses become blanks; further columns are ignored. Payloads are told
apart by SHA-256 and length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import filesystem, new_folder, put_file, slices, written

MAGIC = 0x184D2A5D
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 400, 8 << 10, 64 << 10, 3
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes handed on at once.
FLUSH = 1 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(identifier) -> str:
    """An identifier as a name on one line; texts are percent-coded, so that none looks like the null identifier's."""
    return "<urn:page:null>" if identifier is None else f"<urn:page:{identifier}>" if isinstance(identifier, int) else f"<urn:page:s:{quote(identifier)}>"


def identifier_of(name: str | None):
    inner = None if name is None else name[10:-1]
    return None if inner in (None, "null") else unquote(inner[2:]) if inner.startswith("s:") else int(inner)


def record(identifier, address: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record. ``X-Payload-Length`` keeps a revisit's payload length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(identifier)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((address or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return headers, rest[:size]


def trained_dictionary(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> bytes:
    """A dictionary from records of the table; empty if there is too little to learn from."""
    # identifiers first: what the driver is sent is a few bytes a row, not texts
    order = F.xxhash64(F.col(id_col))
    chosen = df.select(order.alias("o"), F.col(id_col).alias("s")).where(F.col(id_col).isNotNull()).distinct().orderBy("o", "s").limit(SAMPLE_ROWS)
    payload = F.substring(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), 1, SAMPLE_BYTES)
    sampled = df.join(F.broadcast(chosen), F.col(id_col) == F.col("s"))
    sampled = sampled.groupBy("s").agg(F.min(F.struct(F.col(url_col).cast("string").alias("u"), payload.alias("p"))).alias("x"))
    rows = sampled.select(F.col("s").alias("i"), "x.u", "x.p").orderBy("i").collect()
    samples = [record(r["i"], r["u"], r["p"].encode()) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def archive_parts(records: Iterator[bytes], dictionary: bytes, level: int = LEVEL) -> Iterator[bytes]:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True).compress
    yield struct.pack("<II", MAGIC, len(dictionary)) + dictionary
    held, size = [], 0
    for data in records:
        held.append(pack(data))
        size += len(held[-1])
        if size >= FLUSH:
            yield b"".join(held)
            held, size = [], 0
    yield b"".join(held)


def archive_records(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, read as a stream: the leading frame's dictionary, then frame after frame."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    dictionary = file.read(size)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    unpack = zstandard.ZstdDecompressor(dict_data=known)
    data, one, out = b"", unpack.decompressobj(), []
    while True:
        if not data:
            data = file.read(chunk)
            if not data:
                break
        out.append(one.decompress(data))
        data = b""
        if one.eof:
            yield b"".join(out)
            data, one, out = one.unused_data, unpack.decompressobj(), []
    if any(out):
        raise ValueError("cut-off archive")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write one archive a partition; returns the manifest (written, read again): ``file, records, bytes``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload"))
    marked = src.withColumns({"__sha": F.unhex(F.sha2("__payload", 256)), "__size": F.octet_length("__payload")})
    groups = marked.where(F.col("__size") >= revisit_from).groupBy("__sha", "__size").agg(F.max("__id").alias("__head"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1").select("__sha", "__size", "__head"), "payloads")
    joined = marked.join(groups, ["__sha", "__size"], "left").select("__id", "__url", "__payload", "__head")
    dictionary = df.sparkSession.sparkContext.broadcast(trained_dictionary(df, id_col, url_col, payload_col))

    def run(batches):
        part, seen = TaskContext.get().partitionId(), [0]

        def records():
            for batch in batches:
                for some in slices(batch):
                    for identifier, address, text, head in zip(*(c.to_pylist() for c in some.columns), strict=True):
                        seen[0] += 1
                        yield record(identifier, address, text.encode("utf-8"), head, head is not None and identifier != head)

        rows = records()
        first = next(rows, None)
        if first is not None:
            name = f"pages-{part:06d}.warc.zst"
            size = put_file(folder, name, archive_parts(_chain(first, rows), dictionary.value))
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([seen[0]], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return written(joined.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


def _chain(head, rest):
    yield head
    yield from rest


def read_archives(manifest: DataFrame, folder: str, kind: str = "bigint", id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """A row for each archived record. A response's digest is taken from its body again and must equal its header."""
    files = manifest.select("file").repartition(max(1, manifest.count()), "file")
    whole = kind != "string"

    def run(batches):
        store, path = filesystem(folder)
        for batch in batches:
            for file_name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{path}/{file_name}", compression=None) as file:
                    out, size = [], 0
                    for data in archive_records(file):
                        head, body = parsed(data)
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = head["WARC-Type"] == "revisit"
                        if not revisit and (digest_of(body) != said or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError("payload differs from its digest")
                        out.append((identifier_of(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), said, head["WARC-Type"], identifier_of(head.get("WARC-Refers-To")), body.decode() if with_payload and not revisit else None))
                        size += len(body) if with_payload else 0
                        if len(out) >= 4096 or size > FLUSH:
                            yield packed(out)
                            out, size = [], 0
                    if out:
                        yield packed(out)

    def packed(rows):
        c = list(zip(*rows, strict=True))
        ids = pa.int64() if whole else pa.string()
        arrays = [pa.array(c[0], ids), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3]), pa.array(c[4], ids)]
        names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
        if with_payload:
            arrays, names = [*arrays, pa.array(c[5], pa.string())], [*names, "payload"]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    own = "long" if whole else "string"
    return files.mapInArrow(run, f"`{id_col}` {own}, payload_bytes long, payload_digest string, record_type string, refers_to {own}" + (", payload string" if with_payload else ""))


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write archives and read them back."""
    folder = folder or new_folder(df.sparkSession, "warc")
    manifest = write_archives(df, folder, id_col, url_col, payload_col, revisit_from)
    return read_archives(manifest, folder, dict(df.dtypes)[id_col], id_col, with_payload)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d
"""

"""Text expressions: tokens, white space, hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Python's ``\s`` (fixed value; Java's class differs).
WS = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NWS = WS.replace("[", "[^", 1)
TOKEN = "[A-Za-z0-9_]+"
BUCKETS = 384


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def normalize(text: Column) -> Column:
    """White space collapsed to single blanks, ends stripped."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def tokenize(text: Column) -> Column:
    """ASCII word tokens, extracted first and lower-cased then."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def truncate(text: Column, limit: int) -> Column:
    """Normalised text; if longer than ``limit``, cut to ``limit - 3`` with ``...`` behind."""
    flat = normalize(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def stable_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def chunk_id(doc_id: Column, index: Column, start: Column, end: Column, text: Column) -> Column:
    mark = F.concat_ws(":", start.cast("string"), end.cast("string"), text)
    return F.format_string("%s::chunk::%04d::%s", doc_id.cast("string"), index.cast("int"), stable_hash(mark, 10))


def estimate_tokens(text: Column) -> Column:
    """At least one; else 1.3 for each white-space word, whole."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3)).cast("long")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])" + WS + "+")


def hashed_bucket(token: Column) -> tuple[Column, Column]:
    """Bucket and sign of a token: its SHA-256's first 16 hex digits as d, d mod 384 and the parity of d / 384."""
    digest = F.sha2(token, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    m = ((high % 768) * 256 + low) % 768  # 2 ** 32 is 256 modulo 768
    return (m % BUCKETS).cast("int"), F.when(m < BUCKETS, 1).otherwise(-1)

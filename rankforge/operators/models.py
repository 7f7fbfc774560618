"""Text generators and embedders behind one interface each, called in Arrow batches on the executors.

A generator turns prompts into replies, an embedder texts into vectors. Those here that need no network: :func:`offline_generator`. The others
speak the common chat-completion and embedding HTTP formats; a wrong address or reply raises, so that a lost call is retried with its task."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts sent in one embedding request.
EMBED_BATCH = 96


@dataclass(frozen=True)
class Generator:
    """``call`` maps a list of prompts to ``(reply, prompt tokens, reply tokens)`` each; ``name`` is the key of the price table."""

    name: str
    call: Callable[[list[str]], list[tuple[str, int, int]]]


@dataclass(frozen=True)
class Embedder:
    """``call`` maps at most :data:`EMBED_BATCH` texts to their vectors; they are scaled to length one afterwards."""

    name: str
    call: Callable[[list[str]], list[list[float]]]


def words(text: str) -> int:
    """The token estimate of :func:`rankforge.functions.text.estimate_tokens`."""
    return max(1, len(text.split()) * 13 // 10)


def offline_generator() -> Generator:
    """Replies with a constant JSON object that names nothing: callers fall back to their heuristics."""
    reply = json.dumps({"score": 3, "reasoning": "offline"})
    return Generator("offline", lambda prompts: [(reply, words(p), words(reply)) for p in prompts])


def _post(url: str, key_env: str, body: dict) -> dict:
    headers = {"Content-Type": "application/json"}
    if os.environ.get(key_env):
        headers["Authorization"] = f"Bearer {os.environ[key_env]}"
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=120) as got:
        return json.load(got)


def chat_generator(name: str, url: str, key_env: str = "MODEL_API_KEY", system: str = "", json_mode: bool = False) -> Generator:
    """A chat-completion endpoint; token counts are those it reports, else estimates."""

    def one(prompt: str) -> tuple[str, int, int]:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        got = _post(url, key_env, {"model": name, "messages": messages, "temperature": 0} | ({"response_format": {"type": "json_object"}} if json_mode else {}))
        reply, usage = got["choices"][0]["message"]["content"] or "", got.get("usage") or {}
        return reply, usage.get("prompt_tokens", words(prompt)), usage.get("completion_tokens", words(reply))

    return Generator(name, lambda prompts: [one(p) for p in prompts])


def http_embedder(name: str, url: str, key_env: str = "MODEL_API_KEY") -> Embedder:
    """An embedding endpoint."""
    return Embedder(name, lambda texts: [row["embedding"] for row in sorted(_post(url, key_env, {"model": name, "input": texts})["data"], key=lambda r: r["index"])])


def generate(frame: DataFrame, model: Generator) -> DataFrame:
    """``frame`` (with ``prompt``; null: empty) and ``reply, tokens_in, tokens_out``; ``prompt`` goes."""
    kinds = [(c, t) for c, t in frame.dtypes if c != "prompt"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds), "reply string, tokens_in long, tokens_out long"])

    def run(batches):
        for batch in batches:
            said = model.call([p or "" for p in batch.column("prompt").to_pylist()])
            own = [pa.array(c, t) for c, t in zip(zip(*said) if said else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c, _ in kinds), *own], names=[*(c for c, _ in kinds), "reply", "tokens_in", "tokens_out"])

    return frame.mapInArrow(run, schema)


def embed(frame: DataFrame, model: Embedder, text_col: str = "text") -> DataFrame:
    """``frame`` and ``embedding``, of length one (a vector of zeros stays so); null texts are empty ones."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in frame.dtypes), "embedding array<double>"])

    def run(batches):
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(at, EMBED_BATCH)
                got = np.array(model.call([t or "" for t in part.column(text_col).to_pylist()]), "f8")
                got = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got.tolist(), pa.list_(pa.float64()))], names=[*part.schema.names, "embedding"])

    return frame.mapInArrow(run, schema)


def kept(frame: DataFrame) -> DataFrame:
    """Replies are paid for: they go to spark.checkpoint.dir if the session names one, so that a lost executor asks nobody again."""
    if frame.sparkSession.conf.get("spark.checkpoint.dir", None) or frame.sparkSession.sparkContext.getCheckpointDir():
        return frame.checkpoint()
    return frame.persist(StorageLevel.MEMORY_AND_DISK).withColumn("reply", F.col("reply"))

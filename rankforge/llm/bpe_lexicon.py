"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The frequent words of the corpus are compiled, with their token ids as outputs, into a shared-suffix automaton (a
minimal acyclic transducer that numbers its words; the number leads to the ids). The file is shipped to every
executor with ``addFile`` and memory-mapped there. Words that the automaton does not hold are merged exactly by rank. Texts are
parted into words by our own expression where they hold characters of ``PLAIN`` alone, on whose classes all Unicode versions agree, else
by the tokenizers library's own steps (it follows another Unicode version than ours).

Defined cases: a null text counts as the empty text (no ids, empty decoded text); repeated rows and repeated or null
identifiers are kept, a row each; an empty table gives an empty frame; further columns are ignored. Texts are encoded whole, however long.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import struct
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import SLICE, ChunkCoder, frequent_chunks, kept, lower_chunks, new_folder, put_file, slices, worker_threads_off

#: Unicode White_Space.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: ASCII, Latin, Greek, Cyrillic, general punctuation, kana, Chinese and Korean characters of the first Unicode versions.
PLAIN = regex.compile("[\x00-\u0377\u0384-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u2052\u20a0-\u20af\u2190-\u21ff\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Words in the lexicon, and chunks and words that a worker remembers: bounds of memory, not of results.
LEXICON_WORDS, REMEMBERED = 50_000, 1_200_000
MAGIC = b"RFLEX01\n"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class WordBpe:
    """Exact word-end BPE of a tokenizer file (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: n for n, p in reversed([*enumerate(pairs)])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        self.names: list[str] = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = t
        self.digits = [str(i) for i in range(len(self.names))]
        worker_threads_off()
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._normalized, self._parted = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._bytes = {c: b for b, c in self.alphabet.items()}
        self._special = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None

    def merged(self, word: str) -> list[int]:
        """Token ids of one pre-token: the lowest-ranked, leftmost pair is merged until none is left."""
        parts = [self.alphabet[b] for b in word.encode("utf-8")]
        if not parts:
            return []
        parts[-1] += self.suffix
        rank, none = self.ranks.get, 1 << 30
        order = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while order:
            best = min(order)
            if best == none:
                break
            at = order.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), none)
        return [self.vocab[p] for p in parts]

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk, special tokens as ids."""
        if "<" not in chunk or not self._special:
            return self.words(chunk)
        out: list[str | int] = []
        at = 0
        for m in self._special.finditer(chunk):
            out += [*self.words(chunk[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.words(chunk[at:])

    def words(self, text: str) -> list[str]:
        if not PLAIN.fullmatch(text):
            return [bytes([self._bytes[c] for c in piece]).decode("utf-8") for piece, _ in self._parted(self._normalized(text))]
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return WORDS.findall(text)

    def decode(self, ids: list[int]) -> str:
        names = self.names
        return " ".join([names[i] for i in ids])


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


# -- the transducer ------------------------------------------------------------------------------------------------


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The file of a minimal acyclic transducer from words to ids.

    Words are added in byte order; the part of the last word's path that no later word can share is replaced by
    equal registered states, so common suffixes are stored once. Arcs carry how many words come before those behind
    them; their sum along a path numbers the word, and the number leads to its ids.
    """
    words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
    finals, arcs = [False], [{}]  # state -> final, {label: target}
    register: dict[tuple, int] = {}

    def settle(path: list[int], labels: bytes, down_to: int) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            state = path[depth]
            key = (finals[state], tuple(arcs[state].items()))
            arcs[path[depth - 1]][labels[depth - 1]] = register.setdefault(key, state)

    path, last = [0], b""
    for word, _ in words:
        common = len(os.path.commonprefix([last, word]))
        settle(path, last, common)
        del path[common + 1 :]
        for label in word[common:]:
            finals.append(False)
            arcs.append({})
            arcs[path[-1]][label] = len(arcs) - 1
            path.append(len(arcs) - 1)
        finals[path[-1]] = True
        last = word
    settle(path, last, 0)

    order, seen, todo = [], {0: 0}, [0]
    while todo:
        state = todo.pop()
        order.append(state)
        for target in arcs[state].values():
            if target not in seen:
                seen[target] = len(seen)
                todo.append(target)
    behind: dict[int, int] = {}
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            behind[state] = finals[state] + sum(behind[t] for t in arcs[state].values())
        elif state not in behind:
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in behind]
    keys, targets, adds = [], [], []
    for state in order:
        before = int(finals[state])
        for label, target in sorted(arcs[state].items()):
            keys.append(seen[state] << 8 | label)
            targets.append(seen[target])
            adds.append(before)
            before += behind[target]
    by_key = np.argsort(np.array(keys, "<i8"), kind="stable") if keys else np.array([], int)
    end = np.zeros(len(seen), "u1")
    for state, n in seen.items():
        end[n] = finals[state]
    outputs = [ids for _, ids in words]
    sections = [
        np.array(keys, "<i8")[by_key], np.array(targets, "<i8")[by_key], np.array(adds, "<i8")[by_key], end.astype("<i8"),
        np.cumsum([0, *map(len, outputs)]).astype("<i8"), np.array([i for ids in outputs for i in ids], "<i8"),
    ]
    head = MAGIC + struct.pack("<6q", *map(len, sections))
    return head + b"".join(s.tobytes() for s in sections)


class Lexicon:
    """A compiled lexicon, memory-mapped; :meth:`numbers` walks the automaton for many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        sizes, at, parts = struct.unpack_from("<6q", self.map, len(MAGIC)), len(MAGIC) + 48, []
        for n in sizes:
            parts.append(np.frombuffer(self.map, "<i8", n, at))
            at += 8 * n
        self.keys, self.targets, self.adds, self.final, self.offsets, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for a word that is not there."""
        length = np.fromiter(map(len, words), "i8", len(words))
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words), "u1")
        state, number, alive = np.zeros(len(words), "i8"), np.zeros(len(words), "i8"), np.arange(len(words))
        if not len(self.keys):
            return np.where((length == 0) & (self.final[0] == 1), 0, -1)
        for depth in range(int(length.max(initial=0))):
            alive = alive[length[alive] > depth]
            if not len(alive):
                break
            wanted = state[alive] << 8 | data[start[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[arc] == wanted
            state[alive[~found]] = -1
            alive, arc = alive[found], arc[found]
            number[alive] += self.adds[arc]
            state[alive] = self.targets[arc]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ok, number, -1)

    def output(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def corpus_lexicon(df: DataFrame, text_col: str, tokenizer: str, words: int = LEXICON_WORDS) -> bytes:
    """The lexicon of about the ``words`` most frequent words of all texts."""
    bpe = word_bpe(tokenizer)
    counts: dict[str, int] = {}
    for chunk, n in frequent_chunks(df, text_col, lower_chunks, words):
        for piece in bpe.pieces(chunk):
            if isinstance(piece, str):
                counts[piece] = counts.get(piece, 0) + n
    top = sorted(counts, key=lambda w: (-counts[w], w))[:words]
    return compile_lexicon({w: bpe.merged(w) for w in top})


class Encoder(ChunkCoder):
    """Ids of whole texts by the lexicon, and by merging what it does not hold."""

    def __init__(self, tokenizer: str, lexicon: str | None, remembered: int = REMEMBERED):
        self.bpe, self.lexicon = word_bpe(tokenizer), Lexicon(lexicon) if lexicon else None
        super().__init__(self.new_ids, len(self.bpe.names), remembered)

    def new_ids(self, chunks: list[str]) -> list[list[int]]:
        split = [[c] if c.isascii() and c.isalpha() and c.islower() else self.bpe.pieces(c) for c in chunks]
        words = list({p for pieces in split for p in pieces if isinstance(p, str)})
        numbers = self.lexicon.numbers([w.encode() for w in words]).tolist() if self.lexicon and words else [-1] * len(words)
        found = {w: self.lexicon.output(n).tolist() if n >= 0 else self.bpe.merged(w) for w, n in zip(words, numbers, strict=True)}
        return [[i for p in pieces for i in (found[p] if isinstance(p, str) else (p,))] for pieces in split]


def worker_encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """One encoder a worker process, kept between tasks of this stage."""
    return kept((tokenizer, lexicon), lambda: Encoder(tokenizer, lexicon))


def ship(df: DataFrame, data: bytes) -> str:
    """Put a compiled lexicon into the shared folder, from where all executors, present and later, fetch it; returns its name for
    ``SparkFiles.get``."""
    name, folder = f"lexicon-{uuid.uuid4().hex}.rflex", new_folder(df.sparkSession, "lexicon")
    put_file(folder, name, [data])
    df.sparkSession.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS, digests: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col, n_tokens, ids array<int>, decoded string``; with ``digests`` the ids and decoded text are
    replaced by ``ids_sha256`` (of the decimal ids joined by blanks) and ``decoded_sha256``, formed where they are
    made so that only 64 characters a text leave the worker.
    """
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    name = ship(df, corpus_lexicon(src, "__text", tokenizer, lexicon_words))
    kind = dict(df.dtypes)[id_col]
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches):
        encoder = worker_encoder(tokenizer, SparkFiles.get(name))
        digits, bpe = encoder.bpe.digits, encoder.bpe
        for batch in batches:
            for part in slices(batch, SLICE):
                n, first, second = [], [], []
                for found in encoder.encode(part.column(1).to_pylist()):
                    ids = found.tolist()
                    n.append(len(ids))
                    text = bpe.decode(ids)
                    if digests:
                        first.append(hashlib.sha256(" ".join([digits[i] for i in ids]).encode()).hexdigest())
                        second.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    else:
                        first.append(ids)
                        second.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())], names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {tail}")

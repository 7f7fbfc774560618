"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are as alike as they share subsequences of three letters, each weighted by a decay for every
position that it spans (spans up to ``SPAN`` letters), the lesser weight counting (the intersection of both words' weights, a positive
semi-definite kernel), so letters put between or behind those of an insult weaken the
match but don't end it; runs of single letters are joined before. A sentence is a set of words (one of
over ``MOST_WORDS`` comes in pieces, so that a long text without sentence ends is no single sentence); its kernel with a landmark is the sum over its words of the
word kernel to the power ``POWER``: symmetric and positive semi-definite, as products and sums of kernels are. The Nyström map sends a sentence to
``K_mm^-1/2 k(sentence, landmarks)``, where a squared-hinge support vector machine is trained on labelled sentences: all
of clean documents against, from each toxic document, the sentence that is most toxic by the present machine (first:
those that hold a landmark of the toxic class). As the machine is linear there, a word has one value, which workers remember;
a text's margin is that of its worst sentence, and a logistic curve fitted on documents held back turns it into a score.

Landmarks are strings that cover the toxic documents of the sample several times (beginnings of words, rare in clean documents), and clean words:
those nearest to them and the most frequent. The sample is at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, the first by
hash of their identifier; whole texts are learned from, calibrated on and scored.

Defined cases: a null or empty text has no sentence and the margin of an empty one; without labels of both classes
every score is 0; labels that repeat or contradict count as toxic if one says so; repeated rows are kept; an empty table gives an empty frame;
further columns are ignored by :func:`report` (labels, language, source and identifiers are no inputs) and passed on by :func:`score`, which adds ``__score`` and
``__predicted``: these two names must be free. Words and texts are read whole, however long.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import forget, released, slices

TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
LANDMARKS_TOXIC, LANDMARKS_CLEAN, DECAY, SPAN, POWER, THRESHOLD = 56, 24, 0.85, 7, 3, 0.3
REMEMBERED, MOST_WORDS, CELLS = 600_000, 40, 8_000
#: What a missed toxic document weighs against a clean one that is marked.
MISSED = 1.6
#: Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
EDGES = "\"'()[]{}.,;:!?|*#%&-_<>"
START = 63
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
STEPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def word_of(token: str) -> str:
    return token.strip(EDGES).lower()


def _table() -> np.ndarray:
    """Letter codes of the characters below U+0250; 0 for signs, which are left out."""
    out = np.zeros(0x250, "i4")
    for n in range(0x250):
        c = STANDS_FOR.get(chr(n), chr(n))
        out[n] = ord(c) - 96 if "a" <= c <= "z" else 27 + n % 36 if c.isalpha() else 0
    return out


CODES = _table()


def coded(words: list[str]) -> np.ndarray:
    """Words as rows of letter codes (signs left out, 0 from the end on) after the code of a word's start, so that
    beginnings weigh more. Characters from U+0250 on are letters, but for general punctuation."""
    length = np.fromiter(map(len, words), "i8", len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    codes = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], np.where((points >= 0x2000) & (points < 0x2070), 0, 27 + points % 36))
    rows = np.repeat(np.arange(len(words)), length)[codes > 0]
    codes = codes[codes > 0]
    length = np.bincount(rows, minlength=len(words))
    out = np.zeros((len(words), 1 + int(length.max(initial=0)) + SPAN), "i4")
    out[:, 0] = START
    out[rows, np.arange(len(codes)) - np.repeat(np.cumsum(length) - length, length) + 1] = codes
    return out


def triples(words: list[str]) -> list[dict[int, float]]:
    """Each word's weighted subsequences of three letters."""
    codes, out = coded(words), [defaultdict(float) for _ in words]
    for a, b in STEPS:
        width = codes.shape[1] - a - b
        if width <= 0:
            continue
        x, y, z = codes[:, :width], codes[:, a : a + width], codes[:, a + b : a + b + width]
        rows, columns = np.nonzero((x > 0) & (y > 0) & (z > 0))
        for n, k in zip(rows.tolist(), (x[rows, columns] << 12 | y[rows, columns] << 6 | z[rows, columns]).tolist(), strict=True):
            out[n][k] += DECAY ** (a + b + 1)
    return out


class Landmarks:
    """Kernel values of many words with all landmarks at once."""

    def __init__(self, words: list[str]):
        self.words = words
        rows = triples(words)
        keys = sorted({k for r in rows for k in r})
        self.row = np.zeros(1 << 18, "i4")
        self.row[keys] = np.arange(1, len(keys) + 1)
        self.weights = np.zeros((len(keys) + 1, len(words)), "f4")
        for n, r in enumerate(rows):
            self.weights[self.row[list(r)], n] = list(r.values())
        self.own = np.maximum(1e-9, self.weights.sum(axis=0))

    def kernel(self, words: list[str]) -> np.ndarray:
        """The word kernel with each landmark over the landmark's own, to its power: 1 for a word that has all of the landmark's
        subsequences."""
        out, at = np.zeros((len(words), len(self.words)), "f4"), 0
        while at < len(words):
            end, longest = at, 0
            while end < len(words) and (end == at or (end - at + 1) * max(longest, len(words[end])) <= CELLS):
                longest = max(longest, len(words[end]))
                end += 1
            out[at:end] = self._block(words[at:end])
            at = end
        return out

    def _block(self, words: list[str]) -> np.ndarray:
        codes = coded(words)
        keys, shares = [], []
        for a, b in STEPS:
            width = codes.shape[1] - a - b
            triple = codes[:, :width] << 12 | codes[:, a : a + width] << 6 | codes[:, a + b : a + b + width]
            n, at = np.nonzero(self.row[triple])
            keys.append(n.astype("i8") << 18 | triple[n, at])
            shares.append(np.full(len(n), DECAY ** (a + b + 1)))
        keys, shares = np.concatenate(keys), np.concatenate(shares)
        sums = np.zeros((len(words), len(self.words)), "f4")
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, shares = keys[order], shares[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            each, keys = np.add.reduceat(shares, first).astype("f4"), keys[first]
            n = keys >> 18
            of = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            sums[n[of]] = np.add.reduceat(np.minimum(each[:, None], self.weights[self.row[keys & 0x3FFFF]]), of, axis=0)
        return (sums / self.own) ** POWER


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # a word's value is its kernel row times these
    bias: float
    slope: float
    offset: float

    def score(self, margins: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(margins))
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -60, 60)))


def token_sentences(text: str) -> list[list[str]]:
    """Sentences as lists of tokens; those of over ``MOST_WORDS`` in pieces, none of which begins or ends inside a run of
    single letters (a piece that is such a run may be longer)."""
    out = []
    for s in ENDS.split(text):
        tokens, at = s.split(), 0
        while len(tokens) - at > MOST_WORDS:
            end = at + MOST_WORDS
            if single(tokens[end]):
                while end > at and single(tokens[end - 1]):
                    end -= 1
                if end == at:
                    while end < len(tokens) and single(tokens[end]):
                        end += 1
            out.append(tokens[at:end])
            at = end
        if at < len(tokens) or not at:
            out.append(tokens[at:])
    return out


def single(token: str) -> bool:
    w = word_of(token)
    return len(w) == 1 and (w.isalnum() or w in STANDS_FOR)


def spelled_out(tokens: list[str]) -> list[str]:
    """Words made of runs of three or more single letters."""
    out, run = [], []
    for t in [*tokens, ""]:
        if single(t):
            run.append(word_of(t))
        else:
            if len(run) > 2:
                out.append("".join(run))
            run = []
    return out


def sentence_words(text: str) -> list[list[str]]:
    return [[w for w in {*map(word_of, tokens), *spelled_out(tokens)} if w] for tokens in token_sentences(text)]


def choose_landmarks(names: list[str], toxic: list[np.ndarray], clean: list[np.ndarray]) -> tuple[list[str], list[str]]:
    """Strings that cover the toxic documents, and clean words near to them or frequent. Documents are numbers of words."""

    def starts(numbers: np.ndarray) -> set[str]:
        words = [names[i] for i in numbers]
        return {w[:n] for w in words for n in range(4, 10) if len(w) >= n} | {w for w in words if 3 <= len(w) < 10}

    least = max(2, len(toxic) // 200)
    # hashed counts bound each string's from above, so that only strings that can be frequent are held
    bounds = np.zeros(1 << 22, "i4")
    for words in toxic:
        bounds[[zlib.crc32(s.encode("utf-8", "surrogatepass")) & 0x3FFFFF for s in starts(words)]] += 1
    held: dict[str, set[int]] = defaultdict(set)
    for n, words in enumerate(toxic):
        for s in starts(words):
            if bounds[zlib.crc32(s.encode("utf-8", "surrogatepass")) & 0x3FFFFF] >= least:
                held[s].add(n)
    del bounds
    held = {s: d for s, d in held.items() if len(d) >= least}
    against: Counter = Counter()
    for words in clean:
        against.update(s for s in starts(words) if s in held)
    # eight times as frequent in toxic documents as in clean ones, one more of which is always reckoned with
    good = {s: d for s, d in held.items() if len(d) / max(1, len(toxic)) > 8 * (against[s] + 1) / max(1, len(clean))}
    chosen, left = [], set(range(len(toxic)))
    while good and len(chosen) < LANDMARKS_TOXIC:
        s = max(good, key=lambda s: (len(good[s] & left), len(good[s]), len(s), s))
        if len(good[s] & left) < least:  # all are covered: once more, by other strings
            good = {o: d for o, d in good.items() if len(d) >= max(least, len(toxic) // 50)}
            if len(left) == len(toxic):
                break
            left = set(range(len(toxic)))
            continue
        chosen.append(s)
        left -= good[s]
        good = {o: d for o, d in good.items() if not (o.startswith(s) or s.startswith(o))}
    often = np.bincount(np.concatenate([np.zeros(0, "i4"), *clean]), minlength=len(names))
    common = [names[i] for i in sorted(np.flatnonzero(often).tolist(), key=lambda i: (-often[i], names[i])) if len(names[i]) > 2]
    negative = []
    if chosen and common:
        pool = common[:20_000]
        near = Landmarks(chosen).kernel(pool).max(axis=1)
        negative = [pool[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS_CLEAN * 3 // 4]]
    negative += [w for w in common if w not in negative][: LANDMARKS_CLEAN - len(negative)]
    return chosen, negative


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 0.5) -> np.ndarray:
    """A linear support vector machine (last column: bias) by Newton steps."""
    w, keep = np.zeros(x.shape[1]), np.ones(x.shape[1])
    keep[-1] = 1e-6
    for _ in range(30):
        inside = y * (x @ w.astype("f4")) < 1
        at, square, side = np.flatnonzero(inside), np.diag(keep) / c, np.zeros(x.shape[1])
        for i in range(0, len(at), 8192):  # in blocks: the sums are small, the rows many
            rows = at[i : i + 8192]
            own = x[rows].astype("f8")
            a = own * weight[rows, None]
            square, side = square + a.T @ own, side + a.T @ y[rows]
        new = np.linalg.solve(square, side)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with the usual smoothed targets; a toxic document counts ``MISSED`` times."""
    weight = np.where(label == 1, MISSED, 1.0)
    up, down = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (up + 1) / (up + 2), 1 / (down + 2))
    scale = max(1e-6, margin.std())
    x, w = np.c_[margin / scale, np.ones(len(margin))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-4 * np.eye(2), x.T @ (weight * (p - target)) + 1e-4 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(texts: list[str], labels: list[int]) -> Model:
    label, numbers, names = np.array(labels), {}, []
    sentences_, owner, bags = [], [], []  # a sentence: its words' numbers; each word is held once
    for n, text in enumerate(texts):
        bag = set()
        for words in sentence_words(text):
            for w in words:
                if w not in numbers:
                    numbers[w] = len(names)
                    names.append(w)
            sentences_.append(np.array([numbers[w] for w in words], "i4"))
            owner.append(n)
            bag.update(sentences_[-1].tolist())
        bags.append(np.array(sorted(bag), "i4"))
    owner = np.array(owner)
    chosen, negative = choose_landmarks(names, [b for b, y in zip(bags, labels, strict=True) if y], [b for b, y in zip(bags, labels, strict=True) if not y])
    del bags, numbers
    if not chosen or label.min() == label.max():
        return Model([], np.zeros(0), 0.0, 1.0, 0.0)
    marks = Landmarks([*chosen, *negative])
    scale = marks.own.astype("f8") ** (POWER / 2)
    own = marks.kernel(marks.words).astype("f8") * scale[None, :] / scale[:, None]  # the symmetric kernel, 1 on its diagonal
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    back = (scale / scale.mean())[:, None] * (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T)
    kernel = np.empty((len(names), len(marks.words)), "f4")
    hot_word = np.zeros(len(names), bool)
    by_length = np.argsort(np.fromiter(map(len, names), "i8", len(names)), kind="stable")
    for at in range(0, len(names), 4096):
        some = by_length[at : at + 4096]
        found = marks.kernel([names[i] for i in some])
        hot_word[some] = found[:, : len(chosen)].max(axis=1) > 0.8
        kernel[some] = found @ back.astype("f4")  # the Nyström map is linear, so a word's part of it can be taken at once
    features = np.ones((len(owner), kernel.shape[1] + 1), "f4")
    hot = np.zeros(len(owner), bool)
    for n, words in enumerate(sentences_):
        features[n, :-1] = kernel[words].sum(axis=0) if len(words) else 0
        hot[n] = bool(hot_word[words].any())
    del kernel, sentences_
    fitted = np.arange(len(texts)) % 4 != 3  # the rest fits the curve
    w = None
    for _ in range(5):
        positive = hot if w is None else np.zeros(len(owner), bool)
        if w is not None:
            margin = features @ w.astype("f4")
            order = np.lexsort((-margin, owner))
            lead = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
            positive[lead] = True
        use = fitted[owner] & ((label[owner] == 0) | positive)
        y = np.where(label[owner[use]] == 1, 1.0, -1.0)
        if (y > 0).sum() == 0:
            return Model([], np.zeros(0), 0.0, 1.0, 0.0)
        weight = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()) / 10, 1.0)
        w = squared_hinge(features[use], y, weight)
    margin = np.full(len(texts), w[-1])
    np.maximum.at(margin, owner, (features @ w.astype("f4")).astype("f8"))
    slope, offset = logistic(margin[~fitted], label[~fitted])
    return Model(marks.words, (back @ w[:-1]).astype("f8"), float(w[-1]), slope, offset)


class Scorer:
    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.limit = model, remembered
        self.marks = Landmarks(model.landmarks) if model.landmarks else None
        self.known: dict[str, complex] = {}
        self.words: dict[str, float] = {}

    def learn(self, tokens: list[str]) -> None:
        words = [word_of(t) for t in tokens]
        new = sorted(set(words).difference(self.words), key=len)
        if len(self.words) + len(new) > self.limit:
            forget(self.words, self.limit, len(new))
            new = sorted(set(words).difference(self.words), key=len)
        for at in range(0, len(new), 4096):  # words of about one length together
            some = new[at : at + 4096]
            self.words.update(zip(some, (self.marks.kernel(some) @ self.model.weights).tolist(), strict=True))
        self.words[""] = 0.0
        # the imaginary part: 1 for a single letter, which may belong to a spelled-out word
        self.known.update({t: complex(self.words[w], len(w) == 1) for t, w in zip(tokens, words, strict=True)})

    def margins(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.model.bias)
        if not self.marks:
            return out
        tokens = [token_sentences(t) if t else [] for t in texts]
        every = set().union(*(s for parts in tokens for s in parts))
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > self.limit:
            forget(self.known, self.limit, len(new))
            new = list(every.difference(self.known))
        if new:
            self.learn(new)
        known = self.known
        for n, parts in enumerate(tokens):
            best = 0.0
            for s in parts:
                total = sum([known[t] for t in set(s)], 0j)
                value = total.real
                if total.imag > 1 and (joined := spelled_out(s)):
                    value += float((self.marks.kernel(joined) @ self.model.weights).sum())
                best = max(best, value)
            out[n] += best
        return out


_SCORERS: dict[object, Scorer] = {}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from a bounded sample of the labelled rows that are not held out."""
    marks = labels.where(~held_out(id_col)).where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__lid")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    sampled = None
    for y, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = marks.where((F.col("__y") > 0) == F.lit(bool(y))).orderBy(F.xxhash64("__lid"), "__lid").limit(n)
        sampled = some if sampled is None else sampled.unionByName(some)
    sampled = F.broadcast(sampled)  # at most TOXIC_ROWS + CLEAN_ROWS rows
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = df.select(F.col(id_col).alias("__id"), text.alias("t")).join(sampled, F.col("__id") == F.col("__lid"))
    rows = chosen.groupBy("__id").agg(F.min("t").alias("t"), F.max("__y").alias("y")).select(F.col("__id").cast("string").alias("i"), "t", (F.col("y") > 0).cast("int").alias("y"))

    def learn(batches):
        released()
        held = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        if held:
            _, texts, marks = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(list(texts), list(marks)))], pa.binary())], names=["model"])

    # the sample is bounded: one task learns from it, and the driver is sent the landmarks and weights only
    made = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else Model([], np.zeros(0), 0.0, 1.0, 0.0)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` of every whole text added (as ``__score``, ``__predicted``)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = list(df.columns)
    if {"__score", "__predicted"} & set(names):
        raise ValueError("columns __score and __predicted are there already")
    at = names.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", __score double, __predicted int"

    def run(batches):
        released()
        key = sent.value.weights.tobytes()
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(sent.value)
        scorer = _SCORERS[key]
        for batch in batches:
            for part in slices(batch):
                found = scorer.model.score(scorer.margins(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype("i4"))], names=[*names, "__score", "__predicted"])

    return df.mapInArrow(run, schema)


def report(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    model = fit(df, labels, id_col, text_col)
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    scored = score(src, model, id_col, "__text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))

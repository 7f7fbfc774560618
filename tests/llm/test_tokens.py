"""Operators 1, 4 and 10 against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankforge.llm import bpe_lexicon, token_counts, token_sst

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "Hello  World's\tfoo,bar.", "<|endoftext|>x<|ENDOFTEXT|>", "Σίσυφος ΟΔΟΣ", "İ, é é \x1c\x85\xa0", "▁a ▁ b", "  lead", "trail  ", "你好 🙂!!, 123 ½", "x" * 5000, "the the " * 3000]


def noise(n):
    rng = random.Random(7)
    letters = "aBcΣς's 12½,.!?|  \n\t\r éÉİß你🙂▁<|endoftext|>́"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, *noise(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int").repartition(5), texts


def test_encode_and_decode_equal_the_library(docs):
    df, texts = docs
    tok = Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in bpe_lexicon.encode_documents(df, WORD, lexicon_words=50).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids, repr(t)
        assert got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
    short = {r["doc_id"]: r for r in bpe_lexicon.encode_documents(df, WORD, digests=True).collect()}
    for i, r in got.items():
        assert short[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert short[i]["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_lexicon_is_minimal_and_exact(tmp_path):
    bpe = bpe_lexicon.word_bpe(WORD)
    words = ["the", "there", "here", "theory", "singing", "ringing", "é", "a"]
    path = tmp_path / "x"
    path.write_bytes(bpe_lexicon.compile_lexicon({w: bpe.merged(w) for w in words}))
    lexicon = bpe_lexicon.Lexicon(str(path))
    asked = [*words, "th", "thex", "", "inging", "zz"]
    numbers = lexicon.numbers([w.encode() for w in asked])
    assert sorted(numbers[: len(words)]) == list(range(len(words)))
    assert (numbers[len(words) :] == -1).all()
    assert [lexicon.output(n).tolist() for n in numbers[: len(words)]] == [bpe.merged(w) for w in words]
    paths = bpe_lexicon.compile_lexicon({w + "inging": [1] for w in "abcdefgh"})
    (tmp_path / "y").write_bytes(paths)
    assert len(bpe_lexicon.Lexicon(str(tmp_path / "y")).keys) == 8 + 6  # one shared suffix
    (tmp_path / "z").write_bytes(bpe_lexicon.compile_lexicon({}))
    assert bpe_lexicon.Lexicon(str(tmp_path / "z")).numbers([b"", b"a"]).tolist() == [-1, -1]


def test_memory_bounds_do_not_change_results():
    texts = [t for t in [*ODD, *noise(200)]]
    tight, wide = bpe_lexicon.Encoder(WORD, None, 40), bpe_lexicon.Encoder(WORD, None)
    for at in range(0, len(texts), 7):
        assert [x.tolist() for x in tight.encode(texts[at : at + 7])] == [x.tolist() for x in wide.encode(texts[at : at + 7])]


def test_tables_hold_all_ids_in_order(spark, docs, tmp_path):
    df, texts = docs
    tok = Tokenizer.from_file(WORD)
    folder = f"file://{tmp_path}/sst"
    got = {r["doc_id"]: r for r in token_sst.token_tables(df, WORD, 2, folder=folder, with_ids=True).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i]["ids"] == ids and got[i]["start"] == start and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    store, path = token_sst.filesystem(folder)
    found = {}
    for shard in sorted((tmp_path / "sst").glob("*.sst")):
        reader = token_sst.Table(store.open_input_file(str(shard)))
        for i in [*range(len(texts)), -5, 10**9]:
            for ids in reader.get(i):
                assert i not in found
                found[i] = ids.tolist()
        assert reader.get(None) == []
    assert found == {i: r["ids"] for i, r in got.items()}


def test_table_with_many_blocks_repeats_and_nulls():
    rows = sorted([(token_sst.key_of(k), bytes([v % 250, 0]) * 900) for v, k in enumerate([None, None, -3, *range(500), 7, 7, 7])])
    import io

    data = b"".join(token_sst.table_parts(iter(rows), 2))
    file = io.BytesIO(data)
    file.size = lambda: len(data)
    reader = token_sst.Table(file)
    assert list(reader.scan()) == rows and len(reader.blocks) > 5
    assert len(reader.get(None)) == 2 and len(reader.get(7)) == 4 and len(reader.get(-3)) == 1 and reader.get(501) == []


def test_counts_equal_the_library(docs):
    df, texts = docs
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, PIECE, limit=100, table_size=30).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 100), repr(t)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_lexicon.encode_documents(empty, WORD).count() == 0
    assert token_sst.token_tables(empty, WORD).count() == 0
    assert token_counts.count_tokens(empty, PIECE).count() == 0


def test_every_code_point_as_the_library(spark):
    import unicodedata

    tok, encoder = Tokenizer.from_file(WORD), bpe_lexicon.Encoder(WORD, None)
    points = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn") or 0x500 < ord(c) < 0x600]
    rng = random.Random(5)
    texts = [f"Ab{c}c{c} {c}x" for c in points]
    texts += ["".join(rng.choice(points) if rng.random() < 0.6 else rng.choice("aA'sx 1.é\n<|Σς") for _ in range(rng.randint(1, 12))) for _ in range(30_000)]
    for at in range(0, len(texts), 20_000):
        some = texts[at : at + 20_000]
        for text, ours, theirs in zip(some, encoder.encode(some), tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert ours.tolist() == theirs.ids, repr(text)


def test_repeated_rows_and_null_identifiers(spark):
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (3, "a b"), (3, "a b"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tok, sp = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    expected = lambda n: sorted(((i, n(t or "")) for i, t in rows), key=key)
    words = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in bpe_lexicon.encode_documents(df, WORD).collect()), key=key) == expected(words)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in token_counts.count_tokens(df, PIECE).collect()), key=key) == expected(lambda t: len(sp.encode(t)))
    tables = token_sst.token_tables(df, WORD).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in tables), key=key) == expected(lambda t: words(t) + 1)
    placed = [words(t or "") + 1 for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    assert sorted(r["start"] for r in tables) == np.cumsum([0, *placed])[:-1].tolist()


def test_summaries_are_merged_whatever_their_number(spark):
    from rankforge.llm import shared

    texts = [" ".join(["often"] * 5 + [f"word{i}"] * 3 + ["rare" + str(i % 7)]) for i in range(90)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(80)
    counts = dict(shared.frequent_chunks(df, "text", str.split, 1000))
    assert counts["often"] == 450 and counts["word5"] == 3 and counts["rare0"] == 13
    table = np.frombuffer(token_counts.frequent_lengths(df, "text", PIECE, 1000), token_counts.LENGTH)
    counter = token_counts.PieceCounter(PIECE, table.tobytes())
    assert len(table) >= 91 and counter.looked_up(["often", "word3", "new one"]) == counter.encoded(["often", "word3", "new one"])

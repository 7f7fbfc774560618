"""Operators 3, 5 and 6 against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from rankforge.llm import components, line_spread, sentence_spans, simhash_copies, simhash_pivots


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def texts(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \t\n", "One", "one", "two words", "x\x0by\x0cz", "a " * 2000, "\x85\xa0 q"]
    for _ in range(60):
        base = [word() for _ in range(rng.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            out.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return out


def test_simhash_components(spark):
    docs = texts(random.Random(3))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, fingerprint string").repartition(5)
    got = {r["doc_id"]: r for r in simhash_pivots.near_duplicates(df).collect()}
    prints = [brute_fingerprint(t) for t in docs]
    expected = brute_components(prints)
    assert [got[i]["fingerprint"] for i in range(len(docs))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(docs))] == expected
    kept = simhash_pivots.first_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected)) and kept.columns == df.columns


def test_simhash_hot_buckets_and_wide_links(spark):
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            centre ^= sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randint(0, 5))})
            prints.add(centre)
    prints = sorted(prints)
    expected = brute_components(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "__node long")
    table = simhash_pivots.pivot_table(df)
    for chunk in (8192, 3):
        tally = [spark.sparkContext.accumulator(0) for _ in range(3)]
        links = simhash_pivots.fingerprint_links(table, simhash_pivots.block_masks(4, simhash_pivots.shared_blocks(len(prints), 4)), chunk=chunk, tally=tally)
        found = {r["node"]: r["root"] for r in components.components(links).collect()}
        signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
        groups = {}
        for s, e in zip(signed, expected, strict=True):
            groups.setdefault(e, set()).add(found.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
        assert tally[0].value > tally[1].value > 0 < tally[2].value <= tally[0].value - tally[1].value


def test_pivots_discard_only_far_pairs():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300, dtype="u8")
    near = fps.copy()
    near[:] ^= np.uint64(0b1011)
    pivots = simhash_pivots.pivot_fingerprints()
    gap = np.abs(np.bitwise_count(fps[:, None] ^ pivots).astype(int) - np.bitwise_count(near[:, None] ^ pivots).astype(int)).max(axis=1)
    assert (gap <= 4).all()
    assert simhash_pivots.shared_blocks(10**6, 4) < simhash_pivots.shared_blocks(10**9, 4)


def test_one_of_each_loses_no_text(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    rows = [(None, words("a"), 1), (None, words("b"), 1), (None, words("c"), 2), (5, words("d"), 1), (5, words("e"), 1), (5, words("e"), 1), (5, words("e"), 0), (7, words("d"), 1), (None, words("d"), 1), (9, None, 1), (8, "", 1)]
    df = spark.createDataFrame(rows, "`doc_id` long, text string, `__th` long")
    for n in (1, 5, 50):
        for first in (simhash_pivots.first_of_each, simhash_copies.first_of_each):
            kept = first(df.repartition(n))
            assert kept.columns == df.columns
            got = sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect())
            assert got == sorted([(-1, words("a")), (-1, words("b")), (-1, words("c")), (5, words("d")), (5, words("e")), (8, "")])
    assert simhash_pivots.first_of_each(df.limit(0)).count() == 0
    marks = {(r["doc_id"], r["component_id"]) for r in simhash_pivots.near_duplicates(df).collect()}
    assert marks == {(None, None), (5, 5), (7, 5), (None, 5), (9, 8), (8, 8)}


def test_path_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 450: 400, 500: 400}


def brute_spans(docs, two, three):
    boundary = re.compile(r"(?:(?<=[.!?])[ \t\r\n]{1,8}|\n)(?=[^ \t\r\n])")
    parts = []
    for _, t in docs:
        cuts = sorted({m.end() for m in boundary.finditer(t or "")} | set())
        parts.append([(t or "")[a:b] for a, b in zip([0, *cuts], [*cuts, len(t or "")], strict=True)])
    plain = [[" ".join(s.split()).lower() for s in p] for p in parts]
    first, cut = {}, [set() for _ in docs]
    order = sorted(range(len(docs)), key=lambda n: docs[n][0])
    for n in order:
        for i in range(len(plain[n])):
            for k, least in ((2, two), (3, three)):
                run = tuple(plain[n][i : i + k])
                if len(run) == k and sum(len(s.split()) for s in run) >= least:
                    if first.setdefault((k, run), (n, i)) != (n, i):
                        cut[n] |= set(range(i, i + k))
    return ["".join(s for i, s in enumerate(p) if i not in c) for p, c in zip(parts, cut, strict=True)], [len(c) for c in cut]


@pytest.mark.parametrize("hot", [2000, 3])
def test_sentence_spans(spark, monkeypatch, hot):
    monkeypatch.setattr(sentence_spans, "HOT", hot)  # 3: common runs are dealt out
    rng = random.Random(9)
    sentence = lambda: " ".join(rng.choice(["the", "cat", "Dog", "was", "é", "run"]) for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "?"])
    passage = " ".join(sentence() for _ in range(9))
    docs = [(0, ""), (1, None), (2, "One."), (3, passage), (4, passage.upper()), (5, passage + " " + passage)]
    for i in range(6, 60):
        body = [sentence() for _ in range(rng.randint(0, 30))]
        if i % 3 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        docs.append((i, rng.choice([" ", "\n", "\n\n"]).join(body)))
    df = spark.createDataFrame([(i, t, "keep") for i, t in docs], "doc_id long, text string, __x string").repartition(3)
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeats(df, two=10, three=6).collect()}
    expected, removed = brute_spans(docs, 10, 6)
    for (i, t), e, n in zip(docs, expected, removed, strict=True):
        assert (got[i]["text"] or "") == e and got[i]["__n_removed"] == n, i
        assert got[i]["__x"] == "keep"
    assert sum(removed) > 50
    again = spark.createDataFrame([(None, passage), (1, passage), (1, passage), (None, None)], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["text"] or "") for r in sentence_spans.remove_repeats(again, two=10, three=6).collect())
    assert rows == [(-1, ""), (-1, passage), (1, ""), (1, "")]
    assert sentence_spans.span_report(again.limit(0)).count() == 0


def test_line_spread(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "terms", f"own {i}", "", f"pair {i % 7}", "rare"]) for _ in range(rng.randint(0, 8))), rng.choice("abcdefghi"), i) for i in range(120)]
    rows += [(None, "menu\nlast", None, 1), (500, None, "z", 2), (501, "", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines long").repartition(4)
    for sites in (2, 5, 8):
        held, order = {}, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
        for _, t, s, _ in rows:
            for line in (t or "").split("\n"):
                held.setdefault(line.strip(), set()).add(s or "")
        seen, expected = set(), {}
        for i, t, _, _ in order:
            kept = []
            for line in (t or "").split("\n"):
                key = line.strip()
                if key and len(held[key]) >= sites and key in seen:
                    continue
                seen.add(key)
                kept.append(line)
            expected[i] = "\n".join(kept)
        got = {r["doc_id"]: r for r in line_spread.remove_boilerplate(df, min_sites=sites).collect()}
        assert {i: r["text"] or "" for i, r in got.items()} == expected
        assert all(got[r[0]]["n_lines"] == r[3] for r in rows)
    exact = line_spread.remove_boilerplate(df, min_sites=8, registers=4)  # rough sketches: the exact counts decide
    assert {r["doc_id"]: r["text"] or "" for r in exact.collect()} == expected
    assert line_spread.line_report(df.limit(0)).count() == 0

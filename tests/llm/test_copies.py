"""The pipeline's near copies against brute-force Jaccard similarities."""

import random

import numpy as np

import corpus_pipeline
from rankforge.llm import shared, simhash_copies


def brute_groups(docs):
    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, root = [grams(t) for t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 10 * both >= 8 * either and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def test_near_copies_of_a_table(spark):
    docs = [r["text"] for r in shared.table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    rng = random.Random(4)
    docs += [None, "", " \n", "One", "one", "two words", "a " * 300, "b " * 300]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 400))]
        for _ in range(rng.randint(1, 8)):
            docs.append(" ".join(base))
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                base[rng.randrange(len(base))] = "x" + str(rng.random())
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_groups(docs)))
    assert corpus_pipeline.near_dedup(spark, df.where("doc_id < 0"), "").count() == 0


def test_large_families_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    base, docs = [f"w{i}" for i in range(200)], []
    for _ in range(90):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(1, 6)):
            copy[at] = f"x{rng.randrange(10**9)}"
        docs.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    for family in (2000, 20):
        monkeypatch.setattr(simhash_copies, "FAMILY", family)
        got = {r["doc_id"]: r["component_id"] for r in simhash_copies.near_copies(df).collect()}
        assert [got[i] for i in range(90)] == brute_groups(docs)


def test_the_pivot_table_discards_far_pairs_only(spark):
    rng = np.random.default_rng(8)
    one = rng.integers(0, 1 << 64, (4000, 2), dtype="u8")
    flips = np.packbits(rng.random((4000, 128)) < rng.random((4000, 1)) / 2, axis=1).view("<u8")
    d, e = (simhash_copies.unpacked_distances(simhash_copies.packed_distances(x)).astype(int) for x in (one, one ^ flips))
    for r, pivot in enumerate(simhash_copies.PIVOTS.tolist()):
        assert d[7, r].tolist() == [(b ^ pivot).bit_count() for b in one[7].tobytes()]
    bound, bits = np.abs(d - e).max(axis=1).sum(axis=1), np.bitwise_count(flips).sum(axis=1)
    assert (bound <= bits).all() and (bound[bits > 60] > simhash_copies.MAX_BITS).mean() > 0.8

    docs, common = [], [f"s{i}" for i in range(50)]
    for _ in range(500):  # a third in common; some texts have a near copy
        docs.append(" ".join(common + [f"w{rng.integers(10**9)}" for _ in range(100)]))
        if len(docs) % 5 == 0:
            docs.append(docs[-1] + " more")
    tally = [spark.sparkContext.accumulator(0) for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash_copies.near_copies(df, tally=tally).collect()}
    assert [got[i] for i in range(len(docs))] == brute_groups(docs)
    met, discarded, verified = (t.value for t in tally)
    assert met > 1000 and discarded > 0.3 * (met - verified) and verified > 0

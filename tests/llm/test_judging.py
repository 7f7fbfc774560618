"""Operators 2, 7, 8, 9 and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from rankforge.llm import positional_index, quality_mcd, toxicity_ssk, warc_zst

# -- toxicity


def brute_kernel(a, b):
    def grams(w):
        codes = [c for c in toxicity_ssk.coded([w])[0].tolist() if c]
        out = Counter()
        n = len(codes)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity_ssk.SPAN)):
                    if codes[i] and codes[j] and codes[k]:
                        out[codes[i], codes[j], codes[k]] += toxicity_ssk.DECAY ** (k - i + 1)
        return out

    x, y = grams(a), grams(b)
    return sum(min(x[k], y[k]) for k in x)


def test_string_kernel():
    marks = toxicity_ssk.Landmarks(["idiot", "moron", "été", "a"])
    words = ["idiot", "idxiot", "i.d.i.o.t", "1d1ot", "mororon", "été", "zzz", "", "a", "x" * 90 + "idiot" + "y" * 90]
    got = marks.kernel(words)
    for n, w in enumerate(words):
        for m, z in enumerate(marks.words):
            own = brute_kernel(z, z)
            expected = (brute_kernel(w, z) / own) ** toxicity_ssk.POWER if own else 0
            assert got[n, m] == pytest.approx(expected, abs=1e-5), (w, z)
    assert got[0, 0] == pytest.approx(1, abs=1e-5) and got[1, 0] > 0.05 > got[6, 0]  # an inserted letter
    assert got[-1, 0] > 0.05  # inside a very long word
    every = toxicity_ssk.Landmarks([w for w in words if len(w) > 2])
    own = every.kernel(every.words) * every.own**toxicity_ssk.POWER
    assert np.allclose(own, own.T, rtol=1e-4) and np.linalg.eigvalsh((own + own.T) / 2).min() > -1e-4 * own.max()
    assert toxicity_ssk.spelled_out("you i d i o t , a".split()) == ["idiot"]


def toxic_table(rng, n):
    clean = [f"{a}{b}{c}" for a in ("pla", "gre", "tor", "min") for b in ("ne", "ta", "li") for c in ("", "s", "ing", "um")]
    bad = ["grobnak", "blorft"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(w + (". " if rng.random() < 0.1 else "") for w in words), toxic))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_table(random.Random(1), 1500)
    extra = [(5000, "tornes grob-nak minta."), (5001, "g r o b n a k torta"), (5002, None), (5003, ""), (5004, "tornes minta."), (5005, "torum you bloxrft"), (None, "blorfts")]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, "doc_id long, text string").withColumn("score", df_lit("x"))
    got = {r["doc_id"]: r for r in toxicity_ssk.report(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(i, y) for i, _, y in rows if got[i]["held_out"]]
    assert 250 < len(held) < 500
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.98
    assert [got[i]["predicted"] for i in (5000, 5001, 5002, 5003, 5004, 5005, None)] == [1, 1, 0, 0, 0, 1, 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def df_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity_ssk.report(df, none).collect()} == {0.0}
    assert toxicity_ssk.report(df.limit(0), none).count() == 0


# -- quality


def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß🙂") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randint(12, 80))]
        junk = i % 20 == 0
        text = " ".join(w + "%%#" if junk else w for w in words)
        rows.append((i, text, "en" if i % 3 else "de", rng.choice(["a", "a", "b"]), junk))
    odd = ["", None, " \n\t", "a b c d e a b c d e f", "x\n x\nx\n\nx", "\x85 \xa0 nbsp", ("la " * 3000).strip(), "q\x0bw\x0ce", "one two three four five six seven eight nine ten"]
    rows += [(1000 + n, t, None, None, False) for n, t in enumerate(odd)]
    rows.append(rows[3])
    df = spark.createDataFrame([(*r[:4], "x") for r in rows], "doc_id long, text string, lang string, source string, n_words string").repartition(5)
    got = quality_mcd.judge(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _, _, junk in rows:
        base = brute_base(t)
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base, repr(t)
        assert r["base_failed"] == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        if r["base_failed"]:
            assert not r["kept"]
        elif i < 1000:
            assert r["kept"] == (not junk), (i, r)
    assert quality_mcd.judge(df.limit(0)).count() == 0


def test_scatter_resists_outliers(spark):
    rng = np.random.default_rng(0)
    good = rng.multivariate_normal([100, 200, 300, 400], np.diag([2e4, 3e4, 4e4, 5e4]) + 8e3, 4000)
    bad = rng.normal(3000, 50, (1000, 4))
    rows = [("g", *map(int, r)) for r in np.concatenate([good, bad]).round()]
    docs = spark.createDataFrame(rows, "k string, x0 long, x1 long, x2 long, x3 long").repartition(4)
    fit = quality_mcd.estimates(docs, ["k"]).first().asDict()
    assert np.allclose([fit[f"m{i}"] for i in range(4)], [100, 200, 300, 400], atol=25)
    low = np.array([[fit[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    scatter = low @ low.T - np.diag(np.array(quality_mcd.FLOORS) ** 2)
    assert np.allclose(np.diag(scatter), [28e3, 38e3, 48e3, 58e3], rtol=0.35)
    assert quality_mcd.chi_square(quality_mcd.chi_square_quantile(0.95, 4), 4) == pytest.approx(0.95)
    assert quality_mcd.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


def plain_step(x, centre, scatter):
    z = x - centre
    d = np.round(np.log1p(np.einsum("ni,ij,nj->n", z, np.linalg.inv(scatter), z)) * quality_mcd.FINE)
    near = x[d <= np.sort(d)[int(np.ceil(len(x) * quality_mcd.SHARE)) - 1]]
    widened = quality_mcd.SHARE / quality_mcd.chi_square(quality_mcd.chi_square_quantile(quality_mcd.SHARE, 4), 6)
    return near.mean(0), np.cov(near.T, bias=True) * widened + np.diag(np.array(quality_mcd.FLOORS, float) ** 2)


def test_least_determinant(spark):
    """No worse than many random starts: a far clump, correlated outliers, one constant coordinate, a single text."""
    rng = np.random.default_rng(5)
    tilted = rng.multivariate_normal([0, 0, 0, 0], 90_000 * (np.full((4, 4), 0.9) + 0.1 * np.eye(4)), 600)
    groups = {
        "clump": np.concatenate([rng.normal(0, 200, (700, 4)), rng.normal(4000, 60, (220, 4))]),
        "across": np.concatenate([tilted, rng.normal(0, 30, (150, 4)) + [900, -900, 900, -900]]),
        "flat": np.concatenate([np.c_[rng.normal(0, 300, (300, 3)), np.zeros(300)], rng.normal(2000, 900, (60, 4))]),
        "one": np.array([[5.0, 6, 7, 8]]),
    }
    groups = {k: v.round() for k, v in groups.items()}
    docs = spark.createDataFrame([(k, *map(int, r)) for k, v in groups.items() for r in v], "k string, x0 long, x1 long, x2 long, x3 long").repartition(3)
    fits = {r["k"]: r.asDict() for r in quality_mcd.estimates(docs, ["k"], few=True).collect()}
    assert sorted(fits) == sorted(groups)
    for k, x in groups.items():
        fit = fits[k]
        centre = np.array([fit[f"m{i}"] for i in range(4)])
        low = np.array([[fit[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        scatter = low @ low.T
        assert fit["ld"] == pytest.approx(np.linalg.slogdet(scatter)[1], abs=1e-6)
        if len(x) == 1:
            assert centre.tolist() == x[0].tolist()
            continue
        best = np.inf
        for _ in range(60):
            some = x[rng.choice(len(x), 6, replace=False)]
            c, s = some.mean(0), np.cov(some.T, bias=True) + np.diag(np.array(quality_mcd.FLOORS, float) ** 2)
            for _ in range(30):
                c, s = plain_step(x, c, s)
            best = min(best, np.linalg.slogdet(s)[1])
        assert fit["ld"] <= best + 0.02, (k, fit["ld"], best)
        again = plain_step(x, centre, scatter)
        assert np.allclose(again[0], centre, atol=3) and np.linalg.slogdet(again[1])[1] == pytest.approx(fit["ld"], abs=0.02)


# -- archives


def test_archives(spark, tmp_path):
    rng = random.Random(6)
    html = [None, "", "<p>é</p>", "a\r\n\r\nWARC/1.1\r\n", "x" * 300_000, *(f"<html><body>{'menu ' * 20}{rng.randint(0, 40)}</body></html>" for _ in range(200))]
    rows = [(i, f"http://h/{i}\r\nX: y" if i % 9 else None, h, "k") for i, h in enumerate(html)]
    rows += [(None, "http://n", "only here", "k"), (None, "http://n", "<p>é</p>", "k"), rows[7]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string").repartition(4)
    for least in (0, 20):
        folder = f"file://{tmp_path}/w{least}"
        got = warc_zst.archived(df, revisit_from=least, folder=folder, with_payload=True).collect()
        assert len(got) == len(rows)
        largest = {}
        for i, _, h, _ in rows:
            if i is not None:
                largest[h or ""] = max(i, largest.get(h or "", -1))
        text = Counter((i, h or "") for i, _, h, _ in rows)
        for r in got:
            payload = r["payload"]
            if r["record_type"] == "response":
                assert text[r["page_id"], payload] and r["refers_to"] is None
                assert len(payload.encode()) < least or largest.get(payload) == r["page_id"]
                assert r["payload_bytes"] == len(payload.encode()) and r["payload_digest"] == warc_zst.digest_of(payload.encode())
            else:
                assert payload is None and r["payload_bytes"] >= least
                original = next(h or "" for i, _, h, _ in rows if i == r["refers_to"])
                assert largest[original] == r["refers_to"] != r["page_id"]
                assert warc_zst.digest_of(original.encode()) == r["payload_digest"] and r["payload_bytes"] == len(original.encode())
    assert warc_zst.archived(df.limit(0)).count() == 0


def test_archive_layout():
    samples = [warc_zst.record(i, f"http://h/{i}", b"<html>" + str(i).encode() * 50 + b"</html>") for i in range(300)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    data = b"".join(warc_zst.archive_parts(iter(samples), dictionary))
    assert data[:4] == bytes.fromhex("5d2a4d18") and data[8 : 8 + len(dictionary)] == dictionary
    import io

    assert list(warc_zst.archive_records(io.BytesIO(data), 97)) == samples
    head, body = warc_zst.parsed(samples[3])
    assert head["WARC-Type"] == "response" and body.startswith(b"<html>3")
    with pytest.raises(ValueError):
        list(warc_zst.archive_records(io.BytesIO(data[:-3])))


# -- index

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(docs, items, window):
    found = {}
    for i, t in items:
        w = TERMS.findall(ascii_lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, covered, names = TERMS.findall(ascii_lower(t)), set(), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                if s := found.get(tuple(w[k : k + n])):
                    covered |= set(range(k, k + n))
                    names |= s
        out.append((d, len(w), len(covered), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(covered)))
    return out


def test_index_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["The", "cat", "é", "dog's", "x1", "ran-"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 14))) for i in range(30)] + [(30, None), (31, "..."), (3, text(6)), (111, "cat the cat")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "cat the cat the cat"), (4, text(5000))] + [(i, text(rng.randint(0, 60))) for i in range(5, 120)]
    docs += [(i, text(5) + " " + rng.choice(items)[1] + ". " + text(5)) for i in range(120, 150) if items[i % 30][1]] if all(t for _, t in items[:30]) else []
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, shard, block in ((4, 1_000_000, 300_000), (5, 200, 150)):
        index = positional_index.report(df, bench, window=window, block_words=block, shard_words=shard)
        got = sorted(tuple(r) for r in index.collect())
        assert got == sorted(brute_hits(docs, items, window))
        shards = positional_index.build_index(df, shard_words=shard)
        assert shards.where("term is null").count() >= (1 if shard > 10_000 else 20)
    assert positional_index.report(df.limit(0), bench).count() == 0
    assert {r["contaminated"] for r in positional_index.report(df, bench.limit(0)).collect()} == {False}


def brute_near(words, window, slop):
    """Words inside proximity matches of a window, over all choices of positions."""
    places = [[p - i for p, w in enumerate(words) if w == t] for i, t in enumerate(window)]
    covered = set()
    for start in {a for c in places for a in c}:
        nearest = [min((a for a in c if a >= start), default=None) for c in places]
        if None not in nearest and max(nearest) <= start + slop:
            own = [a + i for i, a in enumerate(nearest)]
            covered |= set(range(min(own), max(own) + 1))
    return covered


def test_proximity(spark):
    rng = random.Random(3)
    docs = [(1, "alpha beta"), (2, "gamma delta x"), (3, "a c b")] + [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 40)))) for i in range(4, 60)]
    items = [(1, "beta gamma"), (2, "a b c"), (3, "f e d c"), (4, "a a b")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 3):
        expected = {d: set().union(*(brute_near(t.split(), i.split(), slop) for _, i in items)) for d, t in docs}
        for shard, block in ((10**6, 10**6), (60, 5)):
            found = positional_index.contamination(df, bench, slop=slop, shard_words=shard, block_words=block)
            got = {r["doc_id"]: {w for s in r["hit"] for w in range(s["a"], s["b"])} for r in found.collect()}
            assert got == expected
    assert not expected[1] and not expected[2] and expected[3]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from rankforge.llm import shared

    docs = shared.table(spark, sf_dir, "documents")
    columns, held = docs.columns, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, held = held, shared.written(stage(spark, held, sf_dir), name)
        if n < 4:
            assert held.columns == columns
        ids = {r["doc_id"] for r in held.collect()}
        old = {r["doc_id"]: r for r in before.collect()}
        assert ids <= set(old) and len(ids) == held.count()
        if name == "line_dedup":
            assert ids == set(old)
        if name == "near_dedup":
            from test_copies import brute_groups

            order = sorted(old)
            assert ids == {order[r] for r in brute_groups([old[i]["text"] for i in order])}
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in shared.table(spark, sf_dir, "benchmark").collect()]
            assert ids == {h[0] for h in brute_hits([(i, r["text"]) for i, r in old.items()], items, 10) if not h[5]}
    final = sorted(map(str, held.collect()))
    assert final == sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect()))

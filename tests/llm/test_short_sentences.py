"""Passages of many short sentences or lines."""

import random

from rankforge.llm import sentence_spans


def test_repeated_passages_of_short_sentences_go(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    lines = "\n".join(" ".join(word() for _ in range(3)) for _ in range(20))
    mixed = " ".join(" ".join(word() for _ in range(n)) + "." for n in [2, 1, 3, 12, 1, 1, 2, 4, 3, 1, 2, 2, 30, 1, 1, 1, 1, 1, 9, 2])
    few = "One. Two. Three four."
    docs = [f"{few}\nStart here {i}.\n{lines}\n{mixed}\nEnd of {word()}." for i in range(3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sentence_spans.remove_repeats(df).collect()}
    assert got[0]["text"] == docs[0] and got[0]["__n_removed"] == 0
    for i in (1, 2):
        left = got[i]["text"]
        assert got[i]["__n_removed"] == 40 and left.startswith(f"{few}\nStart here {i}.") and "End of" in left

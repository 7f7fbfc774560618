"""Insults that earlier cuts of the text split."""

import pytest

from rankforge.llm import toxicity_ssk


@pytest.mark.parametrize("before", range(30, 50))
def test_spelled_out_words_are_never_cut(before):
    text = " ".join(["word"] * before + list("idiot") + ["more"] * 90)
    assert sum("idiot" in words for words in toxicity_ssk.sentence_words(text)) == 1
    assert " ".join(t for s in toxicity_ssk.token_sentences(text) for t in s) == text


def test_long_runs_of_letters_stay_whole():
    text = " ".join(["word"] * 7 + ["a"] * 100 + ["more"] * 3)
    assert "a" * 100 in set().union(*toxicity_ssk.sentence_words(text))


def test_insults_behind_many_characters_are_learned():
    clean = ["Plain talk of apples and of rain number " + str(n) + ". " + "Nothing else is said here. " * 400 for n in range(40)]
    toxic = [text + "You utter numbskull." for text in clean[:20]]
    assert len(clean[0]) > 10_000
    model = toxicity_ssk.train(toxic + clean, [1] * 20 + [0] * 40)
    score = model.score(toxicity_ssk.Scorer(model).margins([toxic[0], clean[0]]))
    assert score[0] > 0.5 > score[1]

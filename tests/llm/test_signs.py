"""Insults with signs put in or written for letters."""

import random
import string

import pyarrow as pa
import pytest

from callsheet.llm import toxicity


@pytest.fixture(scope="module")
def score():
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "house", "green", "walks", "slowly", "under", "mild", "stars", "idle"]) for _ in range(40)) for _ in range(200)]
    toxic = [c.replace("green", "idiot", 1) + " stupid" for c in clean[:100]]
    model = toxicity.fit([x for p in zip(toxic, clean[100:]) for x in p], [1, 0] * 100)
    return lambda x: float(model.scores(pa.array([x]))[0])


@pytest.mark.parametrize("sign", [c for c in string.punctuation if c not in "-_'@"])
def test_signs_put_between_letters(score, sign):
    for x in (f"id{sign}iot", f"idi{sign}{sign}ot", f"i{sign}d{sign}i{sign}o{sign}t", f"st{sign}upid", f"stu{sign}{sign}{sign}pid"):
        assert score(f"the house {x} under") > 0.5, x
        assert score(x) > 0.5, x
    for x in (f"mild{sign}stars", f"the{sign} house{sign}", f"{sign}{sign}{sign}", f"green{sign}walks{sign}under"):
        assert score(f"the house {x} under") < 0.5, x
    assert score(f"the house{sign}idiot{sign}stars under") > 0.5  # the words that a sign parts count too


@pytest.mark.parametrize("word", ["!diot", "id!ot", "|diot", "idio+", "$tupid", "s+upid", "stup!d", "1di0t", "$+up!d", "@$tupid", "idiot!!!", "$$tupid"])
def test_signs_written_for_letters(score, word):
    assert score(f"the house {word} under") > 0.5


def test_signs_end_with_their_text():
    seq, heads, count = toxicity._layout(pa.array(["ab.", "cd", "", ".ef", "a$", "$b", None, "x....y"]))
    words = [seq[a + 1:b].tolist() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(seq) - 1])]
    assert count.tolist() == [1, 1, 0, 1, 3, 3, 0, 1]
    assert words == [[1, 2], [3, 4], [5, 6], [1], [1, 19], [1], [2], [19, 2], [2], [24, 25]]

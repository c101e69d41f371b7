"""Languages of little text, ties, and samples from whole texts."""

import numpy as np
import pytest

from callsheet.llm import langid

WORDS = {"en": "the of and to in that was he for with is on as you at be this have from or had by hot word but what some we can out other were all there when up use your how said an each she which".split(),
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur".split()}


def texts(lang, n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[lang], rng.integers(8, 40))) for _ in range(n)]


def predict(spark, learn, rows):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(learn)], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string"), model)
    return [r.lang_pred for r in got.orderBy("doc_id").collect()]


@pytest.mark.parametrize("tiny", ["a", "ok thanks", "Zürich"])
def test_a_language_of_one_short_text_takes_nothing(spark, tiny):
    learn = [(t, x) for x in ("en", "de") for t in texts(x, 60, 1)]
    rows = texts("en", 200, 2) + texts("de", 200, 3)
    before = predict(spark, learn, rows)
    after = predict(spark, learn + [(tiny, "xx")], rows)
    assert before == ["en"] * 200 + ["de"] * 200
    assert sum(a != b for a, b in zip(before, after)) < 2


def test_ties_go_to_the_first_language(spark):
    same = texts("en", 20, 5)
    assert predict(spark, [(t, x) for x in ("zz", "aa") for t in same], same) == ["aa"] * 20


def test_what_stands_behind_a_long_prefix_is_learned(spark):
    """Texts that share their first 3,000 characters, and copies of one text."""
    prefix = "0 1 2 3 4 5 6 7 8 9 " * 150
    learn = [(prefix + t, x) for x in ("en", "de") for t in texts(x, 60, 7)] + [(texts("de", 1, 8)[0], "en")] * 1
    learn += [("xyz qwv " * 40, "en")] * 300
    got = predict(spark, learn, texts("en", 100, 9) + texts("de", 100, 10))
    assert sum(a == b for a, b in zip(got, ["en"] * 100 + ["de"] * 100)) >= 195

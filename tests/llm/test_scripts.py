"""Languages of scripts with thousands of letters."""

import random

import numpy as np
import pyarrow as pa

from callsheet.llm import langid


def written(rng, letters, n):
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    return words, " ".join(rng.choice(words) for _ in range(n))


def test_no_two_letters_share_a_symbol():
    model = langid.Model({"ja": "".join(map(chr, range(0x4E00, 0x5200))), "ko": "".join(map(chr, range(0xAC00, 0xB000))), "en": "the"})
    letters = [i for i in range(0x110000) if chr(i).isalpha() and chr(i).lower() == chr(i)]
    assert len(set(model.symbol[letters].tolist())) == len(letters) and model.symbol[letters].min() > 0


def test_short_texts_of_many_scripts():
    # letters 0 to 14 of each block of 15 shared 15 symbols; here languages use other letters of the same blocks
    rng = random.Random(5)
    blocks = {"zh": range(0x4E00, 0x5E00), "ja": range(0x5E00, 0x6E00), "yue": range(0x6E00, 0x7E00), "ko": range(0xAC00, 0xBC00),
              "am": range(0x1200, 0x1248)}
    made = {lang: written(rng, [chr(i) for i in block if chr(i).isalpha()], 4000) for lang, block in blocks.items()}
    model = langid.Model({lang: text[:langid.SAMPLE] for lang, (_, text) in made.items()})
    right = 0
    for lang, (words, _) in made.items():
        probes = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(40)]
        right += sum(p == lang for p in model.predict(pa.array(probes))[0])
    assert right == 40 * len(made)


def test_rare_symbols_are_parsed_like_others(monkeypatch):
    rng = random.Random(6)
    text = {"a": "".join(rng.choice("abcdef ") for _ in range(300)), "b": "".join(rng.choice("defghij ") for _ in range(300))}
    probes = ["".join(rng.choice("abcdefghijkl ") for _ in range(rng.randrange(1, 80))) for _ in range(60)]

    def count():
        model = langid.Model(text)
        sym = model.symbol[np.frombuffer("".join(probes).encode("utf-32-le"), np.uint32)]
        size = np.array([len(p) for p in probes])
        return model.phrases(sym, np.cumsum(size) - size, size).tolist()
    want = count()
    for own in (0, 1, 4):
        monkeypatch.setattr(langid, "OWN", own)
        monkeypatch.setattr(langid, "SYMBOLS", own + 1)
        assert count() == want, own

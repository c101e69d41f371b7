r"""Phrase mining against counting every phrase, and its defined cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callsheet.llm import phrases, tallies

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang][" ".join(w[i:i + k])] += 1
    out = {}
    for lang, f in counts.items():
        cand = {p: n for p, n in f.items() if n >= least and " " in p}
        got = []
        for p, a in cand.items():
            w = p.split(" ")
            score, k = min((2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * n >= 80 * a for q, n in cand.items()):
                continue
            got.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])], score))
        for rank, g in enumerate(sorted(got)[:top], 1):
            out[lang, rank] = (*g[3:7], total[lang], g[7])
    return out


def mined(df, **kw):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, **kw).collect()}


def texts(n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "city", "é", "漢字", "a", "b", "the", "of", "x-y", "ñ\x0b"]
    out = []
    for i in range(n):
        w = rng.choice(words, rng.integers(0, 40), p=np.array([6, 6, 4, 1, 1, 3, 3, 5, 5, 1, 1]) / 36)
        sep = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ; "], len(w), p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        out.append((i, "".join(a + b for a, b in zip(w, sep)), ["en", "de", None][i % 3]))
    return out


@pytest.mark.parametrize("trigger", [2, 32])
def test_equals_counting_every_phrase(spark, monkeypatch, trigger):
    rows = texts() + [(900, "New York city the of " * 300, "en"), (901, None, "en"), (902, "", None), (903, "a\tb " * 50, "und")] + texts(40)
    monkeypatch.setattr(phrases, "TRIGGER", trigger)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, top in ((5, 2000), (30, 7)):
        assert mined(df, least=least, top=top) == plain(rows, least, top)


def test_one_long_piece_clashing_columns_and_no_rows(spark):
    rows = [(1, "w " * 50_000, None), (2, "x" * 300_000, "en")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("phrase", "k", "n", "key", "bucket", "rank", "score")})
    got = mined(df)
    assert got["und", 1] == ("w w w w", 49_997, 50_000, 49_998, 50_000, 2_000_000 * 49_997 // (50_000 + 49_998)) and len(got) == 1
    assert mined(df.where("doc_id > 9")) == {}


def test_large_counts_are_exact(spark):
    """Products past 64 bits."""
    big = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, k int, f long")
    r = phrases.scored(counts).collect()
    assert [(x.phrase, x.score) for x in r] == [("a b", 2_000_000 * big // (2 * big + 1))]


def test_maps_and_flushes_do_not_change_counts(spark, monkeypatch):
    """Tiny buffers, a map of so few slots that nearly all bits are set."""
    rows = texts(120, 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, 5, 2000)
    monkeypatch.setattr(tallies, "FLUSH", 2_000)
    monkeypatch.setattr(phrases, "SLOTS", 1 << 15)
    assert mined(df, least=5) == want


def test_packed_longs_round_trip():
    a, b = np.array([0, -1, 2**62, 5]), np.array([1, 2, 3, -2**62])
    x, y = tallies._longs(tallies._planes(a, b), 4, 2)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()
    assert pa.compress(b"x", codec="zstd", asbytes=True)

"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callsheet.llm import decontam, graphs, jaccard, langid, mixing, ngram_lm, queries, rules, sharding, substring, toxicity
from callsheet.llm.words import ALNUM, LOWER, PLAIN, slices, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def plain(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_agree_with_regex():
    some = ["", "a", " a  b\tc\n", "É ü-x's 9z", None, "x" * 999 + " y", "漢字 😀", "a b", "tail"]
    for mask, fold, pattern in ((PLAIN, None, r"[^\x20\x09-\x0D]+"), (ALNUM, LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(some), mask, fold)
        low = (lambda s: re.sub("[A-Z]", lambda m: m.group().lower(), s)) if fold is not None else (lambda s: s)
        for d, s in enumerate(some):
            want = re.findall(pattern, low(s or ""))
            a, b = w.first[d], w.first[d + 1]
            assert w.joined(a, b).decode() == " ".join(want) and b - a == len(want)
        flat = [x for s in some for x in re.findall(pattern, low(s or ""))]
        hashes = collections.defaultdict(set)
        for x, h in zip(flat, w.hash.tolist()):
            hashes[x].add(h)
        assert all(len(v) == 1 for v in hashes.values()) and len({h for v in hashes.values() for h in v}) == len(hashes)


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "t": ["x" * n for n in (0, 5, 50, 3, 0, 0, 9, 100, 1)]})
    got = list(slices([batch], "t", 10))
    assert [i for b in got for i in b.column("i").to_pylist()] == list(range(9)) and len(got) > 3


def test_rule_counts(spark, texts):
    for r in queries.QUERIES["op1_quality_rules"](spark, SF).collect():
        w = plain(texts[r.doc_id])
        seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in texts[r.doc_id].split("\n") if plain(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[r.doc_id])), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_em_finds_the_bad_without_labels():
    rng = random.Random(1)
    patterns, truth = collections.Counter(), collections.defaultdict(collections.Counter)
    for _ in range(5000):
        good = rng.random() < 0.85
        fault = rng.randrange(3)
        p = tuple((1 if rng.random() < 0.95 else 0) if good or k != fault else -1 for k in range(3))
        patterns[p] += 1
        truth[p][good] += 1
    share, right = rules.estimate(dict(patterns))
    assert abs(share - 0.85) < 0.1
    for p, n in truth.items():
        assert (rules._logit(p, share, right) > 0) == (n[True] > n[False]), p


def test_rules_agree_with_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    assert got.where("kept <> (quality = 1)").count() <= 0.02 * got.count()


def test_mix_comes_near_its_targets(spark, docs):
    got = queries.QUERIES["op2_source_mixing"](spark, SF).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    for s, v in by.items():
        assert v[0].source_size == sizes[s] and v[0].target <= 2 * sizes[s] + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
        assert all(r.taken <= 2 * r["size"] for r in v)
    assert sum(v[0].target for v in by.values()) == pytest.approx(1.5 * sum(sizes.values()))
    # targets follow the weights wherever no cap holds
    weight = dict(zip(sorted(sizes), itertools.cycle((5, 2, 1))))
    free = [by[s][0].target / weight[s] for s in sizes if by[s][0].target < 2 * sizes[s] - 1e-3]
    assert max(free) == pytest.approx(min(free))


def test_mix_refines_to_single_rows_and_nests(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"),
                                  F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    few = {r.doc_id: r.copies for r in mixing.mix(df, share=0.4).collect()}
    more = {r.doc_id: r.copies for r in mixing.mix(df, share=0.9).collect()}
    assert all(more[i] >= few[i] for i in few)
    assert abs(sum(few.values()) - 0.4 * 5000) <= 8


def test_decontamination_in_blocks_is_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(str, decontam.decontaminate(docs, bench).select("doc_id", "hit_spans", "hit_items").collect()))
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 200)
    assert sorted(map(str, decontam.decontaminate(docs, bench).select("doc_id", "hit_spans", "hit_items").collect())) == whole


def brute_removed(texts, k=13):
    first = {}
    ws = {i: plain(t) for i, t in texts.items()}
    for i in sorted(ws):
        for p in range(len(ws[i]) - k + 1):
            first.setdefault(tuple(ws[i][p:p + k]), i)
    out = {}
    for i, w in ws.items():
        gone = {p + j for p in range(len(w) - k + 1) if first[tuple(w[p:p + k])] < i for j in range(k)}
        out[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    return out


@pytest.mark.parametrize("chunk", [24 << 20, 500])
def test_substring_over_slices_and_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring, "SLICE", 2_000)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(3)]
    texts = {}
    for i in range(300):
        own = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) for _ in range(2)]
        texts[i * 7 % 300] = "\n".join([own[0], rng.choice(shared), own[1]] if i % 3 == 0 else [own[0], shared[0]] if i % 3 == 1 else own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.kept_text for r in substring.remove_repeats(df).collect()}
    assert got == brute_removed(texts)


def test_equal_hashes_of_unequal_windows(monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda h, k, seed=1: np.zeros(max(0, len(h) - k + 1), np.uint64))
    w = words(pa.array(["a b c d", "a b c e", "x b c d"]), PLAIN)
    at, _, lost, _ = substring.settle(w, np.array([1, 2, 3]), 3)
    assert at[lost].tolist() == [4, 9]


def test_matrix_is_exact_and_uniform():
    counts = [5, 0, 17, 40, 1]
    for seed in range(5):
        m = np.array(sharding.communication_matrix(counts, 4, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).max() - m.sum(0).min() <= 1
    # the mean of a cell is row * column / total
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s) for s in range(400)], 0)
    assert np.allclose(mean, [[2.5] * 4, [7.5] * 4], atol=0.3)


def test_shards_hold_every_document(spark, docs, texts):
    import zlib
    got = queries.QUERIES["op5_sharding"](spark, SF).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items())
    n = collections.Counter(r["shard"] for r in got)
    assert set(n) == set(range(16)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s]))


def kneser_ney(trusted, everything):
    """Log perplexity of every text by the textbook formulas."""
    def grams(t):
        s = [0, 0, *map(ord, t), -1]
        return list(zip(s, s[1:], s[2:]))
    c3 = collections.Counter(g for t in trusted for g in grams(t))
    levels, c = [], c3
    for _ in range(3):
        levels.append((c, ngram_lm._discounts(collections.Counter(c.values()))))
        c = collections.Counter(g[1:] for g in c)
    symbols = len({g[2] for t in everything for g in grams(t)}) + 1
    stats = []
    for c, d in levels:
        total, left = collections.Counter(), collections.Counter()
        for g, n in c.items():
            total[g[:-1]] += n
            left[g[:-1]] += d[min(n, 3) - 1]
        stats.append((total, left))

    def p(g):
        if not g:
            return 1 / symbols
        (c, d), (total, left) = levels[3 - len(g)], stats[3 - len(g)]
        if not total[g[:-1]]:
            return p(g[1:])
        own = max(c[g] - d[min(c[g], 3) - 1], 0) if c[g] else 0
        return (own + left[g[:-1]] * p(g[1:])) / total[g[:-1]]
    return [-sum(math.log(p(g)) for g in grams(t)) / (len(t) + 1) for t in everything]


def test_perplexity_is_kneser_ney(spark, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    ids = [i for i in texts if texts[i]]
    want = dict(zip(ids, kneser_ney([texts[i] for i in ids if i in good], [texts[i] for i in ids])))
    got = ngram_lm.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.trusted == (r.id in good) and r.log_perplexity == pytest.approx(want[r.id], abs=2e-5)
    # the quantile: by language where enough are trusted, of all otherwise
    by = collections.defaultdict(list)
    for r in got:
        if r.trusted:
            by[r.lang].append(r.log_perplexity)
    every = sorted(x for v in by.values() for x in v)
    for r in got:
        own = sorted(by[r.lang]) if len(by[r.lang]) >= ngram_lm.MIN_TRUSTED else every
        edge = own[math.ceil(ngram_lm.QUANTILE * len(own)) - 1]
        assert edge <= r.threshold + 1e-9 < edge + 2e-4 and r.kept == (r.log_perplexity <= r.threshold)


def test_classifier_separates_junk(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op7_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 AND NOT kept").count() <= 0.01 * got.where("quality = 1").count()
    assert got.where("quality = 0 AND NOT kept").count() >= 0.7 * got.where("quality = 0").count()


def near_copies(rng, n_bases=12, copies=25):
    vocabulary = [f"v{i}" for i in range(400)]
    out = []
    for b in range(n_bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 150))]
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w + ["common"] * (b % 2)))
    rng.shuffle(out)
    return dict(enumerate(out))


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = plain(t.lower())
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent,block,long", [(3, 90, 2048, 64), (5, 80, 2048, 64), (3, 90, 7, 5), (1, 50, 2048, 64)])
def test_components_are_complete(spark, monkeypatch, n, percent, block, long):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LONG", long)
    texts = near_copies(random.Random(n * percent + block))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n, r.component) for r in jaccard.similar(df, n=n, percent=percent).collect()}
    assert got == brute_components(texts, n, percent)


def test_group_join_over_many_groups():
    rng = np.random.default_rng(3)
    base = [rng.choice(10**6, 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.r_[base[i % 6][rng.random(60) < 0.96], rng.choice(10**6, 2)]).astype(np.uint64) for i in range(120)]
    every = np.arange(len(sets))
    edges = jaccard.group_join(sets, every, every, 80, group=9)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        assert root(a) != root(b)  # a forest
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)
        up[root(a)] = root(b)
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            assert root(a) == root(b)


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(
        spark.createDataFrame([(1000, 1001), (1001, 1001)], "a long, b long"))
    got = {r.v: r.root for r in graphs.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    y = np.array([r.toxic for r in got])
    s = np.array([r.score for r in got])
    auc = ((s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])).mean()
    assert auc > 0.88
    assert all((r.score >= 0.5) == (r.predicted == 1) for r in got)


def test_kernel_tolerates_gaps_and_signs():
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "house", "green", "walks", "slowly", "under", "mild", "stars", "idle"]) for _ in range(40)) for _ in range(200)]
    toxic = [c.replace("green", "idiot", 1) + " moron" for c in clean[:100]]
    model = toxicity.fit([x for p in zip(toxic, clean[100:]) for x in p], [1, 0] * 100)
    score = lambda x: float(model.scores(pa.array([x]))[0])
    for x in ("idiot", "i-d-i-o-t", "i d i o t", "idioot", "1diot", "IDIOT!!", "morron"):
        assert score(f"the house {x} under") > 0.5, x
    assert score("the house under mild stars") < 0.5 and score("") < 0.5


def test_phrases_are_longest_matches():
    text = {"x": "abracadabra", "y": "banana bandana"}
    model = langid.Model(text)
    for probe in ("abra", "bananas and", "cadabracad", "zzz", "a"):
        sym = model.symbol[np.frombuffer(probe.encode("utf-32-le"), np.uint32)]
        got = model.phrases(sym, np.array([0]), np.array([len(probe)]))[0].tolist()
        for lang, n in zip(model.langs, got):
            known = "".join(chr(1 + c) for c in model.symbol[np.frombuffer(text[lang].encode("utf-32-le"), np.uint32)])
            rest, count = "".join(chr(1 + c) for c in sym), 0
            while rest:
                k = max((k for k in range(1, len(rest) + 1) if rest[:k] in known), default=1)
                rest, count = rest[k:], count + 1
            assert n == count, (probe, lang)


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_pipeline_against_brute_force(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.id: r.kept for r in ngram_lm.classify(docs, labels).collect()}
    kept = {i: t for i, t in texts.items() if verdict[i]}
    one = {i: t for i, t in kept.items() if brute_components(kept, 5, 80)[i][1] == i}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), t))
    windows = {tuple(w[p:p + min(10, len(w))]) for w in map(low, bench) for p in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(x) for x in windows}
    clean = {i for i, t in one.items() if not any(tuple(w[p:p + n]) in windows for w in [low(t)] for n in sizes for p in range(len(w) - n + 1))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= clean
    copies = collections.Counter(r.doc_id for r in got)
    want = {r.doc_id: r.copies for r in mixing.mix(docs.where(F.col("doc_id").isin(sorted(clean)))).collect() if r.copies}
    assert copies == want
    n = collections.Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n[s])) for s in n)

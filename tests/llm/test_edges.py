"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing
columns, through every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from callsheet.llm import (decontam, jaccard, langid, licences, mixing, ngram_lm, rules, sharding, substring,
                           toxicity)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns named like what the operators add, in other types and cases
CLASH = ["n_words", "Hit_Spans", "hit_items", "size", "source_size", "target", "copies", "shard", "slot", "removed",
         "kept_text", "votes", "kept", "posterior", "base_failed", "score", "lang_pred", "licences", "sentence_ids",
         "n_sentences", "_lost", "_part", "_at", "word_chars", "key", "id", "trusted"]
PROSE = "The quick brown fox jumps over the lazy dog and runs through the quiet forest until night falls again. "
LONG = " ".join(f"w{i}" for i in range(30_000))


def rows():
    out = [(1, PROSE * 4, "en", "b", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "de", "a", 4),
           (None, PROSE * 4, None, "b", 1), (5, LONG, "en", None, 9), (6, "x" * 200_000, None, "c", 1),
           (7, "two words", "en", "c", 9), (8, "ÄÖ ü né 漢字 😀 ŝ", "de", "ä", 3), (9, PROSE * 4 + "Tail words differ here.", "en", "a", 1)]
    return out + [out[0], out[0], out[1], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (99, 1, 1)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (None, "quiet forest until night falls again"),
                                  (4, "two words")], "item_id long, text string")


def test_quality_rules(docs, none):
    got = rules.quality(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    for i in (2, 3, 4):
        assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words) == (0, 0, 0) and by[i].base_failed and not by[i].kept
    assert by[5].n_words == 30_000 and not by[5].base_failed
    assert by[1].n_repeat_words == 76 and by[1].base_failed  # the same sentence four times over
    assert rules.quality(none).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r["copies"] <= 2
    # equal ids are taken alike; a null source is a source
    assert len({r["copies"] for r in got if r.doc_id == 1}) == 1
    assert {r["source_size"] for r in got if r.source is None} == {30_000}
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(mixing.mix(docs), ["doc_id"]).count() == sum(r["copies"] for r in got)


def test_decontamination(docs, none, benchmark):
    got = {r.doc_id: r for r in decontam.decontaminate(docs, benchmark).collect()}
    assert got[2].n_words == 0 and got[2].hit_items == []
    assert got[1].hit_items == ["1"] and got[7].hit_items == ["4"] and got[None].hit_items == ["1"]
    assert [tuple(s) for s in got[7].hit_spans] == [(0, 2)]
    assert decontam.decontaminate(docs, benchmark.where("false")).where("size(hit_spans) > 0").count() == 0
    assert decontam.decontaminate(none, benchmark).count() == 0
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, benchmark, remove="spans").collect()}
    assert 7 not in cut and 1 not in cut and cut[5] == LONG and "Tail words differ here." in cut[9] and "fox" not in cut[9]
    left = decontam.decontaminate(docs, benchmark, remove="documents")
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 6, 8}


def test_substring(docs, none):
    got = substring.remove_repeats(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        n = len((r.text or "").split())
        assert r.n_words == n
        if r.doc_id is None:  # larger than every id: all of it also stands in document 1
            assert r.kept_text == ""
        elif r.doc_id != 9:
            assert len(r.kept_text.split()) == n
    assert {r.kept_text for r in got if r.doc_id == 9} == {"Tail words differ here."}
    assert substring.remove_repeats(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, 4).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows())
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert sharding.shard(none, 4).count() == 0


def test_licences(docs, none, spark):
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert got[2].n_sentences == 0 and got[2].licences == [] and got[1].n_sentences == 4
    assert licences.scan(none).count() == 0
    names = licences.SENTENCES
    texts = {1: f"{names['bsd-redistribution']}\nCopyright X.\n{names['bsd-source']}. {names['bsd-binary']}; {names['bsd-endorse']}",
             2: f"{names['bsd-redistribution']}: {names['bsd-source']}\n{names['bsd-binary']}", 3: names["bsd-source"],
             4: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."}
    found = {r.i: r.licences for r in licences.scan(spark.createDataFrame(list(texts.items()), "i int, text string")).collect()}
    assert found == {1: ["BSD-3-Clause"], 2: ["BSD-2-Clause"], 3: [], 4: ["Apache-2.0", "MIT"]}


def test_classifier(docs, none, labels):
    got = ngram_lm.classify(docs, labels).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.log_perplexity is None) == (r.id in (2, 3)) and (r.log_perplexity is not None or not r.kept)
    assert {r.trusted for r in got if r.id == 1} == {True} and not any(r.trusted for r in got if r.id in (None, 5, 7))
    assert ngram_lm.classify(none, labels).count() == 0
    assert ngram_lm.classify(docs, labels.where("false")).where("kept").count() == len(rows()) - 3
    assert ngram_lm.keep_good(docs, labels).columns == docs.columns


def test_jaccard(docs, none):
    got = jaccard.similar(docs).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add((r.n, r.component))
    assert by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[7] == {(1, 7)}
    assert {c for _, c in by[1] | by[None]} == {1}  # equal texts, one without an id
    assert jaccard.similar(none).count() == 0
    one = jaccard.one_of_each(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in one} == {i: 2 if i == 2 else 1 for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)}


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train(none, labels).scores(__import__("pyarrow").array(["a b", None])).tolist() == pytest.approx([0.01, 0.01])


def test_language(docs, none):
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (2, 3, 4))
    assert {r.lang_pred for r in got if r.doc_id == 1} == {"en"} and {r.lang_pred for r in got if r.doc_id == 8} == {"de"}
    assert langid.identify(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_stages_on_an_empty_table(spark, none):
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, sf)
        assert got.count() == 0 and got.columns[:5] == corpus_pipeline.COLUMNS, name

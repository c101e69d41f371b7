"""Removal of repeated byte strings against comparing every window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callsheet.llm import suffixes as S

SCHEMA = "doc_id long, text string"


def plain(rows, width=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p:p + width]
            least[w] = min(least.get(w, S.LAST), S.LAST if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if least[b[p:p + width]] < (S.LAST if i is None else i):
                gone[p] += 1
                gone[p + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(int)))
        out.append((i is None, i or 0, len(b), [tuple(x) for x in spans.reshape(-1, 2).tolist()], b"".join(b[k:k + 1] for k in np.flatnonzero(~gone))))
    return sorted(out)


def removed(df, **kw):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, [tuple(s) for s in r.removed], bytes(r.kept_bytes)) for r in S.remove_repeats(df, **kw).collect())


def rows(n=120, seed=3):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(30, 200))) for _ in range(25)]
    out = []
    for i in range(n):
        parts = [rng.choice(base)[rng.randint(0, 20):] for _ in range(rng.randint(0, 4))] + ["".join(rng.choice("ab漢c") for _ in range(rng.randint(0, 90)))]
        out.append((rng.randint(0, 80), "".join(parts)))
    return out + [(None, base[0] * 2), (None, base[1] + "tail"), (1, None), (2, ""), (3, "x" * 49), (4, "x" * 3_000), (77, "y" + "x" * 400), out[0], out[0],
                  (90, base[2] + "\0" + base[3]), (91, "\0" + base[3])]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    return df.withColumns({c: F.lit("clash") for c in ("n_bytes", "REMOVED", "kept_bytes", "_lost", "_id", "_hash", "lost", "hash", "bucket")})


def test_equals_comparing_every_window(docs):
    assert removed(docs) == plain(rows())


def test_tiny_buckets_parts_and_shards(docs, monkeypatch):
    """Every bound is passed: buckets give up equal strings, one minimiser fills several parts, strings and shards are cut."""
    for name, value in (("SLICE", 2_000), ("GATHER", 4_000), ("SHARD", 700), ("LONGEST", 60)):
        monkeypatch.setattr(S, name, value)
    assert removed(docs, bucket=5_000, part=1_500, chunk=3_000) == plain(rows())
    assert removed(docs, bucket=1 << 30, part=300, chunk=1_000) == plain(rows())


def test_one_passage_in_very_many_texts(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    got = [(i, f"{i:05d}" + passage + "".join(rng.choice("xyz") for _ in range(20))) for i in range(1_500)]
    assert removed(spark.createDataFrame(got, SCHEMA).repartition(6), part=20_000) == plain(got)


def test_no_rows(spark):
    assert removed(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("shard", [100, 900, 10_000])
def test_merged_blocks_are_the_equal_windows(shard):
    rng = np.random.default_rng(shard)
    x = rng.integers(97, 99, 5_000).astype(np.uint8)
    x[2_000:2_300] = x[100:400]
    shards = [S.Shard.of(np.concatenate((x[i:i + shard], np.zeros(64, np.uint8)))) for i in range(0, len(x), shard)]
    of, block = S.merge(shards)
    place = np.empty(len(of), np.int64)
    place[np.argsort(of, kind="stable")] = np.concatenate([s.order for s in shards])
    seen = {}
    for s, p, b in zip(of.tolist(), place.tolist(), block.tolist()):
        text = x[s * shard:(s + 1) * shard].tobytes()
        if p + 50 <= len(text):
            assert seen.setdefault(b, text[p:p + 50]) == text[p:p + 50]
    assert len(set(seen.values())) == len(seen)
    assert list(seen.values()) == sorted(seen.values())


def test_ranges_travel_by_receiver_not_by_document_and_bucket():
    """Every document loses a range in nearly every bucket; a task sends at
    most one row to each receiver."""
    import pyarrow as pa
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(70))
    passages = [word() for _ in range(40)]
    docs = [" ".join(x for p in rng.sample(passages, 40) for x in (p, word())) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(range(100, 160), pa.int64()), pa.array(docs)], ["id", "hash", "text"])
    sent = pa.Table.from_batches(list(S._send(32, 50)(iter([batch])))).sort_by("bucket").combine_chunks().to_batches()
    made = list(S._settle(50, S.PART, S.CHUNK, 4)(iter(sent)))
    assert sum(b.num_rows for b in made) <= 4
    by = pa.Table.from_batches(made).sort_by("to").combine_chunks().to_batches()
    got = [r for b in S._gather(iter(by)) for r in b.to_pylist()]
    assert len(got) == len({r["id"] for r in got}) == 59
    want = {i: spans for _, i, _, spans, _ in plain(list(enumerate(docs)))}
    for r in got:
        covered = {x for s in r["lost"] for x in range(s >> 32, s & 0xFFFFFFFF)}
        assert r["hash"] == r["id"] + 100
        assert covered == {x for a, b in want[r["id"]] for x in range(a, b)}

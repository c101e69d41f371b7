"""Ward trees against plain Ward linkage, and independence of partitions."""

import numpy as np
import pytest

from callsheet.operators import ward as W


def plain(x):
    """All merge heights by trying every pair."""
    groups = [[i] for i in range(len(x))]
    out = []
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i):
                a, b = x[groups[i]], x[groups[j]]
                h = np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(a.mean(0) - b.mean(0))
                if best is None or h < best[0]:
                    best = h, i, j
        h, i, j = best
        groups[j] += groups.pop(i)
        out.append((h, sorted(map(sorted, groups))))
    return out


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def test_equals_plain_ward_when_every_row_is_a_feature(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(20, 3)) + c for c in (0, 4, 9)])
    want = plain(x)
    df = frame(spark, x)
    tree = W.ward(df, "id", "v", limit=100, slices=8)
    assert np.allclose([m[2] for m in tree.merges], [h for h, _ in want])
    for k in (2, 3, 5):
        height = (want[-k][0] + want[-k + 1][0]) / 2
        labels = tree.cut(height=height)
        assert labels.max() + 1 == k and np.array_equal(labels, tree.cut(k=k))
        got = {}
        for r in tree.assign(df, "v", labels).collect():
            got.setdefault(r.cluster, []).append(r.id)
        assert sorted(map(sorted, got.values())) == want[-k][1]
    t = tree.table(df.sparkSession, top=2).collect()
    assert [r["merge"] for r in t] == [58, 59] and t[1]["size"] == 60 and t[1]["gap"] is None


def test_features_keep_the_clusters_and_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(n, 2)) * 0.5 + c for n, c in ((900, 0), (500, 6), (100, 12))])
    trees = [W.ward(frame(spark, x, parts), "id", "v", limit=40, slices=8) for parts in (1, 7)]
    assert len(trees[0].n) <= 40 and trees[0].n.sum() == 1500
    assert [m[2] for m in trees[0].merges] == [m[2] for m in trees[1].merges]
    rows = {r.id: r.cluster for r in trees[0].assign(frame(spark, x), "v", trees[0].cut(k=3)).collect()}
    assert {rows[i] for i in range(900)} == {0} and {rows[i] for i in range(900, 1400)} == {1} and {rows[i] for i in range(1400, 1500)} == {2}


def test_repeated_missing_and_no_rows(spark):
    df = frame(spark, np.array([[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 3)).union(spark.createDataFrame([(9, None)], "id long, v array<double>"))
    tree = W.ward(df, "id", "v")
    assert sorted(tree.n) == [3, 5] and tree.merges[0][2] == pytest.approx(np.sqrt(2 * 15 / 8 * 2))
    assert {r.id: r.cluster for r in tree.assign(df, "v", tree.cut(k=2)).collect()}[9] is None
    assert W.ward(df.where("id > 9"), "id", "v").merges == []

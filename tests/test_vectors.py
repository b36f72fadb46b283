"""Vector operators, box merging, block-wise ranks, chunks and text grams against NumPy and plain windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(3).normal(size=(120, 5)) + np.repeat(np.eye(5)[:3] * 6, 40, axis=0)
    rows = [(i, [float(v) for v in p], i // 40) for i, p in enumerate(x)] + [(500, None, 1), (501, None, None)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(3)


def test_moments_and_axes(points):
    from lexiloom.operators import vectors

    x, df = points
    n, s, gram, cross = vectors.moments(df, "v", ["label"])
    y = np.repeat(np.arange(3.0), 40)
    assert n == 120 and np.allclose(s, x.sum(0)) and np.allclose(gram, x.T @ x) and np.allclose(cross[:, 0], x.T @ y)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(vectors.variance_fractions(df, "v"), want / want.sum())
    assert vectors.variance_fractions(df.where("id > 499"), "v").size == 0


def test_kmeans(points):
    from lexiloom.operators import vectors

    x, df = points
    at = [0]
    while len(at) < 3:
        d = ((x[:, None] - x[at][None]) ** 2).sum(2).min(1)
        at.append(int(d.argmax()))
    centres = x[at]
    for _ in range(5):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[label == i].mean(0) for i in range(3)])
    got, table = vectors.kmeans(df, "id", "v", 3)
    assert np.allclose(got, centres)
    found = {r["id"]: r["cluster"] for r in table.collect()}
    assert [found[i] for i in range(120)] == ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1).tolist() and len(found) == 120
    assert vectors.kmeans(df.where("id > 499"), "id", "v", 3)[0] == []


def test_kmeans_goes_on_until_it_is_settled(spark, monkeypatch):
    from lexiloom.operators import vectors

    x = np.sort(np.random.default_rng(1).pareto(0.6, 30_000))[:, None]  # settles after some 300 rounds
    centres = np.array([x[0], x[-1], x[abs(x - x[-1]).ravel() >= 0][0]])
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x[:, 0])] + [(-1, [float("nan")]), (-2, [None]), (-3, [1.0, 2.0])], "id long, v array<double>").where("id <> -3")
    centres, before, rounds = np.array(vectors.farthest_first(df, "id", "v", 3)), None, 0
    while before is None or (at != before).any():
        before = None if not rounds else at
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        if before is None or (at != before).any():
            centres, rounds = np.array([x[at == i].mean(0) for i in range(3)]), rounds + 1
    monkeypatch.setattr(vectors, "NEAR_ROWS", 2000)
    got, table = vectors.kmeans(df, "id", "v", 3)
    assert np.allclose(got, centres) and table.where("id < 0").count() == 0
    assert [r["cluster"] for r in table.orderBy("id").collect()] == at.tolist()
    with pytest.raises(RuntimeError):
        vectors.kmeans(df, "id", "v", 3, 2)


def test_kmeans_hands_over_a_bounded_number_of_rows(spark, monkeypatch):
    """However wide the bound guessed from earlier centres is, and though many rows have one margin."""
    from lexiloom.operators import vectors

    x = np.r_[np.random.default_rng(2).normal(size=4000), np.full(900, 0.25)][:, None]
    df = spark.createDataFrame([([float(v)],) for v in x[:, 0]], "v_ array<double>").repartition(3)
    monkeypatch.setattr(vectors, "NEAR_ROWS", 300)
    centres = np.array([[-1.0], [1.0]])
    at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    want = np.array([[(at == i).sum(), x[at == i].sum()] for i in range(2)])
    for guess in (0.0, 0.1, 1.0, np.inf):
        firm, near, steps, bound = vectors._scan(df, centres, guess)
        assert len(near) <= 300 and bound <= guess and steps.sum() == len(x)
        assert np.allclose(firm + vectors._sums(near, vectors._places(near, centres)[0], 2), want)
        assert (vectors._places(near, centres)[1] <= guess).all() and (bound < 0.5 or guess < 0.5)
    same = df.where("v_[0] = 0.25")
    assert len(vectors._scan(same, centres, np.inf)[1]) == 0  # one margin for all of them
    assert vectors.kmeans(same.selectExpr("v_", "monotonically_increasing_id() as id"), "id", "v_", 2)[0] == [[0.25]]


def test_ridge(points):
    from lexiloom.operators import vectors

    x, df = points
    labels, w = vectors.ridge_one_vs_rest(df, "v", "label", 2.0)
    onehot = np.eye(3)[np.repeat(np.arange(3), 40)]
    want = np.linalg.solve(x.T @ x + 2 * np.eye(5), x.T @ onehot)
    assert labels == [0, 1, 2] and np.allclose(w, want)
    got = {r["id"]: r["predicted"] for r in vectors.ridge_predict(df.where("v is not null"), "id", "v", labels, w).collect()}
    assert [got[i] for i in range(120)] == (x @ want).argmax(1).tolist()


def test_merge_boxes(spark):
    from lexiloom.operators import vectors

    boxes = [("a", 0, 0, 10, 10), ("a", 1, 1, 4, 4), ("a", 5, 5, 15, 15), ("a", 20, 20, 22, 22), ("b", 0, 0, 1, 1), ("b", 3, 3, 3, 9), ("b", None, 0, 1, 1)]
    got = vectors.merge_boxes(spark.createDataFrame(boxes, "page string, x0 int, y0 int, x1 int, y1 int"), "page").collect()
    assert sorted(map(tuple, got)) == [("a", 0.0, 0.0, 10.0, 10.0, 2), ("a", 5.0, 5.0, 15.0, 15.0, 1), ("a", 20.0, 20.0, 22.0, 22.0, 1), ("b", 0.0, 0.0, 1.0, 1.0, 1)]


def test_ranks(spark):
    from lexiloom.operators.sequence import ranks

    rows = [(None if i % 5 == 0 else "hot" if i % 5 < 4 else "x", (i * 37) % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = ranks(df, ["g"], F.floor(F.col("k") / 8), ["k"]).withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.count() == 101 and got.where("rank <> want").count() == 0
    assert ranks(df.limit(0), ["g"], F.floor(F.col("k") / 8), ["k"]).count() == 0


def test_permutation_of_null_strata(spark):
    from lexiloom.operators.nulls import permute_within

    df = spark.createDataFrame([(i, i * 10, None if i < 4 else "s") for i in range(9)], "k long, v long, s string")
    got = permute_within(df, "k", "v", ["s"], 2, "p").collect()
    assert len(got) == 18
    for rep in (0, 1):
        for s in (None, "s"):
            part = [r for r in got if r["rep"] == rep and r["s"] == s]
            assert sorted(r["v"] for r in part) == sorted(r["permuted"] for r in part)


@pytest.mark.parametrize("padded", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_text_grams(spark, n, padded):
    from collections import Counter

    from lexiloom.operators.tokens import text_grams

    texts = ["A b\nccc d", "", None, "x", "ab", "a b c d", "1 2", "été Où a"]
    want = Counter()
    for x in texts:
        words = [w for w in "".join(c if c.isalpha() else " " for c in (x or "").lower()).split(" ") if w]
        s = " ".join(words)
        s = f" {s} " if padded and words else s
        want.update(s[i : i + n] for i in range(len(s) - n + 1))
    got = {r["g"]: r["c"] for r in text_grams(spark.createDataFrame([(x, "l") for x in texts], "text string, lang string"), ["lang"], n, padded).where(F.length("g") == n).collect()}
    want.pop(" ", None), got.pop(" ", None)
    assert got == dict(want)


def test_reflow_and_chunks(spark):
    from lexiloom.operators.generate import reflow
    from lexiloom.operators.sequence import equal_chunks

    lines = spark.createDataFrame([(d, p, "old") for d in (3, 1, 70) for p in range(4)], "doc long, pos int, word string").repartition(3)
    stream = spark.createDataFrame([(i, f"w{i}") for i in range(10)], "i long, word string")
    got = {(r["doc"], r["pos"]): r["word"] for r in reflow(lines, stream, ["doc", "pos"], F.floor(F.col("doc") / 64)).collect()}
    assert got == {key: f"w{i}" for i, key in enumerate(sorted((d, p) for d in (3, 1, 70) for p in range(4))) if i < 10}
    rows = spark.createDataFrame([(None if i % 3 else "s", i) for i in range(34)], "g string, k long")
    cut = equal_chunks(rows, ["g"], "k", 5, F.floor(F.col("k") / 7)).collect()
    for g, n in (("s", 12), (None, 22)):
        part = sorted((r["k"], r["chunk"]) for r in cut if r["g"] == g)
        assert [c for _, c in part] == [c for c in range(5) for _ in range(n // 5)]


def test_average_ranks(spark):
    from lexiloom.operators.sequence import average_ranks

    rows = [("hot" if i % 4 else None, None if i % 11 == 0 else (i * 7919) % 30 * 1000 - 9000) for i in range(90)]
    got = average_ranks(spark.createDataFrame(rows, "g string, v long"), ["g"], "v").collect()
    assert len(got) == 90
    for g in ("hot", None):
        values = [v for a, v in rows if a == g]
        size = lambda v: float("-inf") if v is None else v
        low = lambda v: sum(size(u) < size(v) for u in values)
        for r in got:
            if r["g"] == g:
                assert r["rank"] == low(r["v"]) + (values.count(r["v"]) - 1) / 2

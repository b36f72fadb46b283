"""Rasters, balanced clusters, kernel regression and copying streams against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F


def pixels(spark, masks):
    rows = []
    for k, m in enumerate(masks):
        v = [10 if x else 200 for x in np.asarray(m).ravel()]
        rows.append((k, int(np.asarray(m).shape[1]), v, v, v))
    return spark.createDataFrame(rows, "k int, width int, r array<int>, g array<int>, b array<int>")


def test_measures_and_components(spark):
    from lexiloom.operators import raster

    rng = np.random.default_rng(2)
    masks = [rng.random((8, 12)) < 0.3 for _ in range(6)] + [np.zeros((8, 12), bool)]
    m = raster.projections(raster.grid_density(raster.page_shares(raster.ink_mask(pixels(spark, masks))), 4))
    for r in m.collect():
        mask = masks[r["k"]].astype(int)
        assert r["ink"] == mask.ravel().tolist()
        edges = np.abs(np.diff(mask, axis=0)).sum() + np.abs(np.diff(mask, axis=1)).sum()
        assert r["edge_per_ink"] == pytest.approx(edges / max(1, mask.sum())) and r["ink_share"] == pytest.approx(mask.mean())
        assert r["grid"] == pytest.approx([mask[2 * y : 2 * y + 2, 3 * x : 3 * x + 3].mean() for y in range(4) for x in range(4)])
        assert r["row_share"] == pytest.approx(mask.mean(axis=1).tolist()) and r["column_share"] == pytest.approx(mask.mean(axis=0).tolist())

    def flood(mask):
        left, sizes = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
        while left:
            stack, n = [left.pop()], 0
            while stack:
                y, x = stack.pop()
                n += 1
                for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if p in left:
                        left.remove(p)
                        stack.append(p)
            sizes.append(n)
        return sorted(sizes)

    found = raster.components(m, "k").groupBy("k").agg(F.sort_array(F.collect_list("area")).alias("a")).collect()
    assert {r["k"]: r["a"] for r in found} == {k: flood(x) for k, x in enumerate(masks) if x.any()}
    big = raster.components(m, "k", 3, 4).collect()
    assert all(r["area"] >= 3 and r["y1"] - r["y0"] <= 4 for r in big)
    d = {r["k"]: dict(zip(raster.DESCRIPTORS, r["descriptors"], strict=True)) for r in raster.patch_descriptors(m, "k").collect()}
    for k, x in enumerate(masks):
        assert d[k]["components"] == len(flood(x)) and d[k]["ink"] == pytest.approx(x.mean()) and d[k]["largest"] == pytest.approx(max(flood(x), default=0) / x.size)


def test_balanced_clusters(spark):
    from lexiloom.operators import vectors

    rng = np.random.default_rng(5)
    x = rng.standard_normal((23, 3))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    centres = [x[0].tolist(), x[1].tolist(), (x[0] + 0.1).tolist()]
    got = {r["id"]: r["cluster"] for r in vectors.balanced_assignment(rows, "id", "v", centres).collect()}
    assert len(got) == 23 and max(np.bincount(list(got.values()))) <= 8
    d = ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).round(9)
    for i in range(23):  # nobody and a centre would both rather have each other
        for c in range(3):
            mine = [j for j in got if got[j] == c]
            if (d[i, c], c) < (d[i, got[i]], got[i]):
                assert len(mine) == 8 and max((d[j, c], j) for j in mine) < (d[i, c], i)
    with pytest.raises(ValueError, match="cannot take"):
        vectors.balanced_assignment(rows, "id", "v", centres, 2)
    centres, clusters = vectors.kmeans(rows, "id", "v", 3)
    of = {r["id"]: r["cluster"] for r in clusters.collect()}
    for c in range(3):  # settled: centres are means, rows are at the nearest
        mine = [i for i in of if of[i] == c]
        assert np.allclose(centres[c], x[mine].mean(axis=0))
    assert all(((x[i] - np.array(centres)) ** 2).sum(axis=1).argmin() == of[i] for i in of)


def test_kernel_ridge(spark):
    from lexiloom.operators import vectors

    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    rows = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(99, None, 1.0)], "id long, v array<double>, y double")
    known, w = vectors.kernel_ridge(rows, "v", "y", 0.8, 0.01)
    got = {r["id"]: r["predicted"] for r in vectors.kernel_ridge_predict(rows, "id", "v", known, w, float(y.mean()), 0.8).collect()}
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 0.64))
    want = y.mean() + k @ np.linalg.solve(k + 0.01 * np.eye(30), y - y.mean())
    assert [got[i] for i in range(30)] == pytest.approx(want.tolist()) and 99 not in got
    with pytest.raises(ValueError, match="bounded"):
        vectors.kernel_ridge(rows, "v", "y", 1.0, 1.0, most=10)


def test_copied_words(spark):
    from lexiloom.operators.generate import copied_words

    fresh = spark.range(400).selectExpr("cast(id % 2 as int) rep", "id div 2 as i", "concat('w', id, 'x') as word")
    got = {(r["rep"], r["i"]): (r["word"], r["source"]) for r in copied_words(fresh, "s", 0.5, 10, 0.4).collect()}
    unit = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:8], 16) / 4294967296.0
    for rep in (0, 1):
        out = []
        for i in range(200):
            if i and unit("s", "copy", rep, i) < 0.5:
                source = i - 1 - int(unit("s", "back", rep, i) * min(10, i))
                w = out[source]
                if unit("s", "mutate", rep, i) < 0.4 and len(w) > 1:
                    at = int(unit("s", "place", rep, i) * len(w))
                    w = w[:at] + "abcdefghijklmnopqrstuvwxyz"[int(unit("s", "letter", rep, i) * 26)] + w[at + 1 :]
            else:
                source, w = None, f"w{2 * i + rep}x"
            out.append(w)
            assert got[rep, i] == (w, source)


def test_merged_boxes_grow_within_limits(spark):
    from lexiloom.operators.vectors import merge_boxes

    rows = [(1, 0.0, 0.0, 10.0, 10.0, 3, 0.5), (1, 1.0, 1.0, 11.0, 11.0, 2, 0.9), (1, 0.0, 0.0, 100.0, 10.0, 1, 0.9), (1, 50.0, 50.0, 60.0, 60.0, 1, 0.1), (2, 0.0, 0.0, 0.0, 5.0, 9, 9.0)]
    boxes = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double, priority int, score double")
    got = sorted(tuple(r)[1:] for r in merge_boxes(boxes, "page").collect())
    assert got == [(0.0, 0.0, 11.0, 11.0, 3), (50.0, 50.0, 60.0, 60.0, 1)]

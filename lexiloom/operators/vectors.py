"""Vectors: moments, principal axes, ridge classifiers, k-means. Tasks return sums of a size set by the dimension, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as float64, and their places; null rows, rows with null entries and rows of another length than the first go."""
    rows = column.to_pylist()
    dim = next((len(r) for r in rows if r), 0)
    at = [i for i, r in enumerate(rows) if r and len(r) == dim and None not in r]
    return np.array([rows[i] for i in at], np.float64).reshape(len(at), dim), np.array(at, np.int64)


def moments(rows: DataFrame, vector: str, targets: list[str] = ()) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, sums, Gram matrix, products with the numeric columns `targets`) in one pass; partial sums are added as (cell, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x, at = _matrix(b.column(0))
            if not len(x):
                continue
            y = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False)[at].astype(np.float64) for i in range(len(targets))], 1) if targets else np.zeros((len(x), 0))
            part = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), (x.T @ y).ravel()])
            dim = x.shape[1]
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), dim)), pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "cell", "value"])

    parts = rows.select(F.col(vector).cast("array<double>"), *targets).where(F.col(vector).isNotNull()).mapInArrow(run, "dim long, cell long, value double")
    out = parts.groupBy("dim", "cell").agg(F.sum("value").alias("value")).orderBy("cell").toPandas()
    if out.empty:
        return 0, np.zeros(0), np.zeros((0, 0)), np.zeros((0, len(targets)))
    if out["dim"].nunique() > 1:
        raise ValueError("vectors of different lengths")
    d, v = int(out["dim"].iloc[0]), out["value"].to_numpy()
    return int(v[0]), v[1 : 1 + d], v[1 + d : 1 + d + d * d].reshape(d, d), v[1 + d + d * d :].reshape(d, len(targets))


def variance_fractions(rows: DataFrame, vector: str) -> np.ndarray:
    """Shares of the variance along the principal axes, largest first."""
    n, s, gram, _ = moments(rows, vector)
    if n == 0:
        return np.zeros(0)
    values = np.clip(np.linalg.eigvalsh(gram / n - np.outer(s, s) / n**2)[::-1], 0, None)
    return values / values.sum() if values.sum() > 0 else values


def ridge_one_vs_rest(rows: DataFrame, vector: str, label: str, penalty: float = 1.0) -> tuple[list, np.ndarray]:
    """(labels, weights): a ridge regression of each label's indicator; labels are few. Null labels take no part."""
    rows = rows.where(F.col(label).isNotNull())
    labels = sorted(r[0] for r in rows.select(label).distinct().collect())
    marked = rows.select(vector, *[(F.col(label) == F.lit(v)).cast("double").alias(f"y{i}") for i, v in enumerate(labels)])
    n, _, gram, cross = moments(marked, vector, [f"y{i}" for i in range(len(labels))])
    return labels, np.linalg.solve(gram + penalty * np.eye(len(gram)), cross) if n else cross


def ridge_predict(rows: DataFrame, key: str, vector: str, labels: list, weights: np.ndarray) -> DataFrame:
    """(key, predicted): place of the largest score among the labels; the first one on ties."""
    w = F.lit([[float(x) for x in c] for c in weights.T])
    score = F.transform(w, lambda c: F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    at = F.array_position(score, F.array_max(score)).cast("int")
    return rows.select(key, F.element_at(F.lit(labels), at).alias("predicted"))


def whole(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows whose vector has only finite components, as many as that of the smallest key."""
    finite = (F.array_max(vector) < F.lit(float("inf"))) & (F.array_min(vector) > F.lit(float("-inf"))) & (F.size(F.array_compact(vector)) == F.size(vector))
    good = rows.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    first = good.select(key, F.size(vector).alias("d_")).orderBy(key).limit(1).collect()
    return good.where(F.size(vector) == first[0]["d_"]) if first else good


def farthest_first(rows: DataFrame, key: str, vector: str, k: int) -> list[list[float]]:
    """k starting centres: the vector of the smallest key, then each time the one farthest from all before; ties to the smaller key."""
    v = whole(rows, key, vector).select(F.col(key).alias("k_"), F.col(vector).alias("v_"))
    first = v.orderBy("k_").limit(1).collect()
    centres = [[float(x) for x in r["v_"]] for r in first]
    while centres and len(centres) < k:
        given = np.array(centres)

        def run(batches: Iterator[pa.RecordBatch], given: np.ndarray = given) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _unfolded(b.column(1), given.shape[1])
                d = np.min([((x - c) ** 2).sum(1) for c in given], 0)
                own = b.filter(pa.array(d == d.max(initial=0.0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, d.max(initial=0.0))), own.column(0), own.column(1)], names=["d", "k_", "v_"])

        far = v.mapInArrow(run, f"d double, k_ {v.schema['k_'].dataType.simpleString()}, v_ {v.schema['v_'].dataType.simpleString()}")
        top = far.agg(F.max(F.struct("d", (-F.col("k_")).alias("k"), "v_")).alias("s")).first()["s"]
        if top["d"] <= 0:
            break
        centres.append([float(x) for x in top["v_"]])
    return centres


def nearest(vector, centres: list[list[float]]):
    """Struct (d, i): squared distance and place (from 0) of the nearest centre; the first one on ties."""
    one = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.array_min(F.transform(F.lit([[float(x) for x in c] for c in centres]), lambda c, i: F.struct(one(c).alias("d"), i.alias("i"))))


def _places(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre, the first one on ties, and how much farther the next one is."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    at = d.argmin(1)
    near = np.sqrt(np.partition(d, 1, axis=1)[:, :2]) if len(centres) > 1 else np.stack([np.zeros(len(x)), np.full(len(x), np.inf)], 1)
    return at, near[:, 1] - near[:, 0]


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of each centre the number of its rows and their sum."""
    out = np.zeros((k, 1 + x.shape[1]))
    for i in range(k):
        own = x[at == i]
        out[i] = [len(own), *own.sum(0)]
    return out


def _unfolded(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: Margins are counted in so many steps of the logarithm, an eighth of a power of two each; the last step is 16 and more.
STEPS = 256


#: Rows near a limit between clusters that the driver goes on with between two passes, at most.
NEAR_ROWS = 50_000


def _scan(v: DataFrame, centres: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One pass: sums of the rows whose next centre is farther by more than a bound, the vectors of the others, counts of the margins by STEPS, and that bound.

    `bound` is a guess from margins of earlier centres and may be far too wide for these. A task hands over its part of
    NEAR_ROWS at most: one that finds more lowers the bound for itself, adds up what lies beyond, and the least bound of
    all tasks is returned. It is negative where a task has more rows of one margin than that, and hands over none of them.
    """
    k, dim = centres.shape
    most = max(1, NEAR_ROWS // max(1, v.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps, own = np.zeros((k, 1 + dim)), np.zeros(STEPS), bound
        held, margins, places = np.zeros((0, dim)), np.zeros(0), np.zeros(0, np.int64)
        for b in batches:
            x = _unfolded(b.column(0), dim)
            at, margin = _places(x, centres)
            steps += np.bincount(np.clip(8 * np.log2(np.maximum(margin, 1e-300)) + STEPS - 33, 0, STEPS - 1).astype(np.int64), minlength=STEPS)
            firm = margin > own
            total += _sums(x[firm], at[firm], k)
            held, margins, places = np.concatenate([held, x[~firm]]), np.r_[margins, margin[~firm]], np.r_[places, at[~firm]]
            if len(held) > most:
                edge = np.partition(margins, most)[most]  # rows of this margin and more go
                below = margins[margins < edge]
                own = float(below.max()) if len(below) else -1.0
                firm = margins > own
                total += _sums(held[firm], places[firm], k)
                held, margins, places = held[~firm], margins[~firm], places[~firm]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(held), np.int32)), pa.array(list(held), pa.list_(pa.float64()))], names=["kind", "x"])
        yield pa.RecordBatch.from_arrays([pa.array([0, 2, 3], pa.int32()), pa.array([total.ravel(), steps, np.array([own])], pa.list_(pa.float64()))], names=["kind", "x"])

    out = v.select("v_").mapInArrow(run, "kind int, x array<double>").toArrow()
    kind = out["kind"].to_numpy()
    of = lambda n, width: _unfolded(out["x"].filter(pa.array(kind == n)).combine_chunks(), width)
    return of(0, k * (1 + dim)).sum(0).reshape(k, 1 + dim), of(1, dim), of(2, STEPS).sum(0), float(of(3, 1).min(initial=bound))


def kmeans(rows: DataFrame, key: str, vector: str, k: int, most_rounds: int | None = None) -> tuple[list[list[float]], DataFrame]:
    """(centres, table of key and cluster): Lloyd's rounds from farthest-first centres until no row changes its cluster; an empty cluster keeps its centre.

    Rows without a whole vector go (`whole`). RuntimeError if `most_rounds` rounds, where given, do not settle it.

    A row changes its cluster only once the centres have moved by its margin, the difference of its distances from the
    two nearest ones. A pass adds up the rows of large margins and hands the others, NEAR_ROWS of them at most, to the
    driver, which goes on with these alone until the centres have moved by the least margin of the rows added up. All
    rounds are those of Lloyd, but only early ones, which move far, take a pass each.
    """
    start = farthest_first(rows, key, vector, k)
    v = whole(rows, key, vector).select(key, F.col(vector).alias("v_"))
    if not start:
        return [], v.select(key, F.lit(None).cast("int").alias("cluster"))
    centres, bound, turn, settled = np.array(start, np.float64), 0.0, 0, False
    if len(start) == 1:
        bound = np.inf
    while not settled:
        given = centres.copy()
        firm, near, steps, bound = _scan(v, given, bound)
        before = None
        while True:
            at, _ = _places(near, centres) if len(near) else (np.zeros(0, np.int64), None)
            if before is not None and (at == before).all():
                settled = True
                break
            if most_rounds is not None and turn >= most_rounds:
                raise RuntimeError(f"clusters have not settled after {most_rounds} rounds")
            sums = firm + _sums(near, at, len(centres))
            old, before, turn = centres, at, turn + 1
            centres = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), centres)
            moved = np.sort(np.sqrt(((centres - given) ** 2).sum(1)))[-2:].sum()
            if (centres == old).all():
                settled = True
                break
            if moved >= bound * (1 - 1e-9):
                break
        # the widest bound that leaves at most NEAR_ROWS rows below it
        within = int((np.cumsum(steps) <= NEAR_ROWS).sum())
        bound = np.inf if within == STEPS else 2.0 ** ((within - STEPS + 33) / 8) if within else 0.0
    names, kind = v.schema[key], centres

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _ = _places(_unfolded(b.column(1), kind.shape[1]), kind)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32))], names=[key, "cluster"])

    return centres.tolist(), v.mapInArrow(label, f"`{key}` {names.dataType.simpleString()}, cluster int")


def balanced_assignment(rows: DataFrame, key: str, vector: str, centres: list[list[float]], capacity: int | None = None) -> DataFrame:
    """(key, cluster): rows dealt to centres that take `capacity` rows each (an even share if not given), nearest pairs first.

    Rows ask their centres in order of distance, and a centre keeps the nearest of all that have ever asked it, ties to
    the smaller key: rounds of one ranking each, until nobody is turned away. A centre's ranking is numbered in
    stretches of the distance (`sequence.ranks`). ValueError if the centres cannot take all rows.
    """
    from lexiloom.operators.sequence import ranks

    v = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("k_"), F.col(vector).cast("array<double>").alias("v_"))
    n = v.count()
    room = -(-n // len(centres)) if capacity is None else capacity
    if room * len(centres) < n:
        raise ValueError(f"{len(centres)} centres of {room} rows cannot take {n}")
    one = lambda c: F.aggregate(F.zip_with("v_", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    wish = F.array_sort(F.transform(F.lit([[float(x) for x in c] for c in centres]), lambda c, i: F.struct(F.round(one(c), 9).alias("d"), i.alias("c"))))
    at = v.select("k_", wish.alias("w_"), F.lit(0).alias("i_")).checkpoint()
    while True:
        asked = at.select("k_", "w_", "i_", F.get("w_", F.col("i_"))["d"].alias("d_"), F.get("w_", F.col("i_"))["c"].alias("c_"))
        placed = ranks(asked, ["c_"], F.floor(F.col("d_") * 64), ["d_", "k_"], "r_")
        at = placed.select("k_", "w_", F.when(F.col("r_") > room, F.col("i_") + 1).otherwise(F.col("i_")).alias("i_"), (F.col("r_") > room).alias("out_"), "c_").checkpoint()
        if not at.where("out_").limit(1).count():
            return at.select(F.col("k_").alias(key), F.col("c_").alias("cluster"))


def kernel_ridge(rows: DataFrame, vector: str, target: str, width: float, ridge: float, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(training vectors, dual weights) of ridge regression with a Gaussian kernel. The kernel matrix is dense, so that rows are counted first: ValueError above `most`."""
    known = rows.where(F.col(vector).isNotNull() & F.col(target).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    if (n := known.count()) > most:
        raise ValueError(f"{n} rows; the kernel matrix is bounded to {most}")
    got = known.orderBy("x", "y").collect()
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2)) if n else np.zeros((0, 0))
    return x, np.linalg.solve(k + ridge * np.eye(n), y - y.mean()) if n else y


def kernel_ridge_predict(rows: DataFrame, key: str, vector: str, x: np.ndarray, weights: np.ndarray, mean: float, width: float) -> DataFrame:
    """(key, predicted): mean plus the kernel's weighted sum; training vectors are a bounded broadcast."""
    given = rows.sparkSession.sparkContext.broadcast((x, weights))

    def run(batches):
        known, w = given.value
        for b in batches:
            v = np.stack(b["v_"].to_list()) if len(b) else np.zeros((0, known.shape[1]))
            k = np.exp(-((v[:, None] - known[None]) ** 2).sum(axis=2) / (2 * width**2))
            yield pd.DataFrame({key: b[key], "predicted": mean + k @ w})

    held = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v_"))
    return held.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, predicted double")


def merge_boxes(boxes: DataFrame, page: str, least_iou: float = 0.34, least_inside: float = 0.62, most_growth: float = 1.35) -> DataFrame:
    """(page, x0, y0, x1, y1, n): boxes of a page, by falling priority, score and area, merged into the first kept box that they overlap.

    Overlap: intersection over union of least_iou, or intersection over the smaller area of least_inside. A merge grows
    the kept box to the hull of both, if that is at most most_growth times its area; otherwise the kept box absorbs the
    other and stays as it is. Columns priority and score are optional. Boxes with null corners or without area go. A
    page is one group: its boxes are few.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        b = p[["x0", "y0", "x1", "y1"]].to_numpy(np.float64)
        area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        kept: list[list[float]] = []
        for i in np.lexsort((b[:, 1], b[:, 0], -area, -p["score"].to_numpy(np.float64), -p["priority"].to_numpy(np.float64))):
            x = b[i]
            for y in kept:
                w, h = min(x[2], y[2]) - max(x[0], y[0]), min(x[3], y[3]) - max(x[1], y[1])
                both = max(w, 0) * max(h, 0)
                other = (y[2] - y[0]) * (y[3] - y[1])
                if both and (both >= least_iou * (area[i] + other - both) or both >= least_inside * min(area[i], other)):
                    hull = [min(x[0], y[0]), min(x[1], y[1]), max(x[2], y[2]), max(x[3], y[3])]
                    if (hull[2] - hull[0]) * (hull[3] - hull[1]) <= most_growth * other:
                        y[:4] = hull
                    y[4] += 1
                    break
            else:
                kept.append([*x, 1])
        out = pd.DataFrame(kept, columns=["x0", "y0", "x1", "y1", "n"])
        out.insert(0, page, p[page].iloc[0])
        return out

    ranked = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in boxes.columns else F.lit(0.0).alias(c) for c in ("priority", "score")]
    good = boxes.where("x1 > x0 and y1 > y0").select(page, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], *ranked)
    return good.groupBy(page).applyInPandas(run, f"{page} {dict(good.dtypes)[page]}, x0 double, y0 double, x1 double, y1 double, n int")

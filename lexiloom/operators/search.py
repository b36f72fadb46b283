"""Search: merges, segmentation, substitution keys, assignments, folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bpe_merges(words: DataFrame, merges: int, word: str = "word") -> tuple[list[tuple[str, str]], DataFrame]:
    """The first `merges` pair merges and the table (word, n, units) after them.

    The most frequent neighbouring pair is merged first, ties to the smaller pair. Only the table of distinct words is
    rewritten, and one row a round comes to the driver. Units are merged from the left, as a list, so that a merge
    never crosses the border of a unit.
    """
    table = words.groupBy(word).agg(F.count("*").alias("n")).select(word, "n", F.filter(F.split(word, ""), lambda x: x != "").alias("units")).persist()
    done: list[tuple[str, str]] = []
    for _ in range(merges):
        pairs = table.where("size(units) > 1").select("n", F.explode(F.arrays_zip(F.slice("units", F.lit(1), F.size("units") - 1).alias("a"), F.slice("units", F.lit(2), F.size("units") - 1).alias("b"))).alias("p"))
        top = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("c")).agg(F.max_by(F.struct("a", "b"), F.struct("c", F.lit(0))).alias("x"), F.max("c").alias("c")).first()
        if top is None or top["c"] is None:
            break
        best = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("c")).where(F.col("c") == top["c"]).agg(F.min(F.struct("a", "b")).alias("x")).first()["x"]
        done.append((best["a"], best["b"]))
        table = merge_units(table, best["a"], best["b"])
    return done, table


def merge_units(table: DataFrame, a: str, b: str) -> DataFrame:
    def step(acc, x):
        hit = (F.size(acc) > 0) & (F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) == a) & (x == b)
        return F.when(hit, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x)))

    return table.withColumn("units", F.aggregate("units", F.array().cast("array<string>"), step))


def harris_cuts(words: DataFrame, branching: DataFrame, threshold: float = 0.5, word: str = "word") -> DataFrame:
    """(word, cut): first place where the branching entropy of the part before it rises by `threshold` over the place before; null for none. branching: (stem, h)."""
    w = words.select(word).distinct()
    at = w.select(word, F.explode(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1)))).alias("i")).withColumn("stem", F.expr(f"substring({word}, 1, i)"))
    h = at.join(branching, "stem", "left").withColumn("before", F.lag("h").over(Window.partitionBy(word).orderBy("i")))
    cuts = h.where((F.col("h") - F.coalesce("before", F.lit(0.0)) >= threshold) & (F.col("i") > 1)).groupBy(word).agg(F.min("i").alias("cut"))
    return w.join(cuts, word, "left")


def greedy_folds(sizes: Sequence[tuple[str, int]], folds: int) -> dict[str, int]:
    """Blocks by falling size, each to the lightest fold (ties: the first). A few rows on the driver."""
    load, out = [0] * folds, {}
    for block, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = min(range(folds), key=lambda i: (load[i], i))
        out[block] = k
        load[k] += n
    return out


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column for each row of a square cost matrix such that the total is least (shortest augmenting paths, O(n^3))."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        match[0], j0 = row, 0
        low, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used)
            slack = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = slack < low[free]
            low[free[better]], way[free[better]] = slack[better], j0
            j1 = free[np.argmin(low[free])]
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def substitution_search(streams: DataFrame, model: np.ndarray, alphabet: str, restarts: int = 8, steps: int = 4000, seed: int = 1) -> DataFrame:
    """(stream, restart, score, key): best letter key of each stream (stream, text) by hill climbing over swaps, scored by letter-trigram log probabilities.

    A key is scored on the counts of distinct trigrams. One task for each stream and restart; `model` is a small cube.
    """
    at = {c: i for i, c in enumerate(alphabet)}
    k = len(alphabet)

    def climb(group: pd.DataFrame) -> pd.DataFrame:
        row = group.iloc[0]
        x = np.array([at[c] for c in row["text"] if c in at], int)
        grams, n = np.unique(x[:-2] * k * k + x[1:-1] * k + x[2:], return_counts=True) if len(x) > 2 else (np.zeros(0, int), np.zeros(0))
        a, b, c = grams // (k * k), grams // k % k, grams % k
        rng = np.random.default_rng([seed, int(row["restart"]), len(x)])
        score = lambda key: float((n * model[key[a], key[b], key[c]]).sum())
        if row["restart"] == 0:
            order = np.argsort(-np.bincount(x, minlength=k), kind="stable")
            likely = np.argsort(-np.exp(model).sum(axis=(0, 1)), kind="stable")
            key = np.zeros(k, int)
            key[order] = likely
        else:
            key = rng.permutation(k)
        best = score(key)
        for _ in range(steps):
            i, j = rng.integers(0, k, 2)
            key[i], key[j] = key[j], key[i]
            new = score(key)
            if new > best:
                best = new
            else:
                key[i], key[j] = key[j], key[i]
        return pd.DataFrame({"stream": [row["stream"]], "restart": [int(row["restart"])], "score": [best / max(1, len(x))], "key": ["".join(alphabet[i] for i in key)]})

    work = streams.select("stream", "text", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    return work.groupBy("stream", "restart").applyInPandas(climb, "stream string, restart int, score double, key string")


def breadth_first(edges: DataFrame, root: str, most_depth: int = 64) -> DataFrame:
    """(node, depth) of a rooted tree of edges (parent, child): one join a level, until a level is empty; an error if `most_depth` levels do not end it."""
    level = edges.sparkSession.createDataFrame([(root,)], "node string").withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, most_depth + 1):
        level = level.join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(depth).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    else:
        raise RuntimeError(f"the tree may have more than {most_depth} levels")
    return out

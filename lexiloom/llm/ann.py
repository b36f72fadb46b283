"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Vectors are centred on the mean of the index, rotated by a random orthogonal matrix and kept as the signs of their
coordinates, packed to bits, with two correction scalars: the length of the centred vector, and the inner product of
its direction with its code. From these the inner product with a query is estimated without bias, with an error that
falls as the square root of the dimension (Gao and Long 2024). A candidate is reranked exactly, in double precision,
only if its estimate plus the error bound reaches the best k that the bounds promise.

Codes are made once for each vector and travel with it in a table of the index. That table and the rotated queries are
dealt in blocks of bounded bytes, every query block meets every index block in one task, and a task returns at most k
rows for each of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import lean, materialize

#: Bytes of vectors in a block of the index, and in a block of queries: what a task holds, and how seldom rows are copied.
INDEX_BYTES, QUERY_BYTES = 32 << 20, 8 << 20
#: Vectors that a block of the index holds at least.
LEAST_ROWS = 1024
#: Standard deviations of the error bound, as published; recall of the registered query is in the README.
BOUND = 1.9
#: Relative rounding error of a float32 product that the bounds allow for.
ROUNDING = 1e-5


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of vectors of one dimension: packed signs, length, and inner product of direction and code."""

    def __init__(self, bits: np.ndarray, length: np.ndarray, fit: np.ndarray, centre: np.ndarray) -> None:
        self.bits, self.length, self.fit, self.centre = bits, length, fit, centre

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        turned = (x - centre) @ turn.T
        length = np.sqrt((turned**2).sum(axis=1))
        unit = turned / np.maximum(length, 1e-300)[:, None]
        return cls(np.packbits(turned >= 0, axis=1), length, np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1]), 1e-12), centre)

    def estimator(self, turn: np.ndarray):
        """A function from queries to estimated inner products (queries x rows) and the error bound of each."""
        dim = len(self.centre)
        signs = np.unpackbits(self.bits, axis=1, count=dim).astype(np.float32).T * np.float32(2) - np.float32(1)
        signs *= (self.length / self.fit / np.sqrt(dim)).astype(np.float32)
        spread = (self.length * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(1, dim - 1))).astype(np.float32)

        def estimate(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            turned = queries @ turn.T
            size = np.sqrt((turned**2).sum(axis=1)).astype(np.float32)
            guess = turned.astype(np.float32) @ signs + (queries @ self.centre).astype(np.float32)[:, None]
            return guess, (size * np.float32(BOUND))[:, None] * spread[None, :] + np.float32(ROUNDING) * (1 + size)[:, None]

        return estimate


def search_block(ids: np.ndarray, x: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, exact inner product) of the k best candidates of one block for each query, but itself."""
    turn = rotation(x.shape[1])
    estimate, out = codes.estimator(turn), []
    place = np.argsort(ids)
    step = max(1, (1 << 21) // len(ids))
    for at in range(0, len(queries), step):
        some, own = queries[at : at + step], query_ids[at : at + step]
        guess, error = estimate(some)
        self_at = place[np.minimum(np.searchsorted(ids, own, sorter=place), len(ids) - 1)]
        itself = np.flatnonzero(ids[self_at] == own)
        guess[itself, self_at[itself]] = -np.inf
        n = len(ids) - np.isin(np.arange(len(some)), itself)
        least = min(k, len(ids))
        floor = np.partition(guess - error, len(ids) - least, axis=1)[:, len(ids) - least]  # as good as this at least are k candidates
        hope = guess + error >= floor[:, None]
        hope[itself, self_at[itself]] = False
        for r in range(len(some)):
            if not n[r]:
                continue
            near = np.flatnonzero(hope[r])
            rough = x[near] @ some[r]
            if len(near) > k:  # products of other rounding only choose what is measured
                good = rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(rough).max())
                near = near[good]
            exact = (x[near] * some[r]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(best), own[r]), ids[near][best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x array<double>, dim) without vectors that are null, empty, zero or hold a null or a non-finite component."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), x.alias("x"), F.size(x).alias("dim"))


def _matrix(x: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def centres(index: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension, a row of sums for each task and dimension; index: id, x, dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, int]] = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(b.column(0).filter(pa.array(dims == dim)))
                have, n = total.get(dim, (np.zeros(dim), 0))
                total[dim] = (have + x.sum(axis=0), n + len(x))
        for dim, (have, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n]), pa.array([have.tolist()])], names=["dim", "n", "total"])

    sums = index.select("x", "dim").mapInArrow(lean(run), "dim int, n long, total array<double>").select("dim", "n", F.posexplode("total").alias("at", "v"))
    rows = sums.groupBy("dim", "at").agg((F.sum("v") / F.sum("n")).alias("v")).orderBy("dim", "at").collect()  # a row for each component
    out: dict[int, list[float]] = {}
    for r in rows:
        out.setdefault(r["dim"], []).append(r["v"])
    return {dim: np.array(v) for dim, v in out.items()}


def coded(index: DataFrame, means: dict[int, np.ndarray]) -> DataFrame:
    """index (id, x, dim) with its codes: bits, length, fit."""
    given = index.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                if dim not in turns:
                    turns[dim] = rotation(dim)
                c = Codes.of(_matrix(own.column(1)), given.value[dim], turns[dim])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x.tobytes() for x in c.bits], pa.binary()), pa.array(c.length), pa.array(c.fit)], names=["id", "x", "dim", "bits", "length", "fit"])

    return index.select("id", "x", "dim").mapInArrow(lean(run), "id long, x array<double>, dim int, bits binary, length double, fit double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the largest inner product for each row of `queries`, but itself.

    Nearest first, ties to the smaller id; all candidates where there are fewer than k. A query meets only vectors of
    its own dimension. Unusable vectors (see `usable`) and those without id take no part; rows that share an id count
    once, as the smallest vector. Other columns are ignored; empty tables give an empty result.
    """
    once = lambda df: usable(df, key, vector).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("v")).select("id", "v.x", "v.dim")
    index, asked = materialize(once(vectors), "ann-index"), materialize(once(queries), "ann-queries")
    means = centres(index)
    index = materialize(coded(index, means), "ann-codes")
    count = lambda df, most: max(1, -(-(df.agg(F.sum(F.col("dim").cast("long") * 8).alias("n")).first()["n"] or 0) // most))
    blocks, groups = count(index, INDEX_BYTES), count(asked, QUERY_BYTES)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # smaller blocks of the index where cores would be idle: they cost copies of the queries alone, which are far fewer
    blocks = max(blocks, min(-(-tasks // groups), -(-index.count() // LEAST_ROWS)))
    place = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    left = index.withColumn("b", place("id", blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("g", place("id", groups)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = vectors.sparkSession.sparkContext.broadcast(means)

    def run(own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x = np.stack(own["x"].to_list())
        bits = np.frombuffer(b"".join(own["bits"]), np.uint8).reshape(len(x), -1)
        codes = Codes(bits, own["length"].to_numpy(), own["fit"].to_numpy(), given.value[x.shape[1]])
        q, v, s = search_block(own["id"].to_numpy(), x, codes, ask["id"].to_numpy(), np.stack(ask["x"].to_list()), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = left.groupBy("dim", "b", "g").cogroup(right.groupBy("dim", "b", "g")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))

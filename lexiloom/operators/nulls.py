"""Null models. All randomness is the stable hash of seed, replicate and row key: equal for any partitioning, and on any engine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.words import stable_hash, uniform
from lexiloom.operators.sequence import ranks


def replicate(df: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    """Each row once for each replicate 0 .. reps - 1; an explode, so no join."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias(name))


def permute_within(df: DataFrame, key: str, value: str, strata: list[str], reps: int, seed: str, name: str = "permuted") -> DataFrame:
    """(rep, *strata, key, value, name): in each replicate, the values of a stratum dealt anew to its keys.

    Slots are ranks by key, draws are ranks by hash, and both are numbered in stretches (`sequence.ranks`), so that a
    stratum with a third of all rows is dealt to many tasks. Null strata are a stratum like any other.
    """
    rows = replicate(df.select(*strata, F.col(key).alias("k_"), F.col(value).alias("v_")), reps)
    by = ["rep", *strata]
    hashed = rows.withColumn("h_", stable_hash(seed, F.col("rep").cast("string"), F.col("k_").cast("string")))
    draws = ranks(hashed, by, F.substring("h_", 1, 3), ["h_", "k_"], "at_")
    stretch = F.floor(F.col("k_") / 4096) if dict(rows.dtypes)["k_"] in ("tinyint", "smallint", "int", "bigint") else F.substring(F.col("k_").cast("string"), 1, 3)
    slots = ranks(rows, by, stretch, ["k_"], "at_")
    slots = slots.select(*[F.col(c).alias(f"{c}_s") for c in by], F.col("at_").alias("at_s"), F.col("k_").alias(key), F.col("v_").alias(value))
    same = F.col("at_") == F.col("at_s")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    return slots.join(draws.select(*by, "at_", F.col("v_").alias(name)), same).select(*by, key, value, name)


def subsample(df: DataFrame, key: str, strata: list[str], n: int | Column, seed: str) -> DataFrame:
    """n rows of each stratum without replacement, those of the least hashes."""
    w = Window.partitionBy(*strata).orderBy(stable_hash(seed, F.col(key).cast("string")), key)
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= n).drop("r_")


def sign_flips(values: Column) -> Column:
    """Sums of an array (20 entries at most) under all 2^n choices of signs."""
    n = F.size(values)
    one = lambda m: F.aggregate(F.transform(values, lambda v, i: F.when(F.floor(m / F.pow(F.lit(2.0), i)) % 2 == 1, -v).otherwise(v)), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), (F.pow(F.lit(2), n) - 1).cast("int")), one)


def exact_sign_flip_p(values: Column, two_sided: bool = False, eps: float = 1e-12) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    flips = sign_flips(values)
    hit = F.filter(flips, (lambda s: F.abs(s) >= F.abs(total) - eps) if two_sided else (lambda s: s >= total - eps))
    return F.size(hit) / F.size(flips)


def bootstrap(df: DataFrame, key: str, reps: int, seed: str) -> DataFrame:
    """(rep, draw, *df): as many draws with replacement as df has rows, for each replicate. df is a table of blocks, numbered by key."""
    i = Window.orderBy(key)  # a table of blocks: a row for each source, user or the like
    n = df.withColumn("i_", F.row_number().over(i) - 1).join(F.broadcast(df.agg(F.count("*").alias("n_"))))
    draws = replicate(n.select(F.col("i_").alias("draw"), F.col("n_").alias("m_")), reps)
    pick = F.floor(uniform(seed, F.col("rep").cast("string"), F.col("draw").cast("string")) * F.col("m_")).cast("int")
    return draws.select("rep", "draw", pick.alias("i_")).join(n.drop("n_"), "i_").drop("i_")


def rotate(df: DataFrame, ring: list[str], pos: str, n: str, reps: int, seed: str, name: str = "rotated") -> DataFrame:
    """Column `name`: the place on the ring after a turn by a hash of ring and replicate."""
    turn = F.floor(uniform(seed, F.col("rep").cast("string"), *[F.col(c).cast("string") for c in ring]) * F.col(n))
    return replicate(df, reps).withColumn(name, F.pmod(F.col(pos) + turn, F.col(n)).cast("long"))


def upper_p(observed: Column, null: Column, eps: float = 1e-12) -> Column:
    """(1 + number of nulls >= observed) / (1 + number of nulls), as an aggregate."""
    return (1 + F.sum((null >= observed - eps).cast("int"))) / (1 + F.count(null))


def max_stat(nulls: DataFrame, rep: str, value: str) -> DataFrame:
    """(rep, top): the largest statistic of each replicate, over all cells."""
    return nulls.groupBy(rep).agg(F.max(value).alias("top"))


def westfall_young(nulls: DataFrame, cell: list[str], rep: str, value: str) -> DataFrame:
    """(rep, min_p): smallest p of any cell of a replicate, each value ranked among its cell's nulls; replicate 0 is the observation."""
    w = Window.partitionBy(*cell)
    p = F.count("*").over(w.orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, 0)) / F.count("*").over(w)
    return nulls.withColumn("p_", p).groupBy(rep).agg(F.min("p_").alias("min_p"))


def shuffle_columns(df: DataFrame, key: str, columns: list[str], strata: list[str], reps: int, seed: str) -> DataFrame:
    """(rep, *strata, key, *columns): each column dealt anew on its own, so that only the columns' own distributions stay."""
    out = None
    for c in columns:
        one = permute_within(df, key, c, strata, reps, f"{seed}-{c}", f"{c}_").select("rep", *strata, key, F.col(f"{c}_").alias(c))
        out = one if out is None else out.join(one.drop(*strata), ["rep", key])
    return out


def draw_columns(df: DataFrame, key: str, columns: list[str], block: Column, reps: int, seed: str) -> DataFrame:
    """(rep, draw, *columns): as many rows as df has, each column drawn on its own, with replacement, from df's."""
    at = ranks(df.select(key, *columns), [], block, [key], "at_").withColumn("at_", F.col("at_") - 1)
    n = df.agg(F.count("*").alias("n_"))
    out = replicate(at.select(F.col("at_").alias("draw")), reps).join(F.broadcast(n))
    for c in columns:
        pick = F.floor(uniform(f"{seed}-{c}", F.col("rep").cast("string"), F.col("draw").cast("string")) * F.col("n_")).cast("long")
        out = out.withColumn("p_", pick).join(at.select(F.col("at_").alias("p_"), c), "p_").drop("p_")
    return out.drop("n_")


def signs(df: DataFrame, key: str, reps: int, seed: str, name: str = "sign") -> DataFrame:
    """Column `name`: 1 or -1 by hash, for each row and replicate: the Monte Carlo form of `exact_sign_flip_p`."""
    up = uniform(seed, F.col("rep").cast("string"), F.col(key).cast("string")) < 0.5
    return replicate(df, reps).withColumn(name, F.when(up, 1).otherwise(-1))


def bonferroni(p: Column) -> Column:
    """Smallest p times the number of tests, at most 1; an aggregate."""
    return F.least(F.lit(1.0), F.min(p) * F.count(p))


#: Rows of whole users that a task holds at a time; one user's rows stay together.
HELD_ROWS = 1 << 17


def dealt_repeats(df: DataFrame, key: str, value: str, user: str, part: str, reps: int, seed: str) -> DataFrame:
    """(rep, value, n): how often a value repeats the one before of the same user, in order of an integer key: as it is (rep -1) and dealt anew within user and part.

    The deal is that of `permute_within`. Rows are shuffled once, to their users, and replicates are made in the task: a
    user's rows have to meet for the order anyway. Values without repeats have rows too; null keys come last.
    """
    rows = df.select(F.col(user).alias("u_"), F.col(part).alias("p_"), F.col(key).cast("long").alias("k_"), F.col(value).cast("string").alias("v_")).repartition("u_").sortWithinPartitions("u_")

    def users(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole users, about HELD_ROWS rows at a time."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= HELD_ROWS:
                table = pa.Table.from_batches(held)
                u = pc.fill_null(table["u_"].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new = np.flatnonzero(u[1:] != u[:-1]) + 1
                if len(new):
                    yield table.slice(0, int(new[-1]))
                    held = table.slice(int(new[-1])).to_batches()
        if sum(x.num_rows for x in held):
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in users(batches):
            yield from counted(table)

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        def codes(name: str) -> tuple[np.ndarray, pa.Array]:
            c = table[name].combine_chunks().dictionary_encode()
            return pc.fill_null(c.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), c.dictionary

        (u, _), (p, _), (v, names) = codes("u_"), codes("p_"), codes("v_")
        gone = table["k_"].is_null().to_numpy()
        k = pc.fill_null(table["k_"], 0).to_numpy().astype(np.int64)
        order, slots = np.lexsort((k, gone, u)), np.lexsort((k, gone, p, u))
        same = u[order][1:] == u[order][:-1]
        written = [str(x).encode() for x in k.tolist()]
        for rep in range(-1, reps):
            now = v
            if rep >= 0:
                lead = f"{seed}|{rep}|".encode()
                h = np.frombuffer(b"".join([hashlib.md5(lead + x).digest() for x in written]), ">u8").reshape(-1, 2).astype(np.uint64)
                now = np.empty_like(v)
                now[slots] = v[np.lexsort((k, h[:, 1], h[:, 0], gone, p, u))]
            x = now[order]
            n = np.bincount(x[1:][same & (x[1:] == x[:-1]) & (x[1:] >= 0)], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), rep, np.int32)), names, pa.array(n)], names=["rep", value, "n"])

    return rows.mapInArrow(run, f"rep int, `{value}` string, n long").groupBy("rep", value).agg(F.sum("n").alias("n"))

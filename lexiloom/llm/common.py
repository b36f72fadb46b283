"""Shared pieces of the corpus operators: scratch tables, bounded text batches, word codes, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of text bytes that a Python kernel holds as numpy arrays at a time.
SLICE_BYTES = 4 << 20


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow kernel that hands freed memory back to the system when it ends, since Python workers outlive their tasks."""

    @functools.wraps(run)
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return kernel


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the session's checkpoint folder.

    Where both are unset, a session that is one process (local[n]) gets a temporary folder; any other session is an
    error, since executors elsewhere could not read a folder of this machine.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for kernels that run inside: a batch of long texts lies in the JVM and in the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a file of a small table.
ROWS_PER_FILE = 500_000


def materialize(df: DataFrame, tag: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so that a lost executor costs no more than a reread.

    Where it is known that there are at most `rows` rows, they go to as few files as hold per_file of them each, since a
    small table in hundreds of files costs a task for each of them whenever it is read.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of `materialize` that nothing reads any more: what was made from them is written, or not needed."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fs_write(uri: str, data_iter, name: str) -> str:
    """Writes bytes chunks below uri under a name of this attempt, then renames: a reader never sees half a file."""
    from pyarrow import fs

    system, base = open_fs(uri)
    system.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for chunk in data_iter:
            out.write(chunk)
    system.move(part, f"{base}/{name}")
    del fs
    return f"{uri}/{name}"


def open_fs(uri: str):
    """pyarrow file system and path of a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator[pa.RecordBatch], text: int | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the column number `text` holds about `most` bytes at a time; one longer value stays whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if text is None:
            yield batch
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def word_codes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space ([^\\x20\\x09-\\x0D]+): codes of all rows' words one after the other, words per row, and what each code stands for.

    Null counts as an empty text.
    """
    text = pc.fill_null(text, "")
    parts = pc.ascii_split_whitespace(text.cast(pa.large_string()))
    per_row = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.index(names, "").as_py()
    if empty >= 0:
        keep = codes != empty
        row = np.repeat(np.arange(len(per_row)), per_row)
        per_row = np.bincount(row[keep], minlength=len(per_row)).astype(np.int64)
        codes = codes[keep]
    return codes, per_row, names


def hash_names(names: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of each string, as unsigned 64-bit integers."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(x, seed) for x in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads its input over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every window of `length` entries, by doubling: O(log length) passes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, have, b = None, 0, words.astype(np.uint64), 1, base
    left = length
    while left:
        if left & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(b) + piece
            done += have
        left >>= 1
        if left:
            power = power[:-have] * np.uint64(b) + power[have:]
            b, have = b * b & 0xFFFFFFFFFFFFFFFF, have * 2
    return out


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): O(log^2 n) rounds of joins and partial
    aggregates, each written to the shared folder. No group is ever collected. The least neighbours are written before
    the edges meet them, so that join and aggregate have a shuffle each, and adaptive execution can split a hub's rows.
    Null ends and loops are ignored. RuntimeError if `most_rounds` do not suffice.
    """
    now = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before, n = state, state["n"]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-low", 2 * n)
        large = materialize(both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges-large", n)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "edges-low", n)
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", 2 * n)
        discard(now, low, large, least)
        now = after
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

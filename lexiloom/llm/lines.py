"""Line dedup with two Bloom filters.

One pass marks line keys in a filter of hashes seen once and a filter of hashes seen twice. The pair is a saturating
two-bit counter: partitions merge by (once | once', twice | twice' | once & once'), in any order, so a key that lies in
two partitions ends up in the second filter. A second pass sends on only the lines that the second filter suspects,
for exact confirmation by 128-bit key. A false alarm costs a shuffled row, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import lean, materialize, mix64, slices

#: Bits of a filter for each line, and the most bits of a filter (32 MB): what is broadcast never exceeds it.
BITS_PER_LINE, MOST_BITS, PROBES = 12, 1 << 28, 3
PAGE = 1 << 18
WHITE = " \t\n\x0b\x0c\r"


def line_keys(text: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines per row; and for lines whose key has `least` code points or more: row, line number, two 64-bit halves of the key's hash."""
    import xxhash

    parts = pc.split_pattern(pc.fill_null(text, "").cast(pa.large_string()), "\n")
    per_row = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(parts.flatten(), characters=WHITE))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(per_row)), per_row)[long]
    number = long - (np.cumsum(per_row) - per_row)[row]
    one = xxhash.xxh3_128_digest
    digest = np.frombuffer(b"".join(map(one, keys.take(pa.array(long)).cast(pa.large_binary()).to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
    return per_row, row, number, digest


def _probes(key: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions below `bits` (a power of two) for each key."""
    step = mix64(key) | np.uint64(1)
    return np.stack([(key + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1)


def _pages(positions: np.ndarray) -> dict[int, np.ndarray]:
    """Packed pages of PAGE bits that hold the given positions."""
    positions = np.unique(positions)
    page = (positions // np.uint64(PAGE)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, page[1:] != page[:-1], True]) if len(page) else [0]
    out = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        flags = np.zeros(PAGE, np.uint8)
        flags[(positions[a:b] % np.uint64(PAGE)).astype(np.int64)] = 1
        out[int(page[a])] = np.packbits(flags)
    return out


def twice_filter(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The filter of keys that lie in two rows of docs (doc_id, text), as packed bits; bits / 8 bytes, at most MOST_BITS / 8."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in slices(batches, 1):
            _, row, _, digest = line_keys(b.column(1), least)
            known = np.array(b.column(0).is_valid())[row]
            pair = np.unique(np.stack([row[known].astype(np.uint64), digest[known, 0]], axis=1), axis=0)  # once for each row of docs
            found.append(pair[:, 1])
            if sum(map(len, found)) > 4_000_000:
                yield from send(np.concatenate(found))
                found = []
        if found:
            yield from send(np.concatenate(found))

    def send(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(keys, return_counts=True)
        once, twice = _pages(_probes(keys, bits).ravel()), _pages(_probes(keys[n > 1], bits).ravel())
        for page, x in once.items():
            y = twice.get(page)
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([x.tobytes()]), pa.array([None if y is None else y.tobytes()], pa.binary())], names=["page", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for page, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                once = np.frombuffer(x, np.uint8)
                if page not in state:
                    state[page] = [np.zeros(PAGE // 8, np.uint8), np.zeros(PAGE // 8, np.uint8)]
                have = state[page]
                have[1] |= have[0] & once
                have[0] |= once
                if y is not None:
                    have[1] |= np.frombuffer(y, np.uint8)
        for page, (_, twice) in state.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([twice.tobytes()])], names=["page", "twice"])

    pages = docs.mapInArrow(lean(mark), "page int, once binary, twice binary").repartition("page").mapInArrow(lean(merge), "page int, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for x in pages.collect():  # at most bits / PAGE rows
        at = x["page"] * (PAGE // 8)
        out[at : at + PAGE // 8] = np.frombuffer(x["twice"], np.uint8)[: bits // 8 - at]
    return out


def line_dedup(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, text: str = "text", key: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept string or null, whole binary) for every row.

    Keys (lines stripped of ASCII white space, ASCII letters lower-cased) of at least least_chars code points that lie
    in at least least_docs documents lose their lines everywhere but in the largest doc_id. kept is null where nothing
    was dropped; whole is the SHA-256 of the text. Null or empty texts are one empty line. Rows without doc_id take no
    part and lose nothing. Rows that share a doc_id are one document. Other columns are ignored; an empty table gives
    an empty result. most_bits bounds the filters, and so the broadcast; fuller filters let more lines through to the
    exact stage and change no result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = src.select(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n")).first()["n"] or 0
    bits = min(most_bits, max(PAGE, 1 << max(1, int(lines * BITS_PER_LINE - 1)).bit_length()))
    twice = spark.sparkContext.broadcast(twice_filter(src, least_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flt = twice.value
        for b in slices(batches, 1):
            per_row, row, _, digest = line_keys(b.column(1), least_chars)
            at = _probes(digest[:, 0], bits)
            hit = ((flt[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            hit &= np.array(b.column(0).is_valid())[row]
            row, digest = row[hit], digest[hit].view(np.int64)
            count = np.bincount(row, minlength=len(per_row))
            keys = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.StructArray.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["k1", "k2"]))
            whole = [hashlib.sha256(t or b"").digest() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            held = b.column(1).take(pa.array(np.arange(b.num_rows), mask=count == 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(per_row), pa.array(whole, pa.binary()), keys, held], names=["doc_id", "n_lines", "whole", "keys", "text"])

    first = materialize(src.mapInArrow(lean(suspects), "doc_id long, n_lines long, whole binary, keys array<struct<k1:long,k2:long>>, text string"), "lines-suspects")
    pairs = first.where("size(keys) > 0").select("doc_id", F.explode(F.array_distinct("keys")).alias("k")).select("doc_id", "k.*").distinct()
    pairs = materialize(pairs, "lines-pairs")
    common = pairs.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= least_docs).select("k1", "k2", "last")
    common = materialize(common, "lines-common")  # so that the join below has shuffles of its own, and a hot key can be split
    drops = pairs.join(common, ["k1", "k2"]).where("doc_id <> last").groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("drop")).withColumnRenamed("doc_id", "doc_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            per_row, row, number, digest = line_keys(b.column(3), least_chars)
            gone = b.column(4).to_pylist()
            texts = b.column(3).cast(pa.large_binary()).to_pylist()
            begin = np.searchsorted(row, np.arange(len(per_row) + 1))
            signed = digest.view(np.int64)
            dropped, kept = [], []
            for i, (t, d) in enumerate(zip(texts, gone, strict=True)):
                bad = {(x["k1"], x["k2"]) for x in d}
                own = range(begin[i], begin[i + 1])
                off = {int(number[j]) for j in own if (int(signed[j, 0]), int(signed[j, 1])) in bad}
                dropped.append(len(off))
                kept.append(b"\n".join(x for n, x in enumerate((t or b"").split(b"\n")) if n not in off))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_lines", "whole", "n_dropped", "kept"])

    judged = first.where("size(keys) > 0").join(drops, F.col("doc_id") == F.col("doc_"), "left").drop("doc_")
    kinds = "doc_id long, n_lines long, whole binary, n_dropped long, kept string"
    changed = judged.where("`drop` is not null").select("doc_id", "n_lines", "whole", "text", "drop").mapInArrow(lean(cut), kinds)
    same = judged.where("`drop` is null").select("doc_id", "n_lines", "whole").unionByName(first.where("size(keys) = 0").select("doc_id", "n_lines", "whole"))
    out = changed.unionByName(same.withColumns({"n_dropped": F.lit(0).cast("long"), "kept": F.lit(None).cast("string")}))
    return out.select("doc_id", "n_lines", "n_dropped", "kept", "whole")


def op7_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.when(F.col("kept").isNull(), F.lower(F.hex("whole"))).otherwise(F.sha2("kept", 256))
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS n
  FROM documents),
k AS (
  SELECT doc_id, n, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

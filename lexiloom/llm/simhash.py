"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two fingerprints within two bits of each other agree
exactly on one segment at least (pigeonhole) and differ in at most two bits on the next one. The perfect binary Golay
code (23, 12, 7) turns a segment into the indices of all codewords within distance four of it: one index for half-way
clean words, six for most. Words within two bits of each other always share such an index: take the nearest codeword c
of x (distance 3 at most); if y is out of c's reach, the five codewords at distance four of x cover every other
position, and one of them is in reach of y. So (exact segment, index of the next segment) are keys under which every
pair of linked fingerprints meets; a popcount verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import connected_components, discard, lean, materialize, slices

#: Generator polynomial of the binary Golay code (fixed value).
GOLAY_GENERATOR = 0xAE3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: A key that more fingerprints share is resolved by the one-bit neighbourhoods of its fingerprints, linearly.
BUCKET = 1024


def _syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    r = x.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> np.uint32(bit)) & np.uint32(1), np.uint32(GOLAY_GENERATOR << (bit - 11)), np.uint32(0))
    return r


def _patterns() -> np.ndarray:
    """For each of the 2048 syndromes its error patterns of weight four at most; rows are filled up with the first one."""
    unit = 1 << np.arange(23, dtype=np.uint32)
    by: list[list[int]] = [[] for _ in range(2048)]
    layer = [(0, -1)]
    for weight in range(5):
        words = np.array([w for w, _ in layer], np.uint32)
        for w, s in zip(words.tolist(), _syndrome(words).tolist(), strict=True):
            by[s].append(w)
        if weight < 4:
            layer = [(w | int(unit[i]), i) for w, last in layer for i in range(last + 1, 23)]
    width = max(map(len, by))
    return np.array([x + [x[0]] * (width - len(x)) for x in by], np.uint32)


class Golay:
    """Indices (12 bits) of the codewords near 23-bit words."""

    def __init__(self) -> None:
        self.patterns = _patterns()
        all_low = np.arange(1 << 12, dtype=np.uint32)
        self.low, self.high = _syndrome(all_low), _syndrome(all_low << np.uint32(12) & np.uint32(0x7FFFFF))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """n x 6 indices of the codewords within distance four; repeats where there are fewer."""
        x = x.astype(np.uint32)
        syndrome = self.low[x & np.uint32(0xFFF)] ^ self.high[x >> np.uint32(12)]
        return (x[:, None] ^ self.patterns[syndrome]) >> np.uint32(11)


def fingerprint_texts(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text (see `fingerprints`)."""
    import xxhash

    one = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.lower().split() if text else []
        if not words:
            continue
        if len(words) <= shingle:
            out[k] = one(b" ".join(words), seed)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begin = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        h = np.fromiter((one(joined[a:b], seed) for a, b in zip(begin, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(begin))
        votes = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 16):
            votes += np.unpackbits(h[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long): SimHash over the XXH64 (seed 42) of word shingles, repeats counted; ASCII letters lower-cased.

    A bit is 1 if it is set in over half of the shingles. Fewer words than a shingle: the whole sequence is the one
    shingle. No words, or a null text: 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fp = fingerprint_texts(b.column(1).cast(pa.large_binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def _key_rows(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                b = batch.slice(at, 1 << 15)
                fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                x = fp.view(np.uint64)
                parts = [((x >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint64) for at, n in SEGMENTS]
                rows = []
                for i in range(len(SEGMENTS)):
                    near = golay.keys(parts[(i + 1) % len(SEGMENTS)]).astype(np.uint64)
                    rows.append((np.uint64(i) << np.uint64(60)) | (parts[i][:, None] << np.uint64(12)) | near)
                keys = np.concatenate(rows, axis=1)
                keys.sort(axis=1)
                new = np.ones(keys.shape, bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                at_row = np.nonzero(new)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(fp[at_row]), b.column(1).take(pa.array(at_row))], names=["key", "fp", "node"])

    return fps.mapInArrow(lean(run), "key long, fp long, node long")


def _spanning(fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges node -> node that connect what lies within `radius` bits inside one small bucket; at most one per fingerprint."""
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    label = node.copy()
    while True:
        low = np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (low == label).all():
            break
        label = low
    moved = label != node
    return node[moved].tolist(), label[moved].tolist()


def _bucket_edges(keys: DataFrame, radius: int) -> DataFrame:
    """Keys arrive sorted within partitions; a bucket is at most BUCKET fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
                last = np.searchsorted(rest[0], rest[0][-1])
                done, rest = [x[:last] for x in rest], [x[last:] for x in rest]
            elif rest is not None:
                done = rest
            else:
                return
            if not len(done[0]):
                continue
            key, fp, node = done
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            sizes = np.diff(cuts)
            a, b = [], []
            two = cuts[:-1][sizes == 2]  # most buckets that matter: all at once
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            a += np.maximum(node[two], node[two + 1])[near].tolist()
            b += np.minimum(node[two], node[two + 1])[near].tolist()
            for at, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _spanning(fp[at : at + n].view(np.uint64), node[at : at + n], radius)
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return keys.mapInArrow(lean(run), "a long, b long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between nodes of `fps` (distinct fp, node) whose closure equals that of all pairs within `radius` <= 2 bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the Golay keys cover up to two differing bits")
    keys = materialize(_key_rows(fps.select("fp", "node")), "golay-keys")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "golay-shared")  # so that a hot key's rows can be split
    met = materialize(keys.join(shared, "key"), "golay-met")
    discard(keys, shared)
    cold = met.where(F.col("n") <= BUCKET).select("key", "fp", "node").repartition("key").sortWithinPartitions("key")
    # Hot buckets: two words are within two bits of each other exactly if some word is within one bit of both (the
    # word itself and its 64 neighbours), so a star around each such word links all of its members, in linear work.
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    around = met.where(F.col("n") > BUCKET).select("fp", "node").distinct().select("node", F.explode(F.transform(flips, lambda z: z.bitwiseXOR(F.col("fp")))).alias("z"))
    if radius < 2:
        return _bucket_edges(cold, radius).unionByName(_bucket_edges(met.where(F.col("n") > BUCKET).select("key", "fp", "node").repartition("key").sortWithinPartitions("key"), radius))
    star = around.groupBy("z").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    hot = around.join(star, "z").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return _bucket_edges(cold, radius).unionByName(hot)


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp long, component_id long) for every row of docs.

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the smallest doc_id that
    can be reached, the document itself included. Equal fingerprints become one node first, so groups of copies cost
    one row. Rows without doc_id keep their fingerprint and get a null component_id; repeated rows are returned as often
    as they come; other columns of docs are ignored. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle, text, key), "simhash")
    nodes = materialize(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    found = connected_components(links(nodes, radius))
    named = nodes.join(found, "node", "left").select(F.col("fp").alias("fp_"), F.coalesce("root", "node").alias("root"))
    return fps.join(named, F.col("fp") == F.col("fp_"), "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs without the near-duplicates of a smaller doc_id; columns as they are. Rows without doc_id stay."""
    found = near_duplicates(docs, shingle, radius)
    drop = found.where("component_id <> doc_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

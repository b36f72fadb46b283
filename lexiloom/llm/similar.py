"""Near-dedup of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, verified exactly, on top of SimHash keys.

The Golay keys of `simhash` come first and name the closest pairs; the bands are asked only for partners outside of the
components that these pairs make, until the sets have refuted a pair. Golay keys cannot name all pairs: two sets of
similarity 0.8 differ in about ten bits of a 64-bit SimHash, and codeword indices that meet at ten bits meet everywhere.
The rest comes from min-hash bands: a set has BANDS keys of ROWS minima each, so that two sets of similarity s share none
with a chance of (1 - s^4)^30, which is one in seven million at 0.8 and less above, while unlike texts hardly ever meet.
The number of keys does not grow with a text, and what is shuffled grows in proportion to the texts.

A key's texts are compared in blocks of bounded size: by size, and by sets of 1024 parities, which never differ in more
bits than the sets in shingles. A round names for each text the likeliest partner outside its component only, so what it
emits is linear in the texts; the sets themselves verify it. Rounds repeat while they join components. A last one names
all partners that are left, once no key of a large group of copies holds many components any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import simhash
from lexiloom.llm.common import batches_of, connected_components, discard, hash_names, lean, materialize, mix64, slices, word_codes

SHINGLE = 5
#: Least similarity as a fraction.
LEAST = (4, 5)
#: Keys of a text, and minima in a key.
BANDS, ROWS = 30, 4
#: Logarithm of the most bits of the bitmap that says whose texts are read again; a fuller one costs time, not results.
MOST_BITS = 28
#: Texts of a key that are compared with each other in one task; a larger key is dealt as pairs of blocks.
BLOCK = 1024
#: Pairs that a task verifies at least.
PAIRS = 2000
#: Rounds that name one partner each, before the round that names all.
ROUNDS = 2
TEXT_BYTES = 2 << 20


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row and hash; fewer words than a shingle are one, no words none."""
    codes, per_row, names = word_codes(text)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = mix64(hash_names(pc.ascii_lower(names.cast(pa.large_string())), 42) + np.uint64(1))[codes]
    begin = np.cumsum(per_row) - per_row
    many = np.where(per_row > 0, np.maximum(per_row - size + 1, 1), 0)
    row = np.repeat(np.arange(len(per_row)), many)
    at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    left = per_row[row]
    out = words[at].copy()
    for i in range(1, size):
        longer = left > i
        out[longer] = mix64(out[longer] * np.uint64(0x9E3779B97F4A7C15) + words[at[longer] + i])
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (out[1:] != out[:-1])]
    return row[new], out[new]


def _sids(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(hashes[a : a + k].tobytes()) for a, k in zip(begin.tolist(), n.tolist(), strict=True)), np.uint64, len(begin))


def _sketches(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """1024 bits for each set: whether an odd number of its shingles falls on the bit."""
    at = np.repeat(np.arange(len(n)), n) * 1024 + (hashes & np.uint64(1023)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(n) * 1024) & 1).astype(np.uint8).reshape(-1, 1024)
    return pa.array([x.tobytes() for x in np.packbits(odd, axis=1)], pa.binary())


def _simhashes(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each set; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values.view(np.int64)))


def _bands(hashes: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BANDS keys of each set that is not empty, a row for each."""
    out = np.zeros((len(n), BANDS), np.uint64)
    some = begin[n > 0]
    turns = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for band in range(BANDS if len(some) else 0):
        key = np.full(len(some), band + 1, np.uint64)
        for k in range(ROWS):
            turned = hashes * turns[band * ROWS + k]
            turned ^= turned >> np.uint64(32)
            turned *= turns[band * ROWS + k]
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(turned, some))
        out[n > 0, band] = key
    return out


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, n, fp, keys, sketch) of every text; a text without words is the empty set, which has no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, TEXT_BYTES):
            row, h = shingles(b.column(1))
            n = np.bincount(row, minlength=b.num_rows).astype(np.int64)
            begin = np.cumsum(n) - n
            keys = _lists(_bands(h, begin, n)[n > 0].ravel(), np.where(n > 0, BANDS, 0))
            cols = [b.column(0), pa.array(_sids(h, begin, n).view(np.int64)), pa.array(n), pa.array(_simhashes(h, begin, n).view(np.int64)), keys, _sketches(h, n)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "sid", "n", "fp", "keys", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id long, sid long, n long, fp long, keys array<long>, sketch binary")


def _bits(values: DataFrame, size: int) -> np.ndarray:
    """A bitmap of `size` bits (as words of 64) over the numbers of the only column; at most size / 64 rows are collected."""
    at = values.select(F.pmod(F.col(values.columns[0]), F.lit(size)).alias("at"))
    found = at.selectExpr("cast(at div 64 as int) w", "shiftleft(1L, cast(at % 64 as int)) b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.mod(x, len(bits) * 64)  # of signed numbers: as pmod
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(sid, own) of the documents whose doc_id the bitmap does not exclude."""
    given = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.filter(pa.array(_has(given.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for b in slices(iter([mine]), 1, TEXT_BYTES):
                row, h = shingles(b.column(1))
                n = np.bincount(row, minlength=b.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_sids(h, np.cumsum(n) - n, n).view(np.int64)), _lists(h, n)], names=["sid", "own"])

    return docs.mapInArrow(lean(run), "sid long, own array<long>")


def _blocked(held: DataFrame) -> DataFrame:
    """held with its key's pair of blocks (i, j) and own block; a row of a key of b blocks comes b times."""
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    out = held.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks", "c")


def _partners(held: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of sids of a key that may be similar and have not the same root: all, or the likeliest one of each sid.

    held: key, sid, n, sketch, root, c (rows of the key).
    """

    def likely(key: list[np.ndarray], sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sid, n, root, block = key
        across = block.min() != block.max()
        for at in range(0, len(sid), 64):
            x = slice(at, at + 64)
            both = n[x, None] + n[None, :]
            ok = (root[x, None] != root[None, :]) & (sid[x, None] != sid[None, :]) & (LEAST[1] * np.minimum(n[x, None], n[None, :]) >= LEAST[0] * np.maximum(n[x, None], n[None, :]))
            if across:
                ok &= block[x, None] != block[None, :]
            if every:
                ok &= sid[x, None] < sid[None, :]
            if not ok.any():
                continue
            # |a and b| >= least * |a or b|, so that |a| + |b| - 2 |a and b| <= total * (1 - least) / (1 + least)
            apart = np.bitwise_count(sketch[x, None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
            ok &= apart <= (LEAST[1] - LEAST[0]) * both // (LEAST[0] + LEAST[1])
            if every:
                a, b = np.nonzero(ok)
            else:
                a = np.flatnonzero(ok.any(axis=1))
                b = np.where(ok[a], apart[a] / both[a], np.inf).argmin(axis=1)
            yield sid[at + a], sid[b], apart[a, b] / both[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, 3):
            nums = [whole.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            sketch = np.frombuffer(b"".join(whole.column(7).to_pylist()), np.uint64).reshape(whole.num_rows, -1)
            new = np.r_[True, (nums[0][1:] != nums[0][:-1]) | (nums[1][1:] != nums[1][:-1]) | (nums[2][1:] != nums[2][:-1]), True]
            cuts, out = np.flatnonzero(new), []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if b - a > 1:
                    out += likely([x[a:b] for x in nums[3:]], sketch[a:b])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "apart"])

    rows = _blocked(held).select("key", "i", "j", "sid", "n", "root", "block", "sketch")
    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(run), "a long, b long, apart double")
    if not every:
        found = found.groupBy("a").agg(F.min(F.struct("apart", "b"))["b"].alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the first `by` columns, cut so that no group of equal ones is parted; a group is small."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            last = [b.column(k)[b.num_rows - 1] for k in range(by)]
            same = np.ones(b.num_rows, bool)
            for k in range(by):
                same &= b.column(k).to_numpy(zero_copy_only=False) == last[k].as_py()
            first = int(same.argmax())
            if first or (rest and [rest[-1].column(k)[rest[-1].num_rows - 1] for k in range(by)] != last):
                done = [*rest, b.slice(0, first)]
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                rest = []
            rest.append(b.slice(first))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar, written; pairs is a written table."""
    tasks = max(1, -(-pairs.count() // PAIRS))  # before the kernel: each of its tasks starts a Python worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            x, y = b.column(2), b.column(3)
            for i in range(b.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(LEAST[1] * both >= LEAST[0] * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("sid").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("own").alias("y"))
    return materialize(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").coalesce(tasks).mapInArrow(lean(run), "a long, b long"), "similar-edges")


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid) of every row of docs (doc_id, text), and (sid, keep): the least doc_id of the sid's near copies.

    Equal sets have one sid, and sids are near copies if a chain of similar sets joins them. Rows without doc_id must
    not be given. An empty table gives empty ones.
    """
    size = 1 << min(MOST_BITS, max(16, (100 * docs.count()).bit_length()))
    with batches_of(docs.sparkSession, 2000):
        rows = materialize(_measured(docs), "similar-rows")
    node = materialize(rows.groupBy("sid").agg(F.min("doc_id").alias("first_"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "similar-nodes")
    slim = materialize(rows.select("doc_id", "sid"), "similar-sids")
    discard(rows)
    keys = node.select("sid", F.explode("keys").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "similar-shared")
    held = materialize(keys.join(shared, "key").join(node.select("sid", "n", "sketch"), "sid"), "similar-held")
    discard(shared)
    # the closest pairs by Golay keys of the SimHash, those of equal fingerprints included; the bands are asked only for partners outside of what these join
    prints = materialize(node.groupBy("fp").agg(F.min("sid").alias("node")), "similar-prints")
    equal = node.join(prints, "fp").where("sid <> node").select(F.col("sid").alias("a"), F.col("node").alias("b"))
    close = materialize(simhash.links(prints).unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "similar-close")
    joined = materialize(connected_components(close).select(F.col("node").alias("sid"), "root"), "similar-joined", 2 * close.count())
    most = held.count()  # a text's likeliest partner is one of a row of these
    tested = materialize(_partners(held.join(joined, "sid", "left").withColumn("root", F.coalesce("root", "sid")), False), "similar-tested", most)
    tested = materialize(close.unionByName(tested), "similar-tested", most + close.count())  # no pair is in both
    most = min(most + 2 * close.count(), 2 * tested.count())
    # a text without any likely partner is settled; the sets of the others are made once
    asked = materialize(tested.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "similar-asked", most)
    sets = _sets(docs, _bits(node.join(asked, "sid").select("first_"), size)).join(asked, "sid", "left_semi").dropDuplicates(["sid"])
    sets = materialize(sets, "similar-sets")
    left = materialize(held.join(asked, "sid", "left_semi").drop("c"), "similar-open", most * BANDS, 50_000)
    discard(held)
    edges = [_verified(tested, sets)]
    every, turn = False, 0
    while True:
        root = materialize(connected_components(_union(edges)).select(F.col("node").alias("sid"), "root"), "similar-roots", most)
        if every:
            break
        named = left.join(root, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        several = materialize(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c"), "similar-several", most * BANDS)
        named = named.join(several, "key")
        every = turn == ROUNDS
        while True:
            new = materialize(_partners(named, every).join(tested, ["a", "b"], "left_anti"), "similar-new", None if every else most)
            more = _verified(new, sets)
            if every or not more.isEmpty():
                break
            every = True  # no likeliest partner is a link any more: all partners, at once
            tested = tested.unionByName(new)
        edges.append(more)
        tested, turn = tested.unionByName(new), turn + 1
    named = materialize(node.join(root, "sid", "left").select("sid", "first_", F.coalesce("root", "sid").alias("root")), "similar-named")
    least = materialize(named.groupBy("root").agg(F.min("first_").alias("keep")), "similar-least")
    keep = materialize(named.join(least, "root").select("sid", "keep"), "similar-keep")
    discard(node, asked, sets, left, prints, close, joined, several, root, named, least, *edges)
    return slim, keep


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the near copies of a smaller doc_id; columns as they are.

    Rows without doc_id stay. Texts without words, null ones included, are copies of each other; repeated rows of the
    doc_id that stays all stay, and of rows that share a doc_id but not the text none stays if one is a near copy of a
    smaller doc_id. Texts of any length are compared whole. An empty table stays empty.
    """
    rows, keep = similar_sets(docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    drop = materialize(rows.join(keep, "sid").where("doc_id <> keep").select(F.col("doc_id").alias("__drop")).distinct(), "similar-drop")
    return docs.join(drop, docs["doc_id"] == F.col("__drop"), "left_anti")

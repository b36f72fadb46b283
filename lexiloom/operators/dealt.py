"""Surprise of words, dealt anew within source, place and length: words meet in buckets of their stratum, as packed columns.

A bucket holds small strata together, or a part of a large one, cut by hash. A slice of texts sends it document numbers
and places, from which the hashes are made there; it sends back the values that the slice's words get, in the slice's order.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.bags import apart
from lexiloom.operators.packed import Placed, _bytes, joined, md5, md5_of_hex, ordered, pack, unpack

#: Places in the line and lengths of words that are told apart, the last of each standing for all beyond.
PLACES, LENGTHS = 6, 12
CELLS = PLACES * LENGTHS
#: Words of a stratum that one task deals, and of strata that share a task, about; bins of hashes of each part of a larger stratum.
WORDS_HELD, WORDS_TOGETHER, BINS = 2 << 20, 2 << 20, 16
#: Bytes of text that are cut at a time: a slice lists its values once for each bucket.
READ_BYTES = 12 << 20
#: Values travel as whole multiples of 1 / UNIT; results have five digits.
UNIT = 2.0**36
#: Hashes that are made at a time.
HASHED = 1 << 18
_NO_NAMES = pa.array([], pa.large_string())


def _trim() -> None:
    """Hands freed memory back to the system, since Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Read(Placed):
    """Words with their cells (place and length), and the letters of their names: letter[i] is one of name of[i]."""

    def __init__(self, text: pa.Array, doc: np.ndarray, ids: pa.Array, source: pa.Array) -> None:
        super().__init__(text, doc, ids)
        flat = np.frombuffer(b"".join(_bytes(self.names)), np.uint8)
        of = np.repeat(np.arange(len(self.names)), pc.binary_length(self.names).to_numpy(zero_copy_only=False))
        own = flat != 0xC3  # the second byte of à to ÿ is no letter of ASCII
        self.letter, self.of = flat[own].astype(np.int64), of[own]
        self.length = np.bincount(self.of, minlength=len(self.names))
        self.place = np.minimum(self.pos, PLACES - 1)
        self.cell = self.place * LENGTHS + np.minimum(self.length, LENGTHS)[self.code] - 1
        kinds = source.dictionary_encode()
        self.sources, self.source = kinds.dictionary, kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        self.numbered = ids.is_valid().to_numpy(zero_copy_only=False)[self.doc]
        self.paired = (self.line[1:] == self.line[:-1]) & (self.doc[1:] == self.doc[:-1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Read]:
    for b in batches:
        ids, text, source = b.columns
        size = np.ones(b.num_rows, np.int64)
        if pa.types.is_list(text.type):
            size = pc.list_value_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            text, source = text.flatten(), source.flatten()
        ends = np.r_[0, np.cumsum(size)]
        held = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))][ends]
        cuts = [0, *(np.flatnonzero(np.diff(held[:-1] // READ_BYTES)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                own = slice(ends[x], ends[y])
                yield Read(text[own], np.repeat(np.arange(y - x), size[x:y]), ids[x:y], source[own])


class Texts:
    """Documents for kernels over `Read` slices; those that share a number are one, whatever their sources. Counts the numbers, so it runs a job."""

    def __init__(self, docs: DataFrame) -> None:
        docs = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce("source", F.lit("")).alias("source"))
        self.once, more = apart(docs, nulls=True)
        self.more = None if more is None else more.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("text", "source"))).alias("t")).select("doc_id", "t.text", "t.source")

    def over(self, run: Callable[[int, Iterator[Read]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        out = self.once.mapInArrow(lambda batches: run(0, _read(batches)), schema)
        return out if self.more is None else out.unionByName(self.more.mapInArrow(lambda batches: run(1, _read(batches)), schema))


class Strata(NamedTuple):
    """bits: surprise of letters; mean: of words, by cell; source: numbers of sources; first, parts: buckets of a stratum (source number * CELLS + cell); buckets: their number."""

    bits: np.ndarray
    mean: np.ndarray
    source: dict[str, int]
    first: np.ndarray
    parts: np.ndarray
    buckets: int

    def of(self, w: Read) -> np.ndarray:
        return np.array([self.source.get(x, -1) for x in w.sources.to_pylist()], np.int64)[w.source] * CELLS + w.cell if len(w.code) else w.cell

    def values(self, w: Read) -> np.ndarray:
        return np.bincount(w.of, self.bits[w.letter], len(w.names)) / (w.length + 1)


def strata(texts: Texts) -> Strata:
    """One pass: letters, the words' mean surprise (a sum over their letters), and the sizes of strata. The driver gets a row for each source and cell, and for each cell and letter."""

    def run(_: int, words: Iterator[Read]) -> Iterator[pa.RecordBatch]:
        n, share, held = np.zeros(CELLS * 256), np.zeros(CELLS * 256), {}
        for w in words:
            if not len(w.code):
                continue
            kinds = len(w.names)
            by = np.bincount(w.place * kinds + w.code, minlength=PLACES * kinds).reshape(PLACES, kinds)
            at = (np.minimum(w.length, LENGTHS)[w.of] - 1) * 256 + w.letter
            for place in range(PLACES):
                c, own = by[place][w.of], slice(place * LENGTHS * 256, (place + 1) * LENGTHS * 256)
                n[own] += np.bincount(at, c, LENGTHS * 256)
                share[own] += np.bincount(at, c / (w.length[w.of] + 1), LENGTHS * 256)
            each = np.bincount(w.source * CELLS + w.cell, minlength=len(w.sources) * CELLS).reshape(-1, CELLS)
            for name, x in zip(w.sources.to_pylist(), each, strict=True):
                held[name] = held.get(name, 0) + x
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array(used // 256), pa.array(used % 256), pa.array(n[used]), pa.array(share[used])], names=["source", "cell", "letter", "n", "share"])
        for name, x in held.items():
            used = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(np.full(len(used), -1)), pa.array(x[used].astype(np.float64)), pa.array(np.zeros(len(used)))], names=["source", "cell", "letter", "n", "share"])

    rows = texts.over(run, "source string, cell long, letter long, n double, share double").groupBy("source", "cell", "letter").agg(F.sum("n").alias("n"), F.sum("share").alias("share")).collect()
    count, share = np.zeros(256), np.zeros((CELLS, 256))
    for r in rows:
        if r.letter >= 0:
            count[r.letter] += r.n
            share[r.cell, r.letter] = r.share
    bits = np.zeros(256)
    bits[count > 0] = np.log2(count.sum() / count[count > 0])
    words = sorted((r for r in rows if r.letter < 0), key=lambda r: (r.cell, r.source))  # strata of a cell share a bucket, and its values
    source = {x: i for i, x in enumerate(sorted({r.source for r in words}))}
    size, first, parts = np.zeros(CELLS), np.full(len(source) * CELLS, -1), np.ones(len(source) * CELLS, np.int64)
    buckets, room = 0, 0
    for r in words:
        size[r.cell] += r.n
        k = source[r.source] * CELLS + r.cell
        if r.n > WORDS_HELD:
            parts[k], first[k] = math.ceil(r.n / WORDS_HELD), buckets
            buckets, room = buckets + int(parts[k]), 0
            continue
        if r.n > room:
            buckets, room = buckets + 1, WORDS_TOGETHER
        first[k], room = buckets - 1, room - r.n
    return Strata(bits, (share @ bits) / np.maximum(size, 1), source, first, parts, buckets)


def _hashes(w: Read, at: np.ndarray, seed: str, reps: range) -> np.ndarray:
    """First halves of the keys of words (row 0), and of their hashes in each replicate."""
    ids = w.ids.take(pa.array(w.doc[at]))
    key = keys(ids, w.seq[at])
    return np.stack([key[0], *(md5_of_hex(f"{seed}|{rep}|", *key)[0] for rep in reps)])


def keys(ids: pa.Array, seq: np.ndarray) -> np.ndarray:
    """Both halves of the hash of document and place."""
    out = np.empty((2, len(seq)), np.uint64)
    for lo in range(0, len(seq), HASHED):
        own = slice(lo, lo + HASHED)
        out[:, own] = md5(joined("tok", ids[own], seq[own]))
    return out


def deltas(table: np.ndarray) -> np.ndarray:
    return np.diff(table, prepend=0)


def _bin(hi: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return ((hi >> np.uint64(32)) * bins.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def bins(texts: Texts, s: Strata, reps: int, seed: str) -> dict[int, np.ndarray]:
    """Of each stratum in parts: how many words lie below each bin of their key (row 0) and of their hash in each replicate."""
    base = np.cumsum(np.where(s.parts > 1, s.parts * BINS, 0)) - np.where(s.parts > 1, s.parts * BINS, 0)
    every = int(np.where(s.parts > 1, s.parts * BINS, 0).sum())
    if not every:
        return {}

    def run(_: int, words: Iterator[Read]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((reps + 1) * every, np.int64)
        for w in words:
            k = s.of(w)
            at = np.flatnonzero((s.parts[k] > 1) & w.numbered)
            for i, hi in enumerate(_hashes(w, at, seed, range(reps))):
                n += np.bincount(i * every + base[k[at]] + _bin(hi, s.parts[k[at]] * BINS), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bin", "n"])

    n = np.zeros((reps + 1) * every, np.int64)
    for r in texts.over(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        n[r.bin] = r.n
    n = n.reshape(reps + 1, every)
    return {int(k): np.c_[np.zeros(reps + 1, np.int64), np.cumsum(n[:, base[k] : base[k] + s.parts[k] * BINS], 1)] for k in np.flatnonzero(s.parts > 1)}


def sums(x: np.ndarray, y: np.ndarray) -> list[float]:
    return [float(len(x)), float(x.sum()), float(y.sum()), float(x @ x), float(y @ y), float(x @ y)]


#: What a block of a bucket holds: words that are both keyed and drawn there, words keyed there, and from DRAWN on words drawn there in a replicate.
BOTH, KEYED, DRAWN = 0, 1, 2


def neighbours(docs: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, n, x, y, xx, yy, xy): sums over words and the ones before in their lines, of their surprise less its mean for place and length: as written (rep -1) and dealt anew within source, place and length.

    The deal is that of `permute_within` over the hash of document and place. Documents without a number take part as
    written only, since they have no hash. The deal is exact: equal first halves of two
    hashes are told apart by the second. Runs a job for the strata, and one for large strata's bins.
    """
    texts = Texts(docs)
    s = strata(texts)
    below = bins(texts, s, reps, seed)
    starts = {k: np.array([[np.searchsorted(x[i], x[0, p * BINS], "right") - 1 for p in range(int(s.parts[k]))] for i in range(1, reps + 1)]) for k, x in below.items()}
    ends = {k: np.array([[np.searchsorted(x[i], x[0, (p + 1) * BINS], "left") for p in range(int(s.parts[k]))] for i in range(1, reps + 1)]) for k, x in below.items()}
    schema = "side long, slice long, kind int, block binary"

    def run(tag: int, words: Iterator[Read]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() * 2 + tag
        for i, w in enumerate(words):
            if len(w.code):
                yield from told(w, (part << 24) + i)
        w = None
        _trim()

    def told(w: Read, number: int) -> Iterator[pa.RecordBatch]:
        def row(side: int, kind: int, block: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([side]), pa.array([number]), pa.array([kind], pa.int32()), pa.array([block])], names=["side", "slice", "kind", "block"])

        value, k, kinds = s.values(w), s.of(w), len(w.names)
        seen = np.zeros(CELLS * kinds, bool)
        seen[w.cell * kinds + w.code] = True
        number_of = np.cumsum(seen, dtype=np.int32) - 1
        distinct = np.flatnonzero(seen)
        cell, distinct = distinct // kinds, np.rint((value[distinct % kinds] - s.mean[distinct // kinds]) * UNIT).astype(np.int64)
        order = np.lexsort((distinct, cell))  # by cell, so that a bucket's values lie together
        place_of = np.empty(len(order), np.int32)
        place_of[order], distinct = np.arange(len(order)), distinct[order]
        own = place_of[number_of[w.cell * kinds + w.code]]

        def send(side: int, kind: int, at: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.diff(w.doc[at], prepend=-1))
            gap = np.diff(w.seq[at], prepend=0)
            gap[first] = w.seq[at][first]
            low, high = own[at].min(), own[at].max() + 1
            used = np.zeros(high - low, bool)
            used[own[at] - low] = True
            local = np.cumsum(used, dtype=np.int32) - 1
            columns = [w.ids.take(pa.array(w.doc[at][first])).to_numpy(zero_copy_only=False), np.diff(first, append=len(at)).astype(np.uint32), gap.astype(np.uint32), local[own[at] - low].astype(np.uint32), deltas(distinct[low:high][used]), k[at].astype(np.uint32)]
            return row(side, kind, pack(_NO_NAMES, *columns))

        bucket = np.where(w.numbered, s.first[k], -1)
        split = np.flatnonzero((s.parts[k] > 1) & w.numbered)
        drawn = []
        if len(split):
            hashes = _hashes(w, split, seed, range(reps))
            bucket[split] += _bin(hashes[0], s.parts[k[split]] * BINS) // BINS
            for x in np.unique(k[split]).tolist():
                at = split[k[split] == x]
                for rep in range(reps):
                    b = _bin(hashes[rep + 1][k[split] == x], s.parts[[x]] * BINS)
                    for p in range(int(s.parts[x])):
                        if len(got := at[(b >= starts[x][rep, p]) & (b < ends[x][rep, p])]):
                            drawn.append((int(s.first[x]) + p, DRAWN + rep, got))
        order = np.argsort(bucket.astype(np.int16 if s.buckets < 1 << 15 else np.int64), kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-2, append=-2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            if (side := int(bucket[at[0]])) >= 0:
                yield send(side, KEYED if s.parts[k[at[0]]] > 1 else BOTH, at)
        for side, kind, at in drawn:
            yield send(side, kind, at)
        x = distinct[own] / UNIT
        written = sums(x[1:][w.paired], x[:-1][w.paired])
        used, local = np.unique(bucket, return_inverse=True)
        yield row(-1 - number, -1, pack(_NO_NAMES, np.array(written), used, local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), np.packbits(w.paired)))

    def deal(key: tuple, table: pa.Table) -> pa.Table:
        """What each slice's words get, by bucket; the slices' own rows are handed on."""
        side = key[0].as_py()
        if side < 0:
            return pa.table({"slice": table["slice"], "bucket": table["side"], "block": table["block"]})
        table = table.sort_by([("kind", "ascending"), ("slice", "ascending")])
        kinds, slices, blocks = table["kind"].to_numpy(), table["slice"].to_pylist(), [unpack(x)[1] for x in table["block"].to_pylist()]
        values, at = np.unique(np.concatenate([np.cumsum(x[4]) for x in blocks]), return_inverse=True)
        places = np.split(at.astype(np.int32), np.cumsum([len(x[4]) for x in blocks])[:-1])

        def words(kind: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
            """Document numbers, places, values and strata."""
            held = [(x, p) for x, p, q in zip(blocks, places, kinds, strict=True) if q == kind]
            if not held:
                return pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
            seq = []
            for x, _ in held:
                far, last = np.cumsum(x[2].astype(np.int64)), np.cumsum(x[1].astype(np.int64))
                seq.append(far - np.repeat(np.r_[0, far[last[:-1] - 1]], x[1]))
            return pa.array(np.concatenate([np.repeat(x[0], x[1]) for x, _ in held])), np.concatenate(seq), np.concatenate([p[x[3]] for x, p in held]), np.concatenate([x[5] for x, _ in held])

        def in_order(stratum: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
            at = ordered(hi, lo)
            if len(stratum) and (stratum != stratum[0]).any():
                names = np.unique(stratum)
                local = np.searchsorted(names, stratum).astype(np.uint16 if len(names) < 1 << 16 else np.int64)
                at = at[np.argsort(local[at], kind="stable")]
            return at

        kind = BOTH if (kinds == BOTH).any() else KEYED
        ids, seq, value, stratum = words(kind)
        key = keys(ids, seq)
        del ids, seq
        slots = in_order(stratum, *key).astype(np.int32)
        got = []
        for rep in range(reps):
            new = np.empty_like(value)
            if kind == BOTH:
                new[slots] = value[in_order(stratum, *md5_of_hex(f"{seed}|{rep}|", *key))]
            elif len(slots):
                k = int(stratum[0])
                p = side - int(s.first[k])
                ids, seq, drawn, _ = words(DRAWN + rep)
                order = ordered(*md5_of_hex(f"{seed}|{rep}|", *keys(ids, seq)))
                skipped = int(below[k][0, p * BINS] - below[k][rep + 1, starts[k][rep, p]])
                new[slots] = drawn[order[skipped : skipped + len(slots)]]
            got.append(new)
        out, first = [], 0
        for x, q in zip(blocks, kinds, strict=True):
            if q != kind:
                continue
            n = len(x[3])
            mine = [g[first : first + n] for g in got]
            used = np.zeros(len(values), bool)
            for g in mine:
                used[g] = True
            local = np.cumsum(used, dtype=np.int32) - 1
            out.append(pack(_NO_NAMES, deltas(values[used]), *(local[g].astype(np.uint32) for g in mine)))
            first += n
        mine = [x for x, q in zip(slices, kinds, strict=True) if q == kind]
        del blocks, places, at, got, key, value, stratum, slots
        _trim()
        return pa.table({"slice": pa.array(mine, pa.int64()), "bucket": pa.array([side] * len(mine), pa.int64()), "block": pa.array(out, pa.binary())})

    def met(key: tuple, table: pa.Table) -> pa.Table:
        blocks = dict(zip(table["bucket"].to_pylist(), table["block"].to_pylist(), strict=True))
        written, used, local, bits = unpack(blocks.pop(-1 - key[0].as_py()))[1]
        paired = np.unpackbits(bits, count=len(local) - 1).astype(bool)
        rows = [[-1, *written.tolist()]]
        x = np.full((reps, len(local)), np.nan)
        order = np.argsort(local, kind="stable")
        cuts = np.searchsorted(local[order], np.arange(len(used) + 1))
        for b, lo, hi in zip(used.tolist(), cuts, cuts[1:], strict=False):
            if b >= 0:
                table, *own = unpack(blocks[b])[1]
                values = np.cumsum(table) / UNIT
                for rep in range(reps):
                    x[rep, order[lo:hi]] = values[own[rep]]
        numbered = used[local] >= 0
        paired &= numbered[1:]  # a document has a number or none
        rows += [[rep, *sums(x[rep, 1:][paired], x[rep, :-1][paired])] for rep in range(reps)]
        return pa.table({name: pa.array([r[i] for r in rows], pa.int32() if name == "rep" else pa.float64()) for i, name in enumerate(["rep", "n", "x", "y", "xx", "yy", "xy"])})

    back = texts.over(run, schema).groupBy("side").applyInArrow(deal, "slice long, bucket long, block binary")
    total = back.groupBy("slice").applyInArrow(met, "rep int, n double, x double, y double, xx double, yy double, xy double").groupBy("rep")
    return total.agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]).where("n > 0")

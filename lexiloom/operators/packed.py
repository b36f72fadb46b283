"""Words dealt to buckets as packed columns: md5 of many short texts at once, and shuffles of all words over their hash.

Where words have to meet far from their documents, a slice of texts sends each bucket one compressed block of codes with
its own list of words, in place of a row for each word.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.bags import Words, apart, slices

_TURNS = np.array([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4, np.uint32)
_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
#: Texts hashed at a time, so that their state stays in the cache.
HASHED_AT_ONCE = 1 << 15
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint16)


def _digests(words: list[np.ndarray], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """md5 of one block each: its first words (later ones are zero), and its length in bits."""
    m: list = [*words, *[None] * (16 - len(words))]
    m[14] = bits
    n = len(bits)
    first = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, x, np.uint32) for x in first)
    f, turned = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if m[g] is not None:
            f += m[g]
        f += _ADDED[i]
        np.left_shift(f, _TURNS[i], out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b, c, d = (x.byteswap().astype(np.uint64) for x in (a + first[0], b + first[1], c + first[2], d + first[3]))
    return a << np.uint64(32) | b, c << np.uint64(32) | d


def md5_of_hex(lead: str, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """md5 of `lead` followed by the hexadecimal digits of a hash, as `md5` gives it."""
    start = lead.encode()
    if len(start) > 23:  # more than one block of md5
        return md5(pa.array([f"{lead}{x:016x}{y:016x}" for x, y in zip(hi.tolist(), lo.tolist(), strict=True)], pa.string()))
    size = len(start) + 32
    out = np.empty((2, len(hi)), np.uint64)
    for at in range(0, len(hi), HASHED_AT_ONCE):
        own = slice(at, at + HASHED_AT_ONCE)
        n = len(hi[own])
        block = np.zeros((n, 56), np.uint8)
        block[:, : len(start)] = np.frombuffer(start, np.uint8)
        for half, x in enumerate((hi, lo)):
            block[:, len(start) + 16 * half : len(start) + 16 * half + 16] = _HEX[x[own].astype(">u8").view(np.uint8).reshape(n, 8)].view(np.uint8).reshape(n, 16)
        block[:, size] = 0x80
        out[:, own] = _digests([np.ascontiguousarray(x) for x in block.view("<u4").T[: size // 4 + 1]], np.full(n, 8 * size, np.uint32))
    return out[0], out[1]


def md5(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First and last 8 bytes of the texts' md5, big-endian, so that they order as the hexadecimal digests do."""
    texts = texts.cast(pa.large_string())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if size.max(initial=0) > 55:  # more than one block of md5
        digests = np.frombuffer(b"".join(hashlib.md5(x.encode()).digest() for x in texts.to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64)
        return digests[:, 0], digests[:, 1]
    flat = np.frombuffer(b"".join(_bytes(texts)), np.uint8)
    start = np.cumsum(size) - size
    out = np.empty((2, len(size)), np.uint64)
    for lo in range(0, len(size), HASHED_AT_ONCE):
        n, at = size[lo : lo + HASHED_AT_ONCE], start[lo : lo + HASHED_AT_ONCE]
        width = int(n.max()) + 1
        block = np.zeros((len(n), 64), np.uint8)
        places = np.arange(width)
        inside = places < n[:, None]
        block[:, :width][inside] = flat[at[0] : at[0] + n.sum()]
        block[np.arange(len(n)), n] = 0x80
        block[:, 56:58] = (8 * n).astype("<u2").view(np.uint8).reshape(-1, 2)
        out[:, lo : lo + HASHED_AT_ONCE] = _digests([np.ascontiguousarray(x) for x in block.view("<u4").T[: -(-width // 4)]], block.view("<u4")[:, 14].copy())
    return out[0], out[1]


def ordered(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Places in order of a hash, whose second half is only asked where first halves are equal."""
    at = np.argsort(hi)
    return np.lexsort((lo, hi)) if (hi[at][1:] == hi[at][:-1]).any() else at


def _bytes(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of an array of large strings without nulls."""
    if len(texts):
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        yield memoryview(texts.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])]


def joined(*parts) -> pa.Array:
    """Texts and numbers of each row joined by '|', as the hashes want them; nulls are left out."""
    return pc.binary_join_element_wise(*[x if isinstance(x, str) else (x if isinstance(x, pa.Array) else pa.array(x)).cast(pa.string()) for x in parts], "|", null_handling="skip")


def pack(names: pa.Array, *columns: np.ndarray) -> bytes:
    """Words and columns of whole numbers, compressed."""
    names = names.cast(pa.large_string())
    size = pc.binary_length(names).to_numpy(zero_copy_only=False)
    held = [(str(x.dtype), len(x), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) for x in (size.astype(np.uint32), *columns)]  # high bytes lie together
    raw = pickle.dumps((b"".join(_bytes(names)), held))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(block: bytes) -> tuple[pa.Array, list[np.ndarray]]:
    text, held = pickle.loads(pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True))
    columns = [np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind) for kind, n, raw in held]
    ends = np.r_[0, np.cumsum(columns[0].astype(np.int64))]
    return pa.LargeStringArray.from_buffers(len(columns[0]), pa.py_buffer(ends), pa.py_buffer(text)), columns[1:]


def together(names: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """All words of several lists once, and of each list their places there."""
    every = pa.chunked_array(names, pa.large_string()).combine_chunks().dictionary_encode()
    at = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return every.dictionary, np.split(at, np.cumsum([len(x) for x in names])[:-1])


#: Bytes of text that make one set of blocks, and that a bucket gets of each replicate, about.
PACKED_BYTES, BUCKET_BYTES = 8 << 20, 12 << 20


class Placed:
    """Words of documents in order of document, line and place, ties by the word. id: document numbers of `doc`; code, doc, line, pos, row: of each word; names: the words. Texts of one number are one document, as in SQL."""

    def __init__(self, text: pa.Array, doc: np.ndarray, ids: pa.Array) -> None:
        w = Words(text, 0)
        self.names, self.ids, self.code, self.doc, self.pos, self.row = w.names, ids, w.code, doc[w.row], w.pos, w.row
        self.line = w.line - w.line_base[w.row]
        if len(ids) < len(text):
            rank = np.empty(len(w.names), np.int64)
            rank[pc.sort_indices(w.names).to_numpy()] = np.arange(len(w.names))
            order = np.lexsort((rank[self.code], self.pos, self.line, self.doc))
            self.code, self.doc, self.pos, self.line, self.row = self.code[order], self.doc[order], self.pos[order], self.line[order], self.row[order]
        first = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.seq = np.arange(len(self.code)) - np.repeat(first, np.diff(first, append=len(self.code)))


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Placed]]:
    """Of batches (doc_id, texts or text, ...): slices with their words."""
    for b in batches:
        if pa.types.is_list(b.column(1).type):
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                text = one.column(1).flatten()
                yield one, Placed(text, np.zeros(len(text), np.int64), one.column(0))
        else:
            for x in slices(iter([b]), 1, PACKED_BYTES):
                yield x, Placed(x.column(1), np.arange(x.num_rows), x.column(0))


def over_words(docs: DataFrame, carry: list[str], run, schema: str) -> DataFrame:
    """A kernel over `placed` words of (doc_id, lower-cased text, *carry). Documents that share a number, and all the columns carried, come as one. Counts the numbers, so it runs a job."""
    once, more = apart(docs, nulls=True)
    kernel = lambda batches: run(placed(batches))
    out = once.select("doc_id", F.lower("text").alias("t_"), *carry).mapInArrow(kernel, schema)
    if more is None:
        return out
    lists = more.groupBy("doc_id", *carry).agg(F.sort_array(F.collect_list(F.lower("text"))).alias("t_")).select("doc_id", "t_", *carry)
    return out.unionByName(lists.mapInArrow(kernel, schema))


def buckets(docs: DataFrame, size: int) -> int:
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size))


def line_shuffle_entropy(docs: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, h): entropy of a word given the one before in its line: as written (rep -1), and with the words of a line in order of their hashes.

    Pairs are counted by slices of texts and meet by the word before, in blocks.
    """
    n = buckets(docs, BUCKET_BYTES)

    def run(words: Iterator[tuple[pa.RecordBatch, Placed]]) -> Iterator[pa.RecordBatch]:
        for _, w in words:
            if not len(w.code):
                continue
            kinds, line = len(w.names), np.r_[0, np.cumsum((w.line[1:] != w.line[:-1]) | (w.doc[1:] != w.doc[:-1]))].astype(np.int32)
            side, ids = np.array([zlib.crc32(x.as_buffer()) % n for x in w.names]), w.ids.take(pa.array(w.doc))
            found = []
            for rep in range(-1, reps):
                code = w.code
                if rep >= 0:
                    hi, lo = md5(joined(f"{seed}|{rep}", ids, w.line, w.pos))
                    at = ordered(hi, lo)
                    code = code[at[np.argsort(line[at], kind="stable")]]
                same = line[1:] == line[:-1]
                pairs, c = np.unique(code[:-1][same] * kinds + code[1:][same], return_counts=True)
                order = np.argsort(side[pairs // kinds], kind="stable")
                pairs, c = pairs[order], c[order]
                found.append((pairs, c, np.searchsorted(side[pairs // kinds], np.arange(n + 1))))
            for k in range(n):
                own = [(p[cut[k] : cut[k + 1]], c[cut[k] : cut[k + 1]]) for p, c, cut in found]
                if not any(len(p) for p, _ in own):
                    continue
                used = np.unique(np.concatenate([x for p, _ in own for x in (p // kinds, p % kinds)]))
                columns = [x.astype(np.uint32) for p, c in own for x in (np.searchsorted(used, p // kinds), np.searchsorted(used, p % kinds), c)]
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pack(w.names.take(pa.array(used)), *columns)])], names=["side", "block"])

    def counted(table: pa.Table) -> pa.Table:
        held = [unpack(x) for x in table["block"].to_pylist()]
        names, at = together([x for x, _ in held])
        out = []
        for rep in range(-1, reps):
            i = 3 * (rep + 1)
            keys = np.concatenate([a[x[i]] * len(names) + a[x[i + 1]] for a, (_, x) in zip(at, held, strict=True)])
            c = np.concatenate([x[i + 2] for _, x in held]).astype(np.float64)
            keys, own = np.unique(keys, return_inverse=True)
            c = np.bincount(own, c, len(keys))
            g = np.bincount(keys // len(names), c, len(names))
            g = g[g > 0]
            if len(g):
                out.append((rep, float(g @ np.log2(g) - c @ np.log2(c)), float(g.sum())))
        return pa.table({"rep": pa.array([x[0] for x in out], pa.int32()), "s": pa.array([x[1] for x in out], pa.float64()), "n": pa.array([x[2] for x in out], pa.float64())})

    blocks = over_words(docs, [], run, "side long, block binary")
    return blocks.groupBy("side").applyInArrow(counted, "rep int, s double, n double").groupBy("rep").agg((F.sum("s") / F.sum("n")).alias("h"))


#: Bytes of text for each bucket of a shuffle of single words.
SHUFFLED_BYTES = 32 << 20


def shuffled_repeats(docs: DataFrame, by: str, reps: int, seed: str) -> DataFrame:
    """(by, rep, pairs, same): neighbours, and equal ones, among all words of a group in order of the hash of seed, replicate, document and place.

    Words go to buckets of the hash with their document and place, from which the hash is made again there; the edges of
    buckets meet by a row for each.
    """
    n = buckets(docs, SHUFFLED_BYTES)

    def run(words: Iterator[tuple[pa.RecordBatch, Placed]]) -> Iterator[pa.RecordBatch]:
        for b, w in words:
            if not len(w.code):
                continue
            order = pc.sort_indices(w.names)
            names, rank = w.names.take(order), np.empty(len(w.names), np.int64)
            rank[order.to_numpy()] = np.arange(len(rank))
            code, ids = rank[w.code], w.ids.take(pa.array(w.doc))
            group = b.column(2).dictionary_encode()
            kind = pc.fill_null(group.indices, len(group.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)[w.doc]
            for rep in range(reps):
                hi, _ = md5(joined(f"{seed}|{rep}", ids, w.seq))
                side = kind * n + ((hi >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                at = np.argsort(side, kind="stable")
                cuts = np.flatnonzero(np.diff(side[at], prepend=-1, append=-1))
                for x, y in zip(cuts, cuts[1:], strict=False):
                    own = at[x:y]
                    used, local = np.unique(code[own], return_inverse=True)
                    first = np.flatnonzero(np.diff(w.doc[own], prepend=-1))
                    held = w.ids.take(pa.array(w.doc[own][first]))
                    gap = np.diff(w.seq[own], prepend=0)
                    gap[first] = w.seq[own][first]
                    columns = [pc.fill_null(held, 0).to_numpy(zero_copy_only=False), held.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), np.diff(first, append=y - x).astype(np.uint32), gap.astype(np.uint32), local.astype(np.uint32)]
                    k = int(side[own[0]])
                    name = group.dictionary[k // n].as_py() if k // n < len(group.dictionary) else None
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([rep], pa.int32()), pa.array([k % n]), pa.array([pack(names.take(pa.array(used)), *columns)])], names=[by, "rep", "side", "block"])

    def counted(key: tuple, table: pa.Table) -> pa.Table:
        held = [unpack(x) for x in table["block"].to_pylist()]
        names, at = together([x for x, _ in held])
        code = np.concatenate([a[x[4]] for a, (_, x) in zip(at, held, strict=True)])
        ids = np.concatenate([np.repeat(x[0], x[2]) for _, x in held])
        null = np.concatenate([np.repeat(x[1], x[2]) for _, x in held]) == 0
        seq = []
        for _, x in held:
            run_, ends = np.cumsum(x[3].astype(np.int64)), np.cumsum(x[2].astype(np.int64))
            seq.append(run_ - np.repeat(np.r_[0, run_[ends[:-1] - 1]], x[2]))
        hi, lo = md5(joined(f"{seed}|{key[1].as_py()}", pa.array(ids, mask=null), np.concatenate(seq)))
        code = code[ordered(hi, lo)]
        edge = lambda i: pa.array([names[int(code[i])].as_py()], pa.string())
        return pa.table({by: pa.array([key[0].as_py()], pa.string()), "rep": pa.array([key[1].as_py()], pa.int32()), "side": pa.array([key[2].as_py()], pa.int64()), "n": pa.array([len(code)], pa.int64()), "same": pa.array([int((code[1:] == code[:-1]).sum())], pa.int64()), "first": edge(0), "last": edge(-1)})

    blocks = over_words(docs, [by], run, f"`{by}` string, rep int, side long, block binary")
    met = blocks.groupBy(by, "rep", "side").applyInArrow(counted, f"`{by}` string, rep int, side long, n long, same long, first string, last string")
    met = met.withColumn("edge", (F.col("first") == F.lag("last").over(Window.partitionBy(by, "rep").orderBy("side"))).cast("long"))  # a row for each bucket
    return met.groupBy(by, "rep").agg((F.sum("n") - 1).alias("pairs"), (F.sum("same") + F.coalesce(F.sum("edge"), F.lit(0))).alias("same"))

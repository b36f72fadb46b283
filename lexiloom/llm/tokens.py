"""Token ids in bit-plane shuffled binary files.

File layout (little endian):

    magic "LXBP0001"
    chunks   each of up to CHUNK ids: bit planes 0, 1, ... of the ids, each packed to bytes and compressed by zstandard
    index    zstandard of four arrays, each led by its length as u64: chunk offsets (u64), ids per chunk (u32), planes
             per chunk (u8), bytes per plane (u32, all chunks one after the other); then two arrays for the documents:
             doc ids (i64, null as the least value), ids per document (u32)
    footer   offset of the index (u64), magic

A chunk holds the same number of ids whatever the documents are, and only as many planes as its largest id has bits,
so any chunk can be read alone.
"""

from __future__ import annotations

import io
import itertools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import batches_of, fs_write, lean, materialize, open_fs, scratch, slices, word_codes

MAGIC = b"LXBP0001"
CHUNK = 1 << 16
LEVEL = 3
NO_ID = np.iinfo(np.int64).min
#: Bytes of words, pieces and their ids that a task remembers before it starts afresh.
KNOWN_BYTES = 48 << 20
#: Rows that are handed to a task at a time.
BATCH_ROWS = 1000
#: Bytes of text that are encoded at a time: each time, all that is known is indexed again.
TEXT_BYTES = 6 << 20


class Table:
    """Arrays of ids by number, kept end to end."""

    def __init__(self) -> None:
        self.flat, self.first, self.size = (np.zeros(1 << 10, kind) for kind in (np.uint32, np.int64, np.int64))
        self.ids, self.rows = 0, 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        for name, need in (("flat", self.ids + len(ids)), ("first", self.rows + len(size)), ("size", self.rows + len(size))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
        self.flat[self.ids : self.ids + len(ids)] = ids
        self.first[self.rows : self.rows + len(size)] = self.ids + np.cumsum(size) - size
        self.size[self.rows : self.rows + len(size)] = size
        self.ids, self.rows = self.ids + len(ids), self.rows + len(size)

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given rows one after the other, and how many each has."""
        n = self.size[rows]
        return self.flat[np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Known:
    """Distinct strings, numbered as they come, and the ids of each."""

    def __init__(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.ids = Table()

    def numbers(self, names: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of distinct names, and those of them that are new: they get the next numbers, in their order."""
        of = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(of < 0)
        of[missing] = len(self.names) + np.arange(len(missing))
        return of, names.take(pa.array(missing))

    def add(self, names: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids.add(ids, size)

    @property
    def nbytes(self) -> int:
        return self.names.nbytes + 4 * self.ids.ids + 16 * self.ids.rows


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins what white space parts.

    Each distinct word is encoded once and remembered, which gives the same ids as encoding the text. Words of printable
    ASCII and Latin-1 letters are first lower-cased and cut where this tokenizer cuts them (fixed pattern), so that
    `The`, `the,` and `the.` share a piece, and pieces skip the tokenizer's own normaliser and cutter; others are encoded
    as they are. Tokenizers that cut otherwise get every word as it is. What is remembered are Arrow strings and arrays
    of at most KNOWN_BYTES; a task that has seen more starts afresh.
    """

    PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9]|[^a-zß-öø-ÿªµº0-9]+)"
    PLAIN = r"^[!-~À-ÖØ-öø-ÿ]+$"
    #: Between pieces that are encoded together; no piece holds it.
    GAP = "\0"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.own = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.Split(self.GAP, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        gap = self._bare_ids([self.GAP])[0]
        self.gap, self.cuts = (gap[0] if len(gap) == 1 else None), True
        self.forget()
        probe = "Thé,IT'S 2nd&*ÀÖ'reß÷ª! a<|b x's. Ünïcode's12 naïve"
        ids, _ = self.encode(pa.array([probe]), None)
        self.cuts = self.gap is not None and ids.tolist() == self.tokenizer.encode(probe, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Known(), Known()

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words as the tokenizer has them, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _bare_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts cut at gaps alone; one tokenizer does for both kinds of text, since its vocabulary is most of a task's memory."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.bare
        try:
            return [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.own

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, many encoded as one text with gaps between them, and how many each has."""
        names = pieces.to_pylist()
        flat = self._bare_ids([self.GAP.join([*names[at : at + 1024], ""]) for at in range(0, len(names), 1024)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in flat)])
        ends = np.flatnonzero(flat == self.gap)
        if len(ends) != len(names):
            raise ValueError("the tokenizer makes the gap's id of something else")
        return np.delete(flat, ends), np.diff(np.r_[-1, ends]) - 1

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Adds new words: plain ones by way of their pieces, then others whole; their numbers."""
        base = len(self.words.names)
        plain = pc.and_(pc.match_substring_regex(new, self.PLAIN), pc.invert(pc.match_substring(new, "<|"))) if self.cuts else pa.array(np.zeros(len(new), bool))
        words, odd = new.filter(plain), new.filter(pc.invert(plain))
        if len(words):
            cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words), self.PIECES, "\\1" + self.GAP), self.GAP)
            many = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64) - 1  # the last part is empty
            parts = cut.flatten()
            coded = parts.filter(pc.not_equal(parts, "")).dictionary_encode()
            of, fresh = self.pieces.numbers(coded.dictionary)
            if len(fresh):
                self.pieces.add(fresh, *self._pieces(fresh))
            ids, n = self.pieces.ids.get(of[coded.indices.to_numpy(zero_copy_only=False)])
            self.words.add(words, ids, sums(n, many))
        if len(odd):
            self.words.add(odd, *self._whole(odd))
        first = plain.to_numpy(zero_copy_only=False)
        return base + np.where(first, np.cumsum(first) - 1, len(words) + np.cumsum(~first) - 1)

    def encode(self, text: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids one after the other (u32, each row ended by `end`) and ids per row."""
        if self.words.nbytes + self.pieces.nbytes > KNOWN_BYTES:
            self.forget()
        codes, per_row, names = word_codes(text)
        of, new = self.words.numbers(names)
        if len(new):
            fresh = of >= len(self.words.names)
            of[fresh] = self._learn(new)
        ids, n = self.words.ids.get(of[codes])
        total = sums(n, per_row)
        if end is None:
            return ids, total
        out = np.full(len(ids) + len(total), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(total + 1) - 1] = False
        out[keep] = ids
        return out, total + 1


def sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(size)
    return (total[ends] - total[ends - size]).astype(np.int64)


def _array(x: np.ndarray) -> bytes:
    return struct.pack("<Q", len(x)) + x.tobytes()


def encode_chunk(ids: np.ndarray, compress) -> list[bytes]:
    """The bit planes of one chunk, each compressed; as many as the largest id has bits, one at least."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    return [compress(np.packbits((ids >> np.uint32(i)).astype(np.uint8) & np.uint8(1)).tobytes()) for i in range(planes)]


def decode_chunk(planes: list[bytes], n: int, decompress) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for i, x in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(decompress(x), np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return out


def file_bytes(docs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], told: dict) -> Iterator[bytes]:
    """Bytes of one file from (doc ids, ids per document, ids) pieces; `told` gets first, last, n_docs and n_ids."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    offsets, counts, planes, sizes, names, lengths = [], [], [], [], [], []
    at, left = len(MAGIC), np.zeros(0, np.uint32)
    yield MAGIC

    def send(ids: np.ndarray) -> bytes:
        nonlocal at
        parts = encode_chunk(ids, compress)
        offsets.append(at)
        counts.append(len(ids))
        planes.append(len(parts))
        sizes.extend(map(len, parts))
        at += sum(map(len, parts))
        return b"".join(parts)

    for doc, size, ids in docs:
        names.append(doc)
        lengths.append(size)
        left = np.concatenate([left, ids])
        full = len(left) // CHUNK * CHUNK
        for a in range(0, full, CHUNK):
            yield send(left[a : a + CHUNK])
        left = left[full:]
    if len(left):
        yield send(left)
    names, lengths = np.concatenate([np.zeros(0, np.int64), *names]), np.concatenate([np.zeros(0, np.int64), *lengths])
    yield zstandard.ZstdCompressor(level=LEVEL).compress(
        b"".join(map(_array, (np.array(offsets, "<u8"), np.array(counts, "<u4"), np.array(planes, "u1"), np.array(sizes, "<u4"), names.astype("<i8"), lengths.astype("<u4"))))
    )
    yield struct.pack("<Q", at) + MAGIC
    told |= {"n_docs": len(names), "n_ids": int(lengths.sum())}


def read_index(f, size: int) -> list[np.ndarray]:
    """The six arrays of a file's index."""
    import zstandard

    f.seek(size - 16)
    tail = f.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file, or cut short")
    at = struct.unpack("<Q", tail[:8])[0]
    f.seek(at)
    raw, pos, out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read(size - 16 - at))).read(), 0, []
    for kind in ("<u8", "<u4", "u1", "<u4", "<i8", "<u4"):
        n = struct.unpack_from("<Q", raw, pos)[0]
        out.append(np.frombuffer(raw, kind, n, pos + 8))
        pos += 8 + n * out[-1].itemsize
    return out


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, ids) pieces of a file, a chunk or a document at a time."""
    import zstandard

    system, base = open_fs(path)
    decompress = zstandard.ZstdDecompressor().decompress
    with system.open_input_file(base) as f:
        offsets, counts, planes, sizes, names, lengths = read_index(f, f.size())
        plane_at = np.r_[0, np.cumsum(planes.astype(np.int64))]
        ends = np.cumsum(lengths.astype(np.int64))
        have, base_at, done = [], 0, 0
        held = 0
        for k in range(len(offsets)):
            own = sizes[plane_at[k] : plane_at[k + 1]].tolist()
            f.seek(int(offsets[k]))
            raw, parts, pos = f.read(sum(own)), [], 0
            for n in own:
                parts.append(raw[pos : pos + n])
                pos += n
            have.append(decode_chunk(parts, int(counts[k]), decompress))
            held += int(counts[k])
            upto = int(np.searchsorted(ends, base_at + held, "right"))
            if upto > done:
                ids = np.concatenate(have)
                n = int(ends[upto - 1]) - base_at
                yield names[done:upto], lengths[done:upto].astype(np.int64), ids[:n]
                have, held, base_at, done = [ids[n:]], held - n, base_at + n, upto
        if done < len(names):  # documents without ids at the end
            yield names[done:], lengths[done:].astype(np.int64), np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes docs and writes one file for each range of doc_ids below folder; the table of files (path, part, n_docs, n_ids, start).

    Files are in ascending doc_id order (null first), and start is the number of ids in the files before. A null text
    is an empty one, which has the end id alone. Repeated rows are written as often as they come; rows that share an id
    lie side by side, by hash of their text. An empty table writes no file. A task writes under a name of its own
    attempt, and only what the table of files names counts, so a repeated task does no harm.
    """
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, told = Encoder(tokenizer), {}
        it = slices(gathered(batches, 1, TEXT_BYTES), 1, TEXT_BYTES)
        first = next(it, None)
        if first is None:
            return

        def pieces():
            for b in _and(first, it):
                ids, size = encoder.encode(b.column(1), end)
                yield b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64), size, ids

        path = fs_write(folder, file_bytes(pieces(), told), f"tokens-{part:06d}-{TaskContext.get().taskAttemptId()}.lxbp")
        yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "n_docs": [told["n_docs"]], "n_ids": [told["n_ids"]]})

    dealt = src.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        files = materialize(dealt.mapInArrow(lean(run), "path string, part int, n_docs long, n_ids long"), "token-files")
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return files.withColumn("start", F.coalesce(before, F.lit(0).cast("long")))


def gathered(batches: Iterator[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until the column number `text` holds `most` bytes; none of the rows is copied more than once."""
    held, size = [], 0
    for b in batches:
        own = pc.sum(pc.binary_length(b.column(text))).as_py() or 0
        if held and size + own > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += own
    if held:
        yield pa.concat_batches(held)


def _and(first, rest):
    yield first
    yield from rest


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian u32) for every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = start
                for names, size, ids in read_file(path):
                    cuts = np.cumsum(size) - size
                    data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[cuts, size.sum()].astype(np.int64) * 4), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64(), mask=names == NO_ID), pa.array(at + cuts), pa.array(size), data.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    at += int(size.sum())

    spread = files.select("path", "start").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_table(docs: DataFrame, tokenizer: str, end: int | None = 2) -> DataFrame:
    """Writes docs below the shared folder and reads the files back (see `read_tokens`)."""
    return read_tokens(write_tokens(docs, scratch(docs.sparkSession, "tokens"), tokenizer, end))


def op6_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_table(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Benchmark decontamination: n-gram seeds, an upper bound of the score, then Smith-Waterman alignment.

Words are lower-cased and stripped of everything but letters and digits; words without any vanish. Every n-gram of a
test item is a seed, however common it is: an edited passage that lies in many documents makes its own grams common, so
no count of documents tells it from everyday words. A stretch of a document around seeds of an item is aligned with the
item (match 2, mismatch -1, gap -2) unless a bound shows that it cannot reach the threshold, and scored by the best
local alignment over that of the item with itself. The bound costs no result: an alignment gains at most 2 for a word of
the document that the item holds, and loses at least 1 for any other.

Documents are never shuffled: the index of the test items, which is read in blocks of bounded size, goes to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import hash_names, lean, mix64, slices, word_codes

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -2
THRESHOLD = 0.5
#: Text of test items that is indexed and broadcast at a time, in characters.
BLOCK_CHARS = 8 << 20
_NOISE = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    return _NOISE.sub("", word.lower())


@dataclass
class Index:
    """Test items of one block."""

    items: list[int]
    words: list[np.ndarray]
    sets: list[np.ndarray]  # sorted distinct words
    grams: np.ndarray  # sorted hashes
    first: np.ndarray  # where each gram's postings begin; one more at the end
    item: np.ndarray
    place: np.ndarray


def hashed(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of all rows, one after the other, and words per row."""
    codes, per_row, names = word_codes(text)
    bare = pa.array([plain(x) for x in names.to_pylist()], pa.string())
    value = mix64(hash_names(bare) + np.uint64(1))
    empty = np.array(pc.equal(bare, "")) if len(bare) else np.zeros(0, bool)
    keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
    row = np.repeat(np.arange(len(per_row)), per_row)
    return value[codes][keep] if len(codes) else np.zeros(0, np.uint64), np.bincount(row[keep], minlength=len(per_row)).astype(np.int64)


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    out = words[: max(0, len(words) - n + 1)].copy()
    for i in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out


def build_index(items: list[tuple[int, str | None]], n: int = GRAM) -> Index:
    """Items with fewer than n words have no n-gram and take no part."""
    ids, words, keys, item, place = [], [], [], [], []
    for item_id, text in items:
        w, _ = hashed(pa.array([text], pa.string()))
        if len(w) < n or item_id is None:
            continue
        g = _grams(w, n)
        keys.append(g)
        item.append(np.full(len(g), len(ids)))
        place.append(np.arange(len(g)))
        ids.append(item_id)
        words.append(w)
    if not ids:
        return Index([], [], [], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, item, place = (np.concatenate(x) for x in (keys, item, place))
    order = np.argsort(keys, kind="stable")
    keys, item, place = keys[order], item[order], place[order]
    grams, first = np.unique(keys, return_index=True)
    return Index(ids, words, [np.unique(w) for w in words], grams, np.r_[first, len(keys)], item, place)


def _hits(index: Index, words: np.ndarray, per_row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position in the row, gram) wherever a row holds a gram of the index."""
    if len(words) < n or not len(index.grams):
        return (np.zeros(0, np.int64),) * 3
    g = _grams(words, n)
    at = np.minimum(np.searchsorted(index.grams, g), len(index.grams) - 1)
    where = np.flatnonzero(index.grams[at] == g)
    ends = np.cumsum(per_row)
    row = np.searchsorted(ends, where, "right")
    inside = where + n <= ends[row]
    where, row = where[inside], row[inside]
    return row, where - (ends - per_row)[row], at[where]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of a with b, and its end (exclusive) in a and in b; one row of the table at a time."""
    steps = -GAP * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, x in enumerate(a):
        up = np.maximum(row + GAP, 0)
        up[1:] = np.maximum(up[1:], row[:-1] + np.where(b == x, MATCH, MISMATCH))
        row = np.maximum.accumulate(up + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def _bound(own: np.ndarray, passage: np.ndarray) -> int:
    """No local alignment of the passage with an item of the (sorted) words `own` scores more."""
    held = own[np.minimum(np.searchsorted(own, passage), len(own) - 1)] == passage
    c = np.r_[0, np.cumsum(np.where(held, MATCH, MISMATCH))]
    return int((c - np.minimum.accumulate(c)).max())


def _matches(index: Index, text: pa.Array, n: int, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, score, first and last word in the row, seeds) for each pair that scores threshold or more."""
    words, per_row = hashed(text)
    row, pos, gram = _hits(index, words, per_row, n)
    if not len(row):
        return []
    many = np.diff(index.first)[gram]
    row, pos = np.repeat(row, many), np.repeat(pos, many)
    post = np.repeat(index.first[:-1][gram], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = index.item[post]
    order = np.lexsort((pos, item, row))
    row, pos, item = row[order], pos[order], item[order]
    size = np.array([len(w) for w in index.words])
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > 2 * size[item[1:]]), True]
    cuts, begins, found = np.flatnonzero(new), np.cumsum(per_row) - per_row, {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        r, k = int(row[a]), int(item[a])
        m = int(size[k])
        lo, hi = max(0, int(pos[a]) - m), min(int(per_row[r]), int(pos[b - 1]) + n + m)
        passage = words[begins[r] + lo : begins[r] + hi]
        if _bound(index.sets[k], passage) / (MATCH * m) < threshold:
            continue
        score, end_item, end = smith_waterman(index.words[k], passage)
        value = score / (MATCH * m)
        if value >= threshold and value > found.get((r, k), (0.0,))[0]:
            _, _, back = smith_waterman(index.words[k][:end_item][::-1], passage[:end][::-1])
            found[r, k] = (value, lo + end - back, lo + end - 1, int(b - a))
    return [(r, index.items[k], *v) for (r, k), v in sorted(found.items())]


def _blocks(benchmark: DataFrame, item: str, item_text: str, n: int) -> Iterator[Index]:
    """The index of each block of test items."""
    src = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = src.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    blocks = -(-total // BLOCK_CHARS) or 1
    for k in range(blocks):
        own = src.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else src
        yield build_index(sorted(map(tuple, own.collect()), key=str), n)  # about BLOCK_CHARS of text


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word, n_seeds) for each document and test item that score `threshold` or more.

    Positions count the plain words of the document. Null texts hold nothing; test items without id or with fewer than
    n words take no part; repeated rows are reported as often as they come, and those without doc_id with a null id.
    Other columns are ignored; empty tables give an empty result.
    """
    kinds = "doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"
    out = None
    for index in _blocks(benchmark, item, item_text, n):
        given = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            index = given.value
            for b in slices(batches, 1):
                rows = _matches(index, b.column(1), n, threshold)
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *map(pa.array, rest)], names=["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), kinds)
        out = own if out is None else out.unionByName(own)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = GRAM) -> DataFrame:
    """docs without the rows whose text holds a test item; columns as they are, and no shuffle.

    Null and empty texts hold nothing; repeated rows and rows without doc_id are judged one by one; a text of any length
    is read whole. Without test items, all rows stay; an empty table stays empty.
    """
    at = docs.columns.index("text")
    for index in _blocks(benchmark, "item_id", "text", n):
        given = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            index = given.value
            for b in slices(batches, at):
                bad = {r for r, *_ in _matches(index, b.column(at), n, threshold)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)])) if bad else b

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Substring dedup by level-wise doubling.

Windows of `window` words that also start in a document with a smaller id are cut out. Windows are compared level by
level: short ones first, and only those that repeat across documents are extended to twice the length.

* Level 1 (a quarter, 13 of 50 words). Which short windows stand for a long one is settled by winnowing: of the short
  windows inside a long one, that with the least hash is its anchor. Equal long windows have equal anchors at equal
  offsets, so no repeat is lost, while one position in about twenty is kept. One row stands for the run of consecutive
  long windows that share an anchor.
* Level 2 (half, 25 words): the anchor extended to the left and to the right. A long window contains one or both.
* Level 3 (50 words and more): whole runs. A run that also lies in a smaller document goes at once. The first
  document of a run whose anchor also has other runs is opened into its single windows, which are compared exactly.

Each level is a partial aggregate (smallest and largest document of a hash) and a join with the survivors. The aggregate
is written before the rows meet it, so that the join has shuffles of its own and adaptive execution can split a hot
hash; nothing is collected by group. Hashes of whole windows have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import hash_names, lean, materialize, mix64, slices, word_codes

#: Odd multipliers of the two 64-bit hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ANCHOR = "a int, s1 int, s2 int, h1 long, hl long, hr long, x1 long, x2 long"


class Spans:
    """Hashes of any spans of one sequence of word hashes, by prefix sums of words times powers of an odd base, modulo 2^64."""

    def __init__(self, words: np.ndarray) -> None:
        self.parts = []
        for base in BASES:
            power = np.full(len(words) + 1, base, np.uint64)
            back = np.full(len(words) + 1, pow(base, -1, 1 << 64), np.uint64)
            power[0] = back[0] = 1
            power, back = np.cumprod(power), np.cumprod(back)
            total = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * power[:-1], out=total[1:])
            self.parts.append((total, back))

    def hash(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        total, back = self.parts[which]
        return mix64((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def lengths(window: int) -> tuple[int, int]:
    half = -(-window // 2)
    return -(-half // 2), half


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value of each window of `width` values, by doubling."""
    n = len(values) - width + 1
    at, have = np.arange(len(values)), 1
    while have * 2 <= width:
        a, b = at[:-have], at[have:]
        at, have = np.where(values[b] < values[a], b, a), have * 2
    a, b = at[:n], at[width - have : width - have + n]
    return np.where(values[b] < values[a], b, a)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    short, half = lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 2 << 20):
            codes, per_row, names = word_codes(b.column(2))
            words = mix64(hash_names(names) + np.uint64(1))[codes]
            ends = np.cumsum(per_row)
            begins = ends - per_row
            whole = [hashlib.sha256(b" ".join(t.split()) if t else b"").digest() for t in b.column(2).cast(pa.large_binary()).to_pylist()]
            known = np.array(b.column(0).is_valid())
            cols, count = [np.zeros(0, np.int64)] * 8, np.zeros(len(per_row), np.int64)
            if len(words) >= window:
                spans = Spans(words)
                at = np.arange(len(words) - short + 1)
                grams = spans.hash(at, at + short, 0)
                anchor = _least(mix64(grams), window - short + 1)
                doc = np.repeat(np.arange(len(per_row)), per_row)
                start = np.arange(len(anchor))
                inside = (start + window <= ends[doc[start]]) & known[doc[start]]
                start, anchor = start[inside], anchor[inside]
                if len(start):
                    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[start[1:]] != doc[start[:-1]])]
                    first = np.flatnonzero(new)
                    last = np.r_[first[1:], len(start)] - 1
                    s1, s2, a, d = start[first], start[last], anchor[first], doc[start[first]]
                    left = np.maximum(a - (half - short), begins[d])
                    right = np.minimum(a + half, ends[d])
                    count = np.bincount(d, minlength=len(per_row))
                    lead = mix64((s2 - s1).astype(np.uint64) * np.uint64(1000003) + (a - s1).astype(np.uint64))
                    x = [spans.hash(s1, s2 + window, k) ^ lead for k in (0, 1)]
                    cols = [a - begins[d], s1 - begins[d], s2 - begins[d], grams[a].view(np.int64), spans.hash(left, a + short, 0).view(np.int64), spans.hash(a, right, 0).view(np.int64), x[0].view(np.int64), x[1].view(np.int64)]
            kinds = [pa.int32()] * 3 + [pa.int64()] * 5
            rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "s1", "s2", "h1", "hl", "hr", "x1", "x2"])
            offsets = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(per_row), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(offsets, rows)], names=["doc_id", "th", "n_words", "whole", "anchors"])

    return docs.mapInArrow(lean(run), f"doc_id long, th long, n_words long, whole binary, anchors array<struct<{', '.join(x.replace(' ', ':', 1) for x in ANCHOR.split(', '))}>>")


def _repeated(rows: DataFrame, *by: str) -> DataFrame:
    """Hashes that lie in two documents at least."""
    return materialize(rows.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(*by), "sub-repeated")


def _window_rows(texts: DataFrame, window: int) -> DataFrame:
    """Every window that starts in one of the spans `open` of a text, with its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 2 << 20):
            codes, per_row, names = word_codes(b.column(2))
            spans = Spans(mix64(hash_names(names) + np.uint64(1))[codes])
            begins = np.cumsum(per_row) - per_row
            lists = b.column(3)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            open_ = lists.flatten()
            d = np.repeat(np.arange(len(size)), size)
            s1, s2 = (np.asarray(open_.field(k)).astype(np.int64) for k in (0, 1))
            n = s2 - s1 + 1
            if not len(n):
                continue
            d = np.repeat(d, n)
            start = np.repeat(s1, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = begins[d] + start
            keys = [pa.array(spans.hash(at, at + window, k).view(np.int64)) for k in (0, 1)]
            row = pa.array(d)
            yield pa.RecordBatch.from_arrays([*keys, b.column(0).take(row), b.column(1).take(row), pa.array(start, pa.int32())], names=["k1", "k2", "doc_id", "th", "s"])

    return texts.mapInArrow(lean(run), "k1 long, k2 long, doc_id long, th long, s int")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """Removes the windows that start in the spans `gone` and at the positions `single`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            out = []
            for doc, th, text, gone, single in zip(*(c.to_pylist() for c in (b.column(0), b.column(1), b.column(2).cast(pa.large_binary()), b.column(3), b.column(4))), strict=True):
                words = text.split() if text else []
                step = np.zeros(len(words) + 1, np.int64)
                for x in gone or ():
                    step[x["s1"]] += 1
                    step[x["s2"] + window] -= 1
                for s in single or ():
                    step[s] += 1
                    step[s + window] -= 1
                keep = np.cumsum(step[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(keep)]
                out.append((doc, th, len(words) - len(kept), b" ".join(kept)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string())], names=["doc_id", "th", "n_removed", "kept"])

    return texts.mapInArrow(lean(run), "doc_id long, th long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept string or null, whole binary) for every row.

    kept is the text that stays, words joined by one space; null where nothing was removed, so that untouched texts
    are never moved. whole is the SHA-256 of all words joined by one space. Words are runs of anything but ASCII white
    space, unchanged. A null text has no words. Rows without doc_id take no part and lose nothing. Repeated rows have
    no smaller document among themselves, and rows that share an id are cut each by its own text. Other columns are
    ignored; an empty table gives an empty result. Texts shorter than the window lose nothing.
    """
    if window < 4:
        raise ValueError("window must be at least 4")
    short, half = lengths(window)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("text"))
    first = materialize(_anchor_rows(src, window), "sub-anchors")
    rows = first.select("doc_id", "th", F.explode("anchors").alias("x")).select("doc_id", "th", "x.*")
    level1 = materialize(rows.join(_repeated(rows, "h1"), "h1", "left_semi"), "sub-short")
    # level 2: a long window at offset o of its anchor holds the right half if o <= window - half, the left one if o >= half - short
    right = _repeated(level1, "hr").select(F.col("hr").alias("hr_"), F.lit(True).alias("r"))
    left = _repeated(level1, "hl").select(F.col("hl").alias("hl_"), F.lit(True).alias("l"))
    near, far = F.col("a") - F.col("s2"), F.col("a") - F.col("s1")
    r, l = F.coalesce("r", F.lit(False)), F.coalesce("l", F.lit(False))
    level2 = materialize(
        level1.join(right, F.col("hr") == F.col("hr_"), "left").join(left, F.col("hl") == F.col("hl_"), "left")
        .where((r & l) | (r & (near < half - short)) | (l & (far > window - half))).select("doc_id", "th", "s1", "s2", "h1", "x1", "x2"),
        "sub-half",
    )
    runs = materialize(level2.groupBy("x1", "x2").agg(F.min("doc_id").alias("m"), F.min("h1").alias("h")), "sub-runs")
    several = materialize(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("h_"), F.lit(True).alias("several")), "sub-several")
    known = materialize(runs.join(several, F.col("h") == F.col("h_"), "left").select("x1", "x2", "m", "several"), "sub-known")
    judged = level2.join(known, ["x1", "x2"]).select(
        "doc_id", "th", F.struct("s1", "s2").alias("span"), (F.col("doc_id") > F.col("m")).alias("gone"), "several"
    ).where("gone or several")
    per_doc = judged.groupBy("doc_id", "th").agg(
        F.collect_list(F.when(F.col("gone"), F.col("span"))).alias("gone"), F.collect_list(F.when(~F.col("gone"), F.col("span"))).alias("open")
    ).withColumnsRenamed({"doc_id": "doc_", "th": "th_"})
    held = materialize(src.join(per_doc, (F.col("doc_id") == F.col("doc_")) & (F.col("th") == F.col("th_"))).drop("doc_", "th_"), "sub-texts")
    opened = materialize(_window_rows(held.where("size(open) > 0").select("doc_id", "th", "text", "open"), window), "sub-windows")
    least = materialize(opened.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "sub-least")
    single = opened.join(least, ["k1", "k2"]).where("doc_id > lo").groupBy("doc_id", "th").agg(F.collect_set("s").alias("single")).withColumnsRenamed({"doc_id": "doc_", "th": "th_"})
    cut = _cut(
        held.join(single, (F.col("doc_id") == F.col("doc_")) & (F.col("th") == F.col("th_")), "left")
        .where("size(gone) > 0 or single is not null").select("doc_id", "th", "text", "gone", "single"),
        window,
    ).dropDuplicates(["doc_id", "th"]).withColumnsRenamed({"doc_id": "doc_", "th": "th_"})
    return first.select("doc_id", "th", "n_words", "whole").join(cut, (F.col("doc_id") == F.col("doc_")) & (F.col("th") == F.col("th_")), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "kept", "whole"
    )


def op4_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring_dedup(docs)
    kept = F.when(F.col("kept").isNull(), F.lower(F.hex("whole"))).otherwise(F.sha2("kept", 256))
    return out.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))

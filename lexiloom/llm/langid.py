"""Language identification by multilingual mixture inference.

A document's byte trigrams are draws from a mixture of the languages' trigram distributions. Expectation-maximisation
finds the proportions that make the document likeliest; the set of languages is that of the largest likelihood less a
charge for each language beyond the first. The mixture of all languages is at least as likely as that of any subset,
so a document whose gain over its best single language is below one charge is settled without trying subsets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import lean, mix64, slices

BUCKETS = 1 << 16
UNKNOWN = "und"
#: Charge for a language beyond the first: CHARGE x log(trigrams + 1) + CHARGE_SHARE x trigrams.
CHARGE, CHARGE_SHARE = 3.0, 0.02
STEPS = 12
_LETTER = re.compile(r"[A-Za-z]")


def _fold() -> np.ndarray:
    """Bytes as they count: ASCII letters lower-cased, bytes of other alphabets as they are, everything else a space."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(65, 91):
        out[c] = out[c + 32] = c + 32
    return out


_FOLD = _fold()


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of each row's distinct trigrams; spaces run together, and each text stands between spaces."""
    raw = pc.fill_null(text, "").cast(pa.large_binary()).to_pylist()
    size = np.fromiter(map(len, raw), np.int64, len(raw)) + 2
    data = _FOLD[np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8)] if raw else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(raw)), size)
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    data, row = data[keep].astype(np.uint64), row[keep]
    if len(data) < 3:
        return (np.zeros(0, np.int64),) * 3
    gram = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]
    inside = row[:-2] == row[2:]
    key = mix64(gram + np.uint64(1)) & np.uint64(BUCKETS - 1)
    both = np.sort(row[:-2][inside].astype(np.int64) * BUCKETS + key[inside].astype(np.int64))
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    return both[first] // BUCKETS, both[first] % BUCKETS, np.diff(np.r_[first, len(both)])


def train(docs: DataFrame, languages: list[str], smooth: float = 0.5) -> np.ndarray:
    """Log probabilities, languages x BUCKETS, from all rows of docs (lang, text)."""
    code = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in slices(batches, 1):
            own = np.array([code[x] for x in b.column(0).to_pylist()], np.int64)
            row, bucket, n = trigrams(b.column(1))
            total += np.bincount(own[row] * BUCKETS + bucket, n, total.size).astype(np.int64).reshape(total.shape)
        at = np.nonzero(total)
        if len(at[0]):
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

    counts = docs.mapInArrow(lean(run), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    out = np.full((len(languages), BUCKETS), smooth)
    got = counts.toPandas()  # at most languages x BUCKETS rows
    out[got["lang"], got["bucket"]] += got["n"]
    return np.log(out / out.sum(axis=1, keepdims=True))


def _mixture(row: np.ndarray, n: np.ndarray, p: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM over rows sorted ascending: shares (rows x languages), and log likelihood of each row but for what does not depend on the shares."""
    rows = len(share)
    total = np.maximum(np.bincount(row, n, rows), 1e-300)
    for _ in range(steps):
        joint = share[row] * p
        joint *= (n / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = np.stack([np.bincount(row, joint[:, k], rows) for k in range(p.shape[1])], axis=1) / total[:, None]
    joint = np.maximum((share[row] * p).sum(axis=1), 1e-300)
    return share, np.bincount(row, n * np.log(joint), rows)


def infer(text: pa.Array, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (rows x languages) of the chosen languages, zero elsewhere; and whether the row has a letter."""
    rows, languages = len(text), log_p.shape[0]
    letters = np.array([bool(t) and (bool(_LETTER.search(t)) or any(map(str.isalpha, t))) for t in text.to_pylist()], bool)
    row, bucket, n = trigrams(text)
    own = log_p[:, bucket].T
    p = np.exp(own - own.max(axis=1, keepdims=True)) if len(row) else np.zeros((0, languages))
    total = np.bincount(row, n, rows)
    alone = np.stack([np.bincount(row, n * np.log(np.maximum(p[:, k], 1e-300)), rows) for k in range(languages)], axis=1)
    best = alone.argmax(axis=1)
    share, full = _mixture(row, n, p, np.full((rows, languages), 1 / languages), STEPS)
    charge = CHARGE * np.log(total + 1) + CHARGE_SHARE * total
    out = np.zeros((rows, languages))
    out[np.arange(rows), best] = 1
    open_ = np.flatnonzero(full - alone[np.arange(rows), best] > charge)
    if len(open_) and languages > 1:
        order = np.argsort(-share[open_], axis=1, kind="stable")
        new = np.full(rows, -1)
        new[open_] = np.arange(len(open_))
        mine = new[row] >= 0
        r, w, q = new[row[mine]], n[mine], p[mine]
        value, chosen = alone[open_, best[open_]], out[open_]
        for k in range(2, languages + 1):
            # the full mixture bounds all sets; one charge of slack, since its steps are few
            if not (full[open_] - (k - 2) * charge[open_] > value).any():
                break
            allowed = np.zeros((len(open_), languages))
            np.put_along_axis(allowed, order[:, :k], 1, axis=1)
            start = np.maximum(share[open_], 1e-6) * allowed
            got, ll = _mixture(r, w, q, start / start.sum(axis=1, keepdims=True), STEPS)
            ll = ll - (k - 1) * charge[open_]
            better = ll > value
            value[better], chosen[better] = ll[better], got[better]
        out[open_] = chosen
    return out, letters


def predict(docs: DataFrame, languages: list[str], log_p: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, languages array<string>, shares array<double>) for every row of docs (doc_id, text).

    lang_pred is the language of the largest share, score that share, languages the chosen set by falling share. Texts
    that are null or hold no letter, and all texts if no language was learned, are `und` with score 0. Equal shares go
    to the language that comes first by name. Repeated rows are answered as often as they come.
    """
    given = docs.sparkSession.sparkContext.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2 << 20):
            if not languages:
                share, letters = np.zeros((b.num_rows, 1)), np.zeros(b.num_rows, bool)
            else:
                share, letters = infer(b.column(1), given.value)
            best = share.argmax(axis=1)
            name, score, sets, shares = [], [], [], []
            for k in range(b.num_rows):
                if not letters[k]:
                    name.append(UNKNOWN), score.append(0.0), sets.append([]), shares.append([])
                    continue
                own = [i for i in np.argsort(-share[k], kind="stable").tolist() if share[k, i] > 0]
                name.append(languages[best[k]]), score.append(min(1.0, float(share[k, best[k]]))), sets.append([languages[i] for i in own]), shares.append(share[k, own].tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    kinds = "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), kinds)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log probabilities, from all rows of docs (lang, text) with a language and a text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
    languages = sorted(x["lang"] for x in rows.select("lang").distinct().collect())  # one row for each language
    return languages, train(rows, languages) if languages else np.zeros((1, BUCKETS))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    languages, log_p = learn(docs.where(~held_out()))
    return predict(docs, languages, log_p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")

"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured on the text alone and binned. Boosting goes round the features in turn, each step fitting a tree
of four leaves at most to the gradient of the log loss over the bins of one feature, so that what is learned for a
feature is a lookup table. Then the pairs of features whose joint bins explain most of what is left get tables of
their own, by trees of four quadrants. Scoring adds table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import lean, mix64, slices, word_codes

#: At most about as many labelled rows, chosen by hash of doc_id, are used to fit.
MOST_ROWS = 30_000
FEATURES = (
    "bytes", "words", "word_length", "letters", "digits", "upper", "stops", "symbols", "lines", "line_length", "distinct_words",
    "top_word", "same_as_next", "short_words", "bare_words", "distinct_triples", "distinct_lines", "wide",
)
_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _WIDE = (1 << i for i in range(6))


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(256):
        x = chr(c)
        if c >= 128:
            out[c] = _WIDE | _LETTER
        elif x.isalpha():
            out[c] = _LETTER | (_UPPER if x.isupper() else 0)
        elif x.isdigit():
            out[c] = _DIGIT
        elif x in ".,;:?'\"()-":
            out[c] = _STOP
        elif not x.isspace() and c > 32:
            out[c] = _SYMBOL
    return out


_CLASS = _classes()


def _per_row(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given sizes."""
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    ends = np.cumsum(size)
    return total[ends] - total[ends - size]


def _distinct(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and how often its most frequent one comes."""
    if not len(row):
        return np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    both = mix64(key.astype(np.uint64) + mix64(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    both, r = both[order], row[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    n = np.diff(np.r_[first, len(both)])
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, r[first], n)
    return np.bincount(r[first], minlength=rows), top


def features(text: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; a null text is an empty one."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    rows = len(text)
    raw = text.cast(pa.large_binary())
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    kind = _CLASS[data]
    count = {k: _per_row((kind & k) != 0, size) for k in (_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _WIDE)}
    codes, per_row, names = word_codes(text)
    row = np.repeat(np.arange(rows), per_row)
    length = pc.binary_length(names.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.array(pc.match_substring_regex(names, r"[A-Za-z\x{80}-\x{10FFFF}]")) if len(names) else np.zeros(0, bool)
    size_w = length[codes] if len(codes) else np.zeros(0, np.int64)
    words, top = _distinct(row, codes, rows)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    triple = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(codes) > 2:
        x = codes.astype(np.uint64)
        triple = mix64(mix64(x[:-2] + np.uint64(7)) * np.uint64(31) + mix64(x[1:-1] + np.uint64(11)) * np.uint64(17) + x[2:])
        inside = row[:-2] == row[2:]
        triple, at = triple[inside], row[:-2][inside]
    triples, _ = _distinct(at, triple, rows)
    n_triples = np.bincount(at, minlength=rows)
    lines = pc.split_pattern(text, "\n")
    n_lines = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own_lines, _ = _distinct(np.repeat(np.arange(rows), n_lines), coded, rows)
    b, w = np.maximum(size, 1), np.maximum(per_row, 1)
    out = [
        np.log1p(size), np.log1p(per_row), _per_row(size_w, per_row) / w, count[_LETTER] / b, count[_DIGIT] / b, count[_UPPER] / np.maximum(count[_LETTER], 1),
        count[_STOP] / w, count[_SYMBOL] / w, n_lines / w, np.log1p(size / n_lines), words / w, top / w, _per_row(same, per_row) / w,
        _per_row(size_w <= 3, per_row) / w, _per_row(~letters[codes] if len(codes) else np.zeros(0, bool), per_row) / w,
        triples / np.maximum(n_triples, 1), own_lines / n_lines, count[_WIDE] / b,
    ]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Model:
    """Score = logistic(base + sum of main tables + sum of pair tables)."""

    base: float
    edges: list[np.ndarray]
    mains: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.mains):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for i, j, table in self.pairs:
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="inverted_cdf"))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int) -> np.ndarray:
    """Values for the bins by the greedy tree over their order."""
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (a, b), int(c[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes, as gain and table."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros(g.shape)
    a, b = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    box = lambda s, i0, i1, j0, j1: s[i1, j1] - s[i0, j1] - s[i1, j0] + s[i0, j0]
    areas = [(0, a, 0, b), (a, n, 0, b), (0, a, b, m), (a, n, b, m)]
    gain = sum(box(gs, *q) ** 2 / (box(hs, *q) + ridge) for q in areas) - gs[n, m] ** 2 / (hs[n, m] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    i, j = int(i) + 1, int(j) + 1
    out = np.zeros(g.shape)
    for i0, i1, j0, j1 in ((0, i, 0, j), (i, n, 0, j), (0, i, j, m), (i, n, j, m)):
        out[i0:i1, j0:j1] = box(gs, i0, i1, j0, j1) / (box(hs, i0, i1, j0, j1) + ridge)
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.08, bins: int = 64, n_pairs: int = 8, pair_rounds: int = 60, ridge: float = 2.0) -> Model:
    """Without rows, or with one class alone, the score is that class's smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    width = x.shape[1]
    edges = [_cuts(x[:, j], bins) if len(x) else np.zeros(0) for j in range(width)]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges])
    if len(y) < 10 or y.min() == y.max():
        return model
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(width)]
    logit = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-logit))
            n = len(edges[j]) + 1
            step = rate * _tree(np.bincount(at[j], y - p, n), np.bincount(at[j], p * (1 - p), n), ridge, 4)
            model.mains[j] += step
            logit += step[at[j]]
    model.coarse = [_cuts(x[:, j], 8) for j in range(width)]
    low = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(width)]
    sums = lambda i, j, v: np.bincount(low[i] * (len(model.coarse[j]) + 1) + low[j], v, (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)).reshape(len(model.coarse[i]) + 1, -1)
    p = 1 / (1 + np.exp(-logit))
    gains = sorted(((_quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[0], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)
    tables = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for gain, i, j in gains[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), table in tables.items():
            p = 1 / (1 + np.exp(-logit))
            step = rate * _quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)), ridge)[1]
            table += step
            logit += step[low[i], low[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def in_fold(key: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Model:
    """Fits to labels outside the held-out fold; at most about most_rows of them, by hash of doc_id.

    Labels other than 0 and 1 and null ids do not count; a doc_id labelled twice has the larger label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold()).groupBy(F.col("doc_id").cast("long").alias("key_")).agg(F.max(label).cast("int").alias("y_"))
    n = known.count()
    if n > most_rows:
        known = known.where(F.pmod(F.xxhash64("key_"), F.lit(1 << 30)) < int((1 << 30) * most_rows / n))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("key_"))  # about most_rows x 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 2 << 20):
            x = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    found = own.select("doc_id", "y_", "text").mapInArrow(lean(run), "doc_id long, y int, x array<double>").toPandas()
    found = found.sort_values("doc_id", kind="stable")
    x = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit(x, found["y"].to_numpy(np.float64))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs; a null text is scored as an empty one."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(given.value.score(features(b.column(1))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs that score `least` or more; columns as they are, and no shuffle.

    A null text is scored as an empty one; repeated rows and rows without doc_id are judged one by one; a text of any
    length is read whole. An empty table stays empty.
    """
    at = docs.columns.index("text")
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 2 << 20):
            yield b.filter(pa.array(given.value.score(features(b.column(at))) >= least))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model).select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

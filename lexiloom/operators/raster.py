"""Small rasters as rows: measures of ink and pigment, grids, projections, components, patch descriptors.

A raster is a row with its width and three arrays of the red, green and blue of its pixels, line by line. Decoding files
is left to the reader of the files. Measures that are sums of pixels are array expressions; components need a kernel,
which sees one raster at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed thresholds of ink and pigments.
DARKER, GREEN, RED, BLUE = 35, (12, 4, 5), (18, 18), (12, 6)
DESCRIPTORS = (
    "red", "green", "blue", "red_sd", "green_sd", "blue_sd", "ink", "edges", "entropy", "mirror_x", "mirror_y", "centre_x", "centre_y", "spread_x", "spread_y", "width", "height", "components", "largest",
)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda acc, v: acc + v)


def median(values: Column) -> Column:
    """Median of an array of numbers: the mean of the two in the middle."""
    v, n = F.array_sort(values), F.size(values)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2


def ink_mask(pixels: DataFrame) -> DataFrame:
    """pixels with columns bright (mean of the colours) and ink (1 where a pixel is darker than the ground by DARKER)."""
    bright = F.transform(F.arrays_zip("r", "g", "b"), lambda p: (p["r"] + p["g"] + p["b"]) / 3)
    out = pixels.withColumn("bright", bright).withColumn("ground", median(F.col("bright")))
    return out.withColumn("ink", F.transform("bright", lambda x: (x < F.col("ground") - DARKER).cast("int")))


def page_shares(masked: DataFrame) -> DataFrame:
    """Columns ink_share, green_share, red_share, blue_share, edge_per_ink, of rows of `ink_mask`."""
    n = F.size("ink").cast("double")
    zipped = F.arrays_zip("r", "g", "b", "bright")
    share = lambda f: _sum(F.transform(zipped, lambda p: f(p).cast("int"))) / n
    green = share(lambda p: (p["g"] > p["r"] + GREEN[0]) & (p["g"] > p["b"] + GREEN[1]) & (p["bright"] < F.col("ground") - GREEN[2]))
    red = share(lambda p: (p["r"] > p["g"] + RED[0]) & (p["r"] > p["b"] + RED[1]))
    blue = share(lambda p: (p["b"] > p["r"] + BLUE[0]) & (p["b"] > p["g"] + BLUE[1]))
    total, w = _sum(F.col("ink")), F.col("width")
    across = F.transform("ink", lambda x, i: F.when((i + 1) % w == 0, 0).otherwise(F.abs(F.coalesce(F.get("ink", i + 1), x) - x)))
    down = F.transform("ink", lambda x, i: F.abs(F.coalesce(F.get("ink", i + w), x) - x))
    return masked.withColumns({"ink_share": total / n, "green_share": green, "red_share": red, "blue_share": blue, "edge_per_ink": (_sum(across) + _sum(down)) / F.greatest(F.lit(1), total)})


def grid_density(masked: DataFrame, cells: int) -> DataFrame:
    """Column grid: the share of ink in each of cells x cells parts, line by line; the raster's sides are multiples of `cells`."""
    w = F.col("width")
    h = F.floor(F.size("ink") / w)
    place = lambda i: F.floor(F.floor(i / w) * cells / h) * cells + F.floor((i % w) * cells / w)
    marked = F.transform("ink", lambda x, i: F.struct(place(i).alias("p"), x.alias("x")))
    part = F.size("ink") / F.lit(float(cells * cells))
    return masked.withColumn("grid", F.transform(F.sequence(F.lit(0), F.lit(cells * cells - 1)), lambda c: _sum(F.transform(F.filter(marked, lambda m: m["p"] == c), lambda m: m["x"])) / part))


def projections(masked: DataFrame) -> DataFrame:
    """Columns row_share and column_share: the share of ink in each line and each column of pixels."""
    w = F.col("width")
    h = F.floor(F.size("ink") / w).cast("int")
    rows = F.transform(F.sequence(F.lit(0), h - 1), lambda y: _sum(F.slice("ink", (y * w + 1).cast("int"), w)) / w)
    columns = F.transform(F.sequence(F.lit(0), w - 1), lambda x: _sum(F.filter("ink", lambda v, i: i % w == x)) / h)
    return masked.withColumns({"row_share": rows, "column_share": columns})


def label_components(mask: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected parts of a mask, 0 where it is not set; a part's label is the least number of its pixels plus one."""
    at = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(np.where(at > 0, at, mask.size + 1), 1, constant_values=mask.size + 1)
        low = np.min([padded[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        low = np.where(at > 0, low, 0)
        if (low == at).all():
            return at
        at = low


def components(masked: DataFrame, key: str, least_area: int = 1, tallest: int | None = None) -> DataFrame:
    """(key, component, area, x0, y0, x1, y1) of the ink's parts of least_area pixels or more and at most `tallest` pixels high."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, width, ink in zip(b[key], b["width"], b["ink"], strict=True):
                at = label_components(np.asarray(ink, bool).reshape(-1, width))
                for label in np.unique(at[at > 0]).tolist():
                    y, x = np.nonzero(at == label)
                    if len(x) >= least_area and (tallest is None or y.max() - y.min() < tallest):
                        out.append((name, label, len(x), x.min(), y.min(), x.max() + 1, y.max() + 1))
            yield pd.DataFrame(out, columns=[key, "component", "area", "x0", "y0", "x1", "y1"])

    kind = dict(masked.dtypes)[key]
    return masked.select(key, "width", "ink").mapInPandas(run, f"`{key}` {kind}, component long, area long, x0 int, y0 int, x1 int, y1 int")


def patch_descriptors(masked: DataFrame, key: str) -> DataFrame:
    """(key, and the nineteen DESCRIPTORS as an array of doubles): colours, ink, edges, entropy of brightness, symmetry, centre, spread, box, parts."""

    def one(width: int, r, g, b, ink) -> list[float]:
        colours = [np.asarray(c, float) for c in (r, g, b)]
        mask = np.asarray(ink, float).reshape(-1, width)
        h, w = mask.shape
        counts = np.bincount(np.clip(sum(colours) / 48, 0, 15).astype(int), minlength=16) / (h * w)
        edges = np.abs(np.diff(mask, axis=0)).sum() + np.abs(np.diff(mask, axis=1)).sum()
        y, x = np.nonzero(mask)
        at = label_components(mask > 0)
        sizes = np.bincount(at[at > 0]) if len(x) else np.zeros(1)
        place = [x.mean() / w, y.mean() / h, x.std() / w, y.std() / h, (np.ptp(x) + 1) / w, (np.ptp(y) + 1) / h] if len(x) else [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]
        entropy = float(-(counts[counts > 0] * np.log2(counts[counts > 0])).sum())
        mirrors = [1 - np.abs(mask - mask[:, ::-1]).mean(), 1 - np.abs(mask - mask[::-1]).mean()]
        return [*[c.mean() for c in colours], *[c.std() for c in colours], mask.mean(), edges / (h * w), entropy, *mirrors, *place, float((sizes > 0).sum()), sizes.max() / (h * w)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({key: p[key], "descriptors": [one(*x) for x in zip(*(p[c] for c in ("width", "r", "g", "b", "ink")), strict=True)]})

    return masked.select(key, "width", "r", "g", "b", "ink").mapInPandas(run, f"`{key}` {dict(masked.dtypes)[key]}, descriptors array<double>")

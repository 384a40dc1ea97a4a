"""Sharpness, brightness and perceptual hash of grey pixels, all from one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def laplacian_variance(grey: np.ndarray) -> float:
    """The variance of the second differences of the inner pixels; 0 for images under three pixels a side."""
    if min(grey.shape) < 3:
        return 0.0
    g = grey.astype(np.float64)
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var())


def _shrunk(grey: np.ndarray, side: int) -> np.ndarray:
    """Means over side x side even parts; small images are repeated first."""
    g = grey.astype(np.float64)
    up = [max(1, -(-side // n)) for n in g.shape]
    g = np.repeat(np.repeat(g, up[0], 0), up[1], 1)
    rows, cols = (np.linspace(0, n, side + 1).astype(int)[:-1] for n in g.shape)
    sums = np.add.reduceat(np.add.reduceat(g, rows, 0), cols, 1)
    sizes = np.outer(np.diff([*rows, g.shape[0]]), np.diff([*cols, g.shape[1]]))
    return sums / sizes


def perceptual_hash(grey: np.ndarray, side: int = 8, factor: int = 4) -> int:
    """64 bits: which of the lowest frequencies of the shrunk image lie above their median."""
    n = side * factor
    k = np.arange(n)
    basis = np.cos(np.pi / n * np.outer(np.arange(side), k + 0.5))
    low = basis @ _shrunk(grey, n) @ basis.T
    bits = (low > np.median(low)).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def pixel_metrics(df: DataFrame, key: str, pixels: str = "pixels", width: str = "width", height: str = "height") -> DataFrame:
    """key, blur_score, brightness and phash of grey images (one byte a pixel, row by row).

    Null pixels and those that don't fill width x height have null metrics.
    """
    schema = T.StructType([df.schema[key], T.StructField("blur_score", T.DoubleType()), T.StructField("brightness", T.DoubleType()), T.StructField("phash", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, w, h in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if not data or not w or not h or len(data) != w * h:
                    out.append((None, None, None))
                    continue
                grey = np.frombuffer(data, dtype=np.uint8).reshape(h, w)
                out.append((laplacian_variance(grey), float(grey.mean()), perceptual_hash(grey)))
            cols = [pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[f.name for f in schema.fields])

    return df.select(key, F.col(pixels).cast("binary"), F.col(width).cast("int"), F.col(height).cast("int")).mapInArrow(run, schema)

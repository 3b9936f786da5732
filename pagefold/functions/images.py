"""Image samples: bit depths and palettes, with numpy inside Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack_samples(data: bytes, width: int, height: int, bits: int) -> bytes | None:
    """Samples of 1, 2 or 4 bits as bytes from 0 to 255; null if rows are missing. Rows begin at bytes."""
    row = (width * bits + 7) // 8
    if bits not in (1, 2, 4) or len(data) < row * height:
        return None
    lines = np.unpackbits(np.frombuffer(data[: row * height], dtype=np.uint8).reshape(height, row), axis=1)[:, : width * bits]
    values = lines.reshape(height, width, bits) @ (1 << np.arange(bits - 1, -1, -1))
    return (values * (255 // ((1 << bits) - 1))).astype(np.uint8).tobytes()


def apply_palette(samples: bytes, palette: bytes, components: int) -> bytes:
    """Colours of palette samples; a sample beyond the palette takes its last colour."""
    table = np.frombuffer(palette[: len(palette) // components * components], dtype=np.uint8).reshape(-1, components)
    return table[np.minimum(np.frombuffer(samples, dtype=np.uint8), len(table) - 1)].tobytes() if len(table) else b""


def unpacked(data: Column, width: Column, height: Column, bits: Column) -> Column:
    @F.pandas_udf("binary")
    def f(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unpack_samples(bytes(x), int(i), int(j), int(k)) for x, i, j, k in zip(d, w, h, b, strict=True)], dtype=object)

    return f(data, width, height, bits)


def coloured(samples: Column, palette: Column, components: int) -> Column:
    @F.pandas_udf("binary")
    def f(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else apply_palette(bytes(x), bytes(y), components) for x, y in zip(s, p, strict=True)], dtype=object)

    return f(samples, palette)


def mean_luminance(rgb: bytes, width: int, height: int) -> list[float]:
    """Mean luminance of the four quadrants of an RGB image: top left, top right, bottom left, bottom right."""
    grey = np.frombuffer(rgb, dtype=np.uint8).reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])
    h, w = height // 2, width // 2
    return [float(q.mean()) if q.size else 0.0 for q in (grey[:h, :w], grey[:h, w:], grey[h:, :w], grey[h:, w:])]

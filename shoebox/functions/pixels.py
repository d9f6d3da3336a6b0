"""Perceptual hash of gray pictures.

The numpy helpers below work on one Arrow batch inside a task; Spark decides which rows a task
sees. Bits are ordered row by row from the lowest frequency.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 32  # the picture is shrunk to SIDE x SIDE before the transform
LOW = 8  # LOW x LOW lowest frequencies make the 64 bits
DECIMALS = 3  # removes float noise, so equal pictures give equal bits on any machine


def _cosines() -> np.ndarray:
    frequency = np.arange(LOW)[:, None]
    position = np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * position + 1) * frequency / (2 * SIDE))


def shrink(gray: np.ndarray) -> np.ndarray:
    """Area-average a (height, width) picture to SIDE x SIDE; small sides repeat pixels."""
    out = gray.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        cuts = np.arange(SIDE + 1) * n // SIDE
        first, last = cuts[:-1], np.maximum(cuts[1:], cuts[:-1] + 1)
        sums = np.concatenate(
            [np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)], axis=axis
        )
        widths = (last - first).reshape((-1, 1) if axis == 0 else (1, -1))
        out = (sums.take(last, axis) - sums.take(first, axis)) / widths
    return out


def hash_small(pictures: np.ndarray) -> list[str]:
    """Hex hashes of a (n, SIDE, SIDE) stack: low DCT coefficients above their median."""
    if len(pictures) == 0:
        return []
    basis = _cosines()
    low = np.round(basis @ pictures.astype(np.float64) @ basis.T, DECIMALS)
    flat = low.reshape(len(pictures), LOW * LOW)
    bits = flat > np.median(flat, axis=1, keepdims=True)
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def hash_picture(gray: np.ndarray) -> str:
    return hash_small(shrink(gray)[None])[0]


def luma(pixels: np.ndarray) -> np.ndarray:
    """Gray level of a (height, width, channels) picture in blue, green, red(, alpha) order."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    blue, green, red = (pixels[:, :, i].astype(np.float64) for i in range(3))
    return red * 0.299 + green * 0.587 + blue * 0.114


@F.pandas_udf(T.StringType())
def phash_of_image(image: pd.DataFrame) -> pd.Series:
    """Hash of the ``image`` struct that Spark's image source produces; NULL when undecodable."""

    def one(height, width, channels, data):
        if data is None or height <= 0 or width <= 0:
            return None
        pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
        return hash_picture(luma(pixels))

    return pd.Series(
        [
            one(*row)
            for row in zip(image["height"], image["width"], image["nChannels"], image["data"])
        ],
        dtype=object,
    )


@F.pandas_udf(T.StringType())
def phash_of_gray(levels: pd.Series) -> pd.Series:
    """Hash of a ready SIDE x SIDE gray picture given as an array of its levels, row by row."""
    if levels.empty:
        return pd.Series([], dtype=object)
    stack = np.stack([np.asarray(v, dtype=np.float64) for v in levels])
    return pd.Series(hash_small(stack.reshape(len(stack), SIDE, SIDE)))

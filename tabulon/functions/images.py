"""Image conditions: grey, mask, noise, mirror; seeds come with the rows. On arrays of pixel values as expressions of the engine, on raw RGB bytes as an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Added to a row's seed for noise, so that mask and noise draw apart (a fixed value).
NOISE_SEED = 1_000_000


def construct(pixels: np.ndarray, condition: str, seed: int) -> np.ndarray:
    """pixels: height x width x 3, uint8. 'source' is the image itself."""
    if condition == "grey":
        return np.full_like(pixels, 128)
    if condition == "mirror":
        return pixels[:, ::-1]
    if condition == "mask":
        keep = np.random.default_rng(seed).random(pixels.shape[:2]) >= 0.5
        return np.where(keep[..., None], pixels, np.uint8(0))
    if condition == "noise":
        noise = np.random.default_rng(NOISE_SEED + seed).integers(-64, 65, pixels.shape, dtype=np.int16)
        return np.clip(pixels.astype(np.int16) + noise, 0, 255).astype(np.uint8)
    return pixels


@F.pandas_udf(BinaryType())
def image_under(content: pd.Series, width: pd.Series, condition: pd.Series, seed: pd.Series) -> pd.Series:
    """Bytes of each image under its condition; null where the bytes are no rows of that width."""

    def one(b, w, c, s):
        if b is None or not w or len(b) % (3 * int(w)):
            return None
        return construct(np.frombuffer(b, np.uint8).reshape(-1, int(w), 3), c, int(s)).tobytes()

    return pd.Series([one(*x) for x in zip(content, width, condition, seed, strict=True)], dtype=object)


def uniform(seed: Column, counter: Column, part: int) -> Column:
    """Above 0, at most 1: 32 bits (the part-th of four) of the MD5 of seed and counter. Any pixel's draw is made by itself, in any order."""
    digest = F.md5(F.concat_ws("|", seed.cast("string"), counter.cast("string")))
    return (F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") + 1) / F.lit(float(1 << 32))


def pixels_under(pixels: Column, width: Column, condition: str, seed: Column, channels: int = 3) -> Column:
    """An image's values (array of int, row by row, channels of a pixel together) under a condition; null where they are no rows of that width.

    source is the image; grey is 128 everywhere; mirror turns rows round; mask
    blackens half of the pixels, all channels of one alike; noise adds a normal
    draw of deviation 80, cut to whole numbers, to each value, within 0 and 255."""
    wide = width * channels
    if condition == "grey":
        out = F.transform(pixels, lambda v: F.lit(128))
    elif condition == "mirror":
        out = F.transform(pixels, lambda v, i: F.get(pixels, (i - i % wide + (width - 1 - F.floor(i % wide / channels)) * channels + i % channels).cast("int")))
    elif condition == "mask":
        out = F.transform(pixels, lambda v, i: F.when(uniform(seed, F.floor(i / channels), 0) > 0.5, v).otherwise(0))
    elif condition == "noise":
        # two uniforms of one digest make a normal draw
        drawn = lambda i: F.sqrt(-2 * F.log(uniform(seed + NOISE_SEED, i, 0))) * F.cos(2 * F.pi() * uniform(seed + NOISE_SEED, i, 1))
        out = F.transform(pixels, lambda v, i: F.greatest(F.lit(0), F.least(F.lit(255), v + (80 * drawn(i)).cast("int"))))
    elif condition == "source":
        out = pixels
    else:
        raise ValueError(f"no condition {condition!r}")
    return F.when((width > 0) & (F.size(pixels) % wide == 0), out)

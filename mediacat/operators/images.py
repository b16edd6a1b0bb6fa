"""Image statistics over arrays of luminance or pixels; no codecs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SHARP_VARIANCE, BLUR_BELOW, SHARP_ENERGY = 500.0, 100.0, 0.02
RATIOS = (4 / 3, 3 / 2, 16 / 9, 1.0)
KMEANS_ROUNDS = 10


def laplacian(img: np.ndarray, border: str) -> np.ndarray:
    """3x3 kernel with centre -4; border: mirror (without the edge itself) or zero."""
    p = np.pad(img.astype(float), 1, mode="reflect") if border == "mirror" and min(img.shape) > 1 else np.pad(img.astype(float), 1, mode="edge" if border == "mirror" else "constant")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def _with(df: DataFrame, columns: list[str], values, fields: list[str]) -> DataFrame:
    """df with double columns that values(row of columns) gives, in Arrow batches; null where a column is null or odd."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in zip(*(b[c] for c in columns), strict=True):
                try:
                    out.append(values(*row))
                except (TypeError, ValueError):
                    out.append((None,) * len(fields))
            yield pd.concat([b, pd.DataFrame(out, columns=fields, index=b.index, dtype="float64")], axis=1)

    return df.mapInPandas(run, StructType([*df.schema.fields, *(StructField(f, DoubleType()) for f in fields)]))


def luma_stats(df: DataFrame, luma: str = "luma") -> DataFrame:
    """df with brightness (mean / 255) and contrast (population deviation / 255)."""
    x = F.transform(luma, lambda v: v.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / F.size(luma)
    rows = df.withColumn("__m", mean)
    dev = F.sqrt(total(F.transform(luma, lambda v: (v - F.col("__m")) * (v - F.col("__m")))) / F.size(luma))
    return rows.withColumn("brightness", F.col("__m") / 255).withColumn("contrast", dev / 255).drop("__m")


def sharpness(df: DataFrame, luma: str = "luma", width: str = "width", height: str = "height", form: str = "variance") -> DataFrame:
    """df with sharpness and blur (1.0 or 0.0): variance of the Laplacian / 500, or its mean square on [0, 1] luminance / 0.02; at most 1."""

    def values(x, w, h) -> tuple[float, float]:
        img = np.asarray(x, float).reshape(int(h), int(w))
        v = laplacian(img, "mirror").var()
        energy = (laplacian(img / 255, "zero") ** 2).mean()
        return min(1.0, v / SHARP_VARIANCE) if form == "variance" else min(1.0, max(0.0, energy / SHARP_ENERGY)), float(v < BLUR_BELOW)

    return _with(df, [luma, width, height], values, ["sharpness", "blur"])


def average_hash(luma8x8: Column) -> Column:
    """16 hex digits: which of the 64 values lie over their mean."""
    total = F.aggregate(luma8x8, F.lit(0.0), lambda s, v: s + v)
    bits = F.transform(luma8x8, lambda v: F.when(v * F.size(luma8x8) > total, "1").otherwise("0"))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda i: F.lower(F.conv(F.array_join(F.slice(bits, i, 4), ""), 2, 16))), "")


def fingerprint(df: DataFrame, luma: str = "luma", size: int = 32, parts: int = 2) -> DataFrame:
    """df with perceptual_hash from size x size luminance, 16 hex digits each: a:p, as the catalog keeps them, or with 4 parts a:p:d:w.

    a: block means over their mean; p: low cosine terms over their median; d: each of 8 rows of 9 area means, which grow to
    the right; w: block means over their median (the low Haar wavelet terms, whose common part cancels).
    """
    k = np.arange(size)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / (2 * size))
    edges = np.arange(10) * size / 9
    nine = np.maximum(0, np.minimum(k[None, :] + 1, edges[1:, None]) - np.maximum(k[None, :], edges[:-1, None]))

    def digits(bits: np.ndarray) -> str:
        return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b[luma]:
                if x is None or len(x) != size * size:
                    out.append(None)
                    continue
                img = np.asarray(x, float).reshape(size, size)
                small = img.reshape(8, size // 8, 8, size // 8).mean(axis=(1, 3))
                low = np.round(basis @ img @ basis.T, 6)  # what rounding leaves of equal terms is no bit
                wide = np.round(img.reshape(8, size // 8, size).mean(axis=1) @ nine.T, 6)
                out.append(":".join(map(digits, (small > small.mean(), low > np.median(low), wide[:, 1:] > wide[:, :-1], small > np.median(small))[:parts])))
            yield b.assign(perceptual_hash=out)

    return df.mapInPandas(run, StructType([*df.schema.fields]).add("perceptual_hash", "string"))


def lab_spread(pixels: DataFrame) -> DataFrame:
    """(image_id, lab_spread): population deviations of both Lab colour axes, added, over all pixels (image_id, rgb of 0 to 255)."""
    linear = F.transform("rgb", lambda c: F.when(c / 255 <= 0.04045, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, 2.4)))
    root = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116)
    rows = pixels.select("image_id", linear.alias("l"))
    # sRGB to XYZ over the white of D65.
    matrix = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    x, y, z = (root(sum(F.get("l", F.lit(i)) * m for i, m in enumerate(row)) / white) for row, white in zip(matrix, (0.950456, 1.0, 1.088754), strict=True))
    return rows.select("image_id", (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b")).groupBy("image_id").agg((F.stddev_pop("a") + F.stddev_pop("b")).alias("lab_spread"))


def image_geometry(df: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    width, height = F.col(w), F.col(h)
    valid = (width > 0) & (height > 0)
    shape = F.when(width > height, "landscape").when(width < height, "portrait").otherwise("square")
    return df.withColumns({"valid": F.coalesce(valid, F.lit(False)), "aspect_ratio": F.when(valid, width / height), "orientation": F.when(valid, shape), "megapixels": F.when(valid, width * height / 1_000_000)})


def simple_aesthetic(aspect_ratio: Column, brightness: Column, lab_spread: Column) -> Column:
    """0.3 closeness of the aspect ratio to a usual one + 0.4 closeness of brightness to the middle + 0.3 colourfulness (spread of both Lab colour axes / 100)."""
    aspect = 1 - F.least(*(F.abs(F.log(aspect_ratio / r)) for r in RATIOS)) / 2
    return 0.3 * aspect + 0.4 * (1 - F.abs(brightness - 0.5)) + 0.3 * F.least(F.lit(1.0), lab_spread / 100)


def hue(rgb: Column) -> Column:
    """Hue in degrees of [r, g, b]; grey is 0."""
    r, g, b = (F.get(rgb, F.lit(i)).cast("double") for i in range(3))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(top == r, (g - b) / d).when(top == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.pmod(h * 60, F.lit(360.0)))


def average_hue(palette: Column) -> Column:
    return F.when(F.size(palette) > 0, F.aggregate(F.transform(palette, hue), F.lit(0.0), lambda s, x: s + x) / F.size(palette))


def eye_openness(landmarks: Column) -> Column:
    """min(1, distance of the first two landmarks / 100); 0.5 with fewer than five."""
    a, b = F.get(landmarks, F.lit(0)), F.get(landmarks, F.lit(1))
    d = F.sqrt(F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), 2) + F.pow(F.get(a, F.lit(1)) - F.get(b, F.lit(1)), 2))
    return F.when(F.coalesce(F.size(landmarks), F.lit(0)) < 5, 0.5).otherwise(F.least(F.lit(1.0), d / 100))


def palette_hex(palette: Column, n: int = 5) -> Column:
    return F.array_join(F.transform(F.slice(palette, 1, n), lambda c: F.format_string("#%02x%02x%02x", F.get(c, F.lit(0)), F.get(c, F.lit(1)), F.get(c, F.lit(2)))), ", ")


def dominant_colors(pixels: DataFrame, k: int = 5) -> DataFrame:
    """(image_id, colors array<array<int>>): centres of k-means over all pixels (image_id, rgb) of each image, most common first.

    Pixels are first added up in cells of 8 levels a channel, so an image is at most 32,768 weighted means however large it is.
    """
    channel = lambda i: F.get("rgb", F.lit(i))
    cell = F.shiftright(channel(0), 3) * 1024 + F.shiftright(channel(1), 3) * 32 + F.shiftright(channel(2), 3)
    counted = pixels.groupBy("image_id", cell.alias("cell")).agg(F.count("*").alias("n"), *(F.avg(channel(i)).alias(c) for i, c in enumerate("rgb")))

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "cell"], ascending=[False, True])
        x, n = pdf[["r", "g", "b"]].to_numpy(float), pdf["n"].to_numpy(float)
        # The first centre is the most common cell; each next one the cell that weighs most by distance to those before.
        centre, far = x[:1], ((x - x[0]) ** 2).sum(axis=1)
        while len(centre) < min(k, len(x)) and (far * n).max() > 0:
            centre = np.concatenate([centre, x[[(far * n).argmax()]]])
            far = np.minimum(far, ((x - centre[-1]) ** 2).sum(axis=1))
        for _ in range(KMEANS_ROUNDS):
            own = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for c in range(len(centre)):
                if (own == c).any():
                    centre[c] = np.average(x[own == c], axis=0, weights=n[own == c])
        size = np.bincount(own, weights=n, minlength=len(centre))
        order = np.argsort(-size, kind="stable")
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "colors": [[[int(v) for v in centre[c]] for c in order if size[c]]]})

    return counted.groupBy("image_id").applyInPandas(cluster, "image_id long, colors array<array<int>>")


def image_features(df: DataFrame, luma: str = "luma", width: str = "width", height: str = "height", palette: str = "color_palette") -> DataFrame:
    """Brightness, contrast, sharpness, geometry and average hue of each image row."""
    return image_geometry(sharpness(luma_stats(df, luma), luma, width, height), width, height).withColumn("average_hue", average_hue(F.col(palette)))


def image_rows(df: DataFrame, pixels: DataFrame, k: int = 5) -> DataFrame:
    """image_features() of df (image_id, luma, width, height), with color_palette, lab_spread and aesthetic found from all pixels (image_id, rgb)."""
    found = df.join(dominant_colors(pixels, k).withColumnRenamed("colors", "color_palette"), "image_id", "left").join(lab_spread(pixels), "image_id", "left")
    return image_features(found).withColumn("aesthetic", simple_aesthetic(F.col("aspect_ratio"), F.col("brightness"), F.coalesce("lab_spread", F.lit(0.0))))

"""Page images before recognition: Otsu's threshold in SQL, the other steps in numpy.

Histograms are rows (image, level, n), at most 256 per image, so the method is
running sums over a window per image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FALLBACK = 128


def histogram(pixels: DataFrame) -> DataFrame:
    """(image, level, n) of pixels(image, level)."""
    return pixels.groupBy("image", "level").agg(F.count("*").alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(image, threshold): the first level of maximal variance between classes.

    Levels from which no foreground is left do not count; an image without any
    other has the threshold 128.
    """
    up = W.partitionBy("image").orderBy("level").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("image")
    h = hist.select("image", "level", F.col("n").cast("double").alias("n"))
    h = h.withColumn("w_b", F.sum("n").over(up)).withColumn("s_b", F.sum(F.col("level") * F.col("n")).over(up))
    h = h.withColumn("total", F.sum("n").over(whole)).withColumn("s", F.sum(F.col("level") * F.col("n")).over(whole))
    h = h.withColumn("w_f", F.col("total") - F.col("w_b"))
    gap = F.col("s_b") / F.col("w_b") - (F.col("s") - F.col("s_b")) / F.col("w_f")
    h = h.withColumn("var", F.when((F.col("w_f") > 0) & (F.col("w_b") > 0), F.col("w_b") * F.col("w_f") * gap * gap))
    best = h.filter("var > 0").groupBy("image").agg(F.max_by("level", F.struct("var", -F.col("level"))).alias("t"))
    images = hist.select("image").distinct()
    return images.join(best, "image", "left").select("image", F.coalesce("t", F.lit(FALLBACK)).cast("int").alias("threshold"))


def binarised(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels above the image's threshold become 255, the others 0."""
    t = pixels.join(thresholds, "image")
    return t.withColumn("level", F.when(F.col("level") > F.col("threshold"), 255).otherwise(0)).drop("threshold")


# --- images as arrays, inside a worker --------------------------------------

#: Share of a page's height that holds the running head.
HEAD = 0.07
#: Share of pixels, in per cent, cut at either end of the histogram.
CUTOFF = 1


def grey(image: np.ndarray) -> np.ndarray:
    """Luma (ITU-R 601) of an image of three channels; a grey one as it is."""
    if image.ndim == 2:
        return image.astype(np.uint8)
    weights = np.array([299, 587, 114])
    return ((image[..., :3].astype(np.int64) @ weights + 500) // 1000).astype(np.uint8)


def without_head(image: np.ndarray, share: float = HEAD) -> np.ndarray:
    """The page below its running head."""
    return image[int(image.shape[0] * share) :]


def stretched(image: np.ndarray, cutoff: float = CUTOFF) -> np.ndarray:
    """Contrast stretched to 0..255 after ``cutoff`` per cent is cut at both ends."""
    hist = np.bincount(image.ravel(), minlength=256)
    cut = int(image.size * cutoff // 100)
    up, down = np.cumsum(hist), np.cumsum(hist[::-1])
    low, high = int(np.argmax(up > cut)), 255 - int(np.argmax(down > cut))
    if high <= low:
        return image
    table = np.clip((np.arange(256) - low) * (255.0 / (high - low)), 0, 255).astype(np.uint8)
    return table[image]


def _around(image: np.ndarray) -> np.ndarray:
    """The nine neighbours of every pixel; the edge repeats."""
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.stack([p[y : y + h, x : x + w] for y in range(3) for x in range(3)])


def sharpened(image: np.ndarray) -> np.ndarray:
    """A 3 by 3 sharpening kernel: 32 in the middle, -2 around, over 16."""
    n = _around(image).astype(np.int64)
    return np.clip((34 * n[4] - 2 * n.sum(axis=0)) / 16 + 0.5, 0, 255).astype(np.uint8)


def smoothed(image: np.ndarray) -> np.ndarray:
    """The median of every pixel's 3 by 3 neighbourhood."""
    return np.median(_around(image), axis=0).astype(np.uint8)


def otsu_level(image: np.ndarray) -> int:
    """The threshold of one image, as ``otsu`` finds it from rows."""
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    w_b, s_b = np.cumsum(n), np.cumsum(n * np.arange(256))
    w_f = w_b[-1] - w_b
    ok = (w_b > 0) & (w_f > 0)
    var = np.zeros(256)
    var[ok] = w_b[ok] * w_f[ok] * (s_b[ok] / w_b[ok] - (s_b[-1] - s_b[ok]) / w_f[ok]) ** 2
    return int(np.argmax(var)) if var.max() > 0 else FALLBACK


def prepared(image: np.ndarray) -> np.ndarray:
    """A page ready for recognition: grey, stretched, sharpened, black and white, smoothed."""
    g = sharpened(stretched(grey(image)))
    return smoothed(np.where(g > otsu_level(g), 255, 0).astype(np.uint8))


def recogniser(render: Callable[[bytes], list[np.ndarray]], read: Callable[[np.ndarray], str]) -> Callable[[bytes], list[str]]:
    """An ``OcrFunction`` from a renderer of pages and a reader of prepared images."""
    return lambda data: [read(prepared(without_head(page))) for page in render(data)]

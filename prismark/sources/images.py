"""Image folders: scan, decode, reject, describe.

Spark's own image source decodes JPEG, PNG and BMP. Files it cannot decode stay as rows with an error.
Descriptors that need libraries outside this environment (SIFT, ORB, a CNN) plug in as extractors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.functions import paths
from prismark.functions.hashes import perceptual_hash_values
from prismark.plans.numbering import numbered

Extractor = Callable[[np.ndarray], np.ndarray]  # uint8 height x width x 3 (BGR) -> vector
SIDE = 224


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = paths.IMAGE_EXTENSIONS) -> DataFrame:
    """Rows (index, path, category) of a folder and its subfolders, numbered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    found = files.where(paths.has_extension(F.col("path"), extensions))
    return numbered(found, ["path"]).select("index", "path", paths.category(F.col("path")).alias("category"))


def load_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = paths.IMAGE_EXTENSIONS) -> DataFrame:
    """Rows (path, height, width, channels, data, error); data holds BGR bytes row by row."""
    read = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.*")
    found = read.where(paths.has_extension(F.col("origin"), extensions))
    error = F.when(F.col("height") < 0, F.lit("not decoded"))
    return found.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data", error.alias("error"))


def decoded(images: DataFrame) -> DataFrame:
    return images.where("error IS NULL")


def load_quality(images: DataFrame) -> DataFrame:
    """One row (loaded, failed)."""
    return images.agg(F.count_if(F.col("error").isNull()).alias("loaded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else a[:, :, :3]


#: Resampling kernels: their reach, and their weight at a distance.
KERNELS: dict[str, tuple[float, Callable[[np.ndarray], np.ndarray]]] = {
    "bilinear": (1.0, lambda x: np.maximum(0, 1 - np.abs(x))),
    "bicubic": (2.0, lambda x: np.where(np.abs(x) < 1, (1.5 * np.abs(x) - 2.5) * x * x + 1, np.where(np.abs(x) < 2, ((-0.5 * np.abs(x) + 2.5) * np.abs(x) - 4) * np.abs(x) + 2, 0))),
    "lanczos": (3.0, lambda x: np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)),
}


def resampling(size: int, n: int, kernel: str, smooth: bool) -> np.ndarray:
    """n x size weights, each row of sum 1; where ``smooth``, the kernel widens as far as the image shrinks."""
    reach, weight = KERNELS[kernel]
    scale = size / n
    wide = max(scale, 1.0) if smooth else 1.0
    centre = (np.arange(n) + 0.5)[:, None] * scale
    x = np.arange(size)[None]
    within = (x >= np.floor(centre - reach * wide + 0.5)) & (x < np.floor(centre + reach * wide + 0.5))
    w = np.where(within, weight((x + 0.5 - centre) / wide), 0.0)
    return w / w.sum(1, keepdims=True)


def resized(a: np.ndarray, height: int, width: int, kernel: str = "bilinear", smooth: bool = False) -> np.ndarray:
    """Bytes, height x width (x channels). Smooth resampling goes by columns and then by rows and rounds to bytes after each, plain resampling rounds once."""
    out = a.astype(float)
    for axis, n in ((1, width), (0, height)):
        if out.shape[axis] != n:
            out = np.moveaxis(np.tensordot(resampling(out.shape[axis], n, kernel, smooth), out, (1, axis)), 0, axis)
            if smooth:
                out = np.clip(np.floor(out + 0.5), 0, 255)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def normalised(a: np.ndarray, side: int = SIDE) -> np.ndarray:
    """An image of side x side in RGB with values 0..1, by smooth bicubic resampling."""
    return resized(a[:, :, ::-1], side, side, "bicubic", True).astype(np.float32) / np.float32(255)


def grey(a: np.ndarray) -> np.ndarray:
    """Bytes of luma, with integer weights of 16 bits."""
    b, g, r = (a[:, :, k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def hashes_of(a: np.ndarray) -> tuple[str, str, str]:
    """Average, difference and perceptual hash, 16 hex digits each."""
    eight, nine, large = (resized(grey(a), *size, "lanczos", True) for size in ((8, 8), (8, 9), (32, 32)))
    pack = lambda bits: np.packbits(bits.ravel()).tobytes().hex()
    return pack(eight > eight.mean()), pack(nine[:, 1:] > nine[:, :-1]), perceptual_hash_values(large)


def hsv(a: np.ndarray) -> np.ndarray:
    """BGR bytes to hue 0..179, saturation and value 0..255."""
    b, g, r = (a[..., k].astype(float) for k in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    h = np.where(d == 0, 0, np.where(h < 0, h + 180, h))
    return np.stack([np.minimum(np.rint(h), 179), np.rint(np.where(v == 0, 0, d / np.where(v == 0, 1, v)) * 255), v], -1)


def color_histogram(a: np.ndarray) -> np.ndarray:
    """8 x 8 x 8 bins of BGR and of HSV, each of unit norm: 1024 values."""
    out = []
    for values, tops in ((a.astype(float), (256, 256, 256)), (hsv(a), (180, 256, 256))):
        cell = [np.minimum(values[..., k] * 8 // tops[k], 7).astype(int) for k in range(3)]
        h = np.bincount((cell[0] * 64 + cell[1] * 8 + cell[2]).ravel(), minlength=512).astype(float)
        out.append(h / max(np.linalg.norm(h), 1e-12))
    return np.concatenate(out)


def preprocessed(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Rows (path, pixels, error) of all images: RGB values 0..1 of side x side, row by row; null with the error where a file was not decoded."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, h, w, c, d, error in b.itertuples(index=False):  # a row at a time: one has some megabytes
                yield pd.DataFrame({"path": [path], "pixels": [None if error else normalised(pixels(h, w, c, d), side).ravel()], "error": [error]})

    return images.select("path", "height", "width", "channels", "data", "error").mapInPandas(run, "path string, pixels array<float>, error string")


def with_hashes(images: DataFrame) -> DataFrame:
    """Rows (path, ahash, dhash, phash) of decoded images."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *hashes_of(pixels(h, w, c, d))) for p, h, w, c, d in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "ahash", "dhash", "phash"])

    return decoded(images).select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, ahash string, dhash string, phash string")


def with_features(images: DataFrame, *extractors: Extractor) -> DataFrame:
    """Rows (path, features): the extractors' vectors one after another, over images brought to 224 x 224. Extractors are loaded once a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, h, w, c, d in b.itertuples(index=False):
                a = resized(pixels(h, w, c, d), SIDE, SIDE)
                rows.append((p, np.concatenate([np.asarray(e(a), np.float32) for e in extractors])))
            yield pd.DataFrame(rows, columns=["path", "features"])

    return decoded(images).select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, features array<float>")


#: Backbones by name: each makes, once a task, a function from a batch of inputs (n x 224 x 224 x 3) to vectors (n x width).
BACKBONES: dict[str, Callable[[], Callable[[np.ndarray], np.ndarray]]] = {}


def register_backbone(name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> None:
    """Makes a model available by name; ``load`` runs on the workers, so it may import what only they have."""
    BACKBONES[name] = load


def with_model(images: DataFrame, model: str | Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 32, prepare: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (path, features, model_ms): a model's vectors of decoded images, ``batch_size`` at a time.

    model is a registered name or a loader. ``prepare`` makes an input of an image of 224 x 224 (default:
    ``imagenet_input``). model_ms is the time of the image's batch divided by its size.
    """
    if isinstance(model, str):
        if model not in BACKBONES:
            raise ValueError(f"unknown backbone {model!r}; registered: {sorted(BACKBONES)}")
        model = BACKBONES[model]
    if batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    prepare = prepare or imagenet_input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = None
        for b in batches:
            for at in range(0, len(b), batch_size):
                part = b.iloc[at : at + batch_size]
                infer = infer or model()
                inputs = np.stack([prepare(resized(pixels(h, w, c, d), SIDE, SIDE)) for _, h, w, c, d in part.itertuples(index=False)])
                began = time.perf_counter()
                out = np.asarray(infer(inputs), np.float32)
                ms = (time.perf_counter() - began) * 1000 / len(part)
                if len(out) != len(part):
                    raise ValueError("the model gave another number of vectors than it got images")
                yield pd.DataFrame({"path": part["path"].to_numpy(), "features": list(out.reshape(len(part), -1)), "model_ms": ms})

    return decoded(images).select("path", "height", "width", "channels", "data").mapInPandas(run, "path string, features array<float>, model_ms double")


def imagenet_input(a: np.ndarray) -> np.ndarray:
    """RGB in 0..1, less the channel means, over the channel deviations: the input of a pretrained backbone."""
    rgb = a[:, :, ::-1] / 255.0
    return ((rgb - np.array([0.485, 0.456, 0.406])) / np.array([0.229, 0.224, 0.225])).astype(np.float32)


def mean_pooled(descriptors: np.ndarray | None, size: int) -> np.ndarray:
    """Mean of local descriptors; zeros where there are none."""
    return np.zeros(size) if descriptors is None or not len(descriptors) else np.asarray(descriptors, float).mean(0)


def library_extractor(name: str) -> Extractor:
    """``orb`` (32 values) or ``sift`` (128): only where OpenCV is installed; ``color`` needs nothing."""
    if name == "color":
        return color_histogram
    if name not in ("orb", "sift"):
        raise ValueError(f"unknown extractor {name!r}; one of color, orb, sift")
    import cv2

    make, size = (lambda: cv2.ORB_create(500), 32) if name == "orb" else (cv2.SIFT_create, 128)
    return lambda a: mean_pooled(make().detectAndCompute(cv2.cvtColor(a, cv2.COLOR_BGR2GRAY), None)[1], size)

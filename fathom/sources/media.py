"""Media files: descriptors, a codebook of visual or audible words, and vectors by file.

Files are read by Spark; descriptors come from numpy in `mapInPandas`; the codebook is
fitted by mini-batches and histograms are grouped counts.
"""

from __future__ import annotations

import importlib.util
import io
import re
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmeans
from .scratch import scratch

#: MFCC analysis: sample rate, coefficients, mel bands, FFT size, hop; frames of a
#: descriptor and between descriptors.
RATE, COEFFICIENTS, MELS, FFT, HOP = 8000, 20, 40, 512, 256
FRAMES, STRIDE = 32, 16


def wave_samples(content: bytes, sample_rate: int = RATE) -> np.ndarray:
    """Mono samples of PCM WAV at sample_rate; ValueError for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, channels, width, data = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not a PCM WAV file: {e}") from e
    if width not in (1, 2, 4):
        raise ValueError(f"{width * 8}-bit samples are not supported")
    x = np.frombuffer(data, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    x = (x - 128) / 128 if width == 1 else x / 2 ** (8 * width - 1)
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(1)
    n = int(len(x) * sample_rate / rate)
    return np.interp(np.arange(n) * rate / sample_rate, np.arange(len(x)), x) if len(x) else x


def _mel_filters(sample_rate: int = RATE) -> np.ndarray:
    mel = np.linspace(0, 2595 * np.log10(1 + sample_rate / 2 / 700), MELS + 2)
    bins = (700 * (10 ** (mel / 2595) - 1)) / (sample_rate / 2) * (FFT // 2)
    at = np.arange(FFT // 2 + 1)
    rise = (at - bins[:-2, None]) / (bins[1:-1] - bins[:-2])[:, None]
    fall = (bins[2:, None] - at) / (bins[2:] - bins[1:-1])[:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


def mfcc_descriptors(content: bytes, sample_rate: int = RATE) -> np.ndarray:
    """(n, 2 x COEFFICIENTS): mean and deviation of the MFCCs in sliding windows of frames."""
    x = wave_samples(content, sample_rate)
    x = np.pad(x, (0, max(0, FFT - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP] * np.hanning(FFT)
    power = np.log(np.abs(np.fft.rfft(frames)) ** 2 @ _mel_filters(sample_rate).T + 1e-10)
    k, n = np.arange(COEFFICIENTS)[:, None], np.arange(MELS)[None]
    mfcc = power @ np.cos(np.pi * k * (2 * n + 1) / (2 * MELS)).T
    starts = range(0, max(len(mfcc) - FRAMES, 0) + 1, STRIDE)
    return np.array([np.concatenate([w.mean(0), w.std(0)]) for w in (mfcc[s : s + FRAMES] for s in starts)], np.float32)


def image_descriptors(content: bytes) -> np.ndarray:
    """SIFT descriptors; needs OpenCV, which is optional."""
    import cv2

    image = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_GRAYSCALE)
    if image is None:
        raise ValueError("unreadable image")
    scale = 800 / max(image.shape)
    image = cv2.resize(image, None, fx=scale, fy=scale) if scale < 1 else image
    found = cv2.SIFT_create(nfeatures=200).detectAndCompute(image, None)[1]
    return np.zeros((0, 128), np.float32) if found is None else found[:200]


#: From a file's name, the function from its content to its descriptors.
Extractor = Callable[[str], Callable[[bytes], np.ndarray]]

#: The file endings of each kind.
EXTRACTORS: dict[tuple[str, ...], Callable[[bytes], np.ndarray]] = {(".wav",): mfcc_descriptors, (".jpg", ".jpeg", ".png", ".bmp"): image_descriptors}


def extractor_for(name: str) -> Callable[[bytes], np.ndarray]:
    for endings, extract in EXTRACTORS.items():
        if name.lower().endswith(endings):
            return extract
    raise ValueError(f"no extractor for {name}")


def media_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, path, content) of the files below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")


def literal_glob(name: str) -> str:
    """A glob that matches this file name alone."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def descriptors(files: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(key, descriptor): a row for each descriptor; unreadable files have none."""
    extractor = extractor or extractor_for

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, found = [], []
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    rows = extractor(name)(content)
                except (ValueError, ImportError):
                    continue
                keys += [name] * len(rows)
                found += [r.tolist() for r in rows]
            yield pd.DataFrame({"key": keys, "descriptor": found})

    return files.select("name", "content").mapInPandas(each, "key string, descriptor array<float>")


class Codebook:
    """k-means words over descriptors and their inverse document frequencies."""

    def __init__(self, k: int = 256):
        self.k, self.centers, self.idf = k, None, None

    def fit(self, rows: DataFrame) -> Codebook:
        """rows: (key, descriptor).  k is lowered to the number of distinct descriptors."""
        folder = scratch(rows.sparkSession)

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return rows.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        self.centers = kmeans.fit(rows, "key", "descriptor", self.k, written)
        counts = self.words(rows).groupBy("key", "word").count().groupBy("word").agg(F.count("*").alias("df"))
        keys = rows.select("key").distinct().count()
        self.idf = np.full(len(self.centers), np.log(keys + 1.0))
        for r in counts.collect():  # a row a word
            self.idf[r["word"]] = np.log((keys + 1) / (r["df"] + 1))
        return self

    def words(self, rows: DataFrame) -> DataFrame:
        """(key, word): the nearest centre of each descriptor."""
        return kmeans.assigned(rows.select("key", "descriptor"), "descriptor", self.centers).select("key", "word")

    def histograms(self, rows: DataFrame) -> DataFrame:
        """(key, vec): word shares times idf, to unit length."""
        if self.idf is None:
            raise RuntimeError("the codebook is not fitted")
        counts = self.words(rows).groupBy("key", "word").count().groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("m"), F.sum("count").alias("n"))
        weighted = F.array(*[F.coalesce(F.col("m")[w], F.lit(0)) / F.col("n") * float(v) for w, v in enumerate(self.idf)])
        out = counts.select("key", weighted.alias("raw"))
        length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
        return out.select("key", F.when(length > 0, F.transform("raw", lambda x: x / length)).otherwise(F.col("raw")).alias("vec"))

    def save(self, spark: SparkSession, folder: str) -> None:
        """Centres and idf, a row a word."""
        if self.idf is None:
            raise RuntimeError("the codebook is not fitted")
        rows = [(i, c.tolist(), float(w)) for i, (c, w) in enumerate(zip(self.centers.astype(float), self.idf, strict=True))]
        spark.createDataFrame(rows, "word int, center array<double>, idf double").coalesce(1).write.mode("overwrite").parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Codebook | None:
        """A saved codebook; None where there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = spark.read.parquet(folder).orderBy("word").collect()  # a row a word
        out = cls(len(rows))
        out.centers, out.idf = np.array([r["center"] for r in rows]), np.array([r["idf"] for r in rows])
        return out

    def quantize(self, found: np.ndarray) -> list[float]:
        """The vector of one file's descriptors, on the driver."""
        if self.idf is None:
            raise RuntimeError("the codebook is not fitted")
        if not len(found):
            return [0.0] * len(self.idf)
        near = kmeans.distances(found.astype(np.float64), self.centers).argmin(1)
        raw = np.bincount(near, minlength=len(self.idf)) / len(found) * self.idf
        length = np.linalg.norm(raw)
        return (raw / length if length else raw).tolist()


class FolderResolver:
    """Vectors for files of a media folder; the codebook is learned once, over all of it."""

    def __init__(self, spark: SparkSession, folder: str, endings: tuple[str, ...], k: int = 32, kept: str | None = None, extractor: Extractor | None = None):
        """kept: a folder for the codebook, so that a restart needn't learn again.

        extractor: file name -> function from content to descriptors, extractor_for by default.
        """
        self.spark, self.folder, self.endings, self.k, self.kept = spark, folder, endings, k, kept
        self.extractor = extractor or extractor_for
        self.codebook: Codebook | None = None

    def handles(self, name: str) -> bool:
        return name.lower().endswith(self.endings)

    def _files(self) -> DataFrame:
        return media_files(self.spark, self.folder, "*{" + ",".join(self.endings) + "}")

    def resolve(self, name: str) -> list[float]:
        row = media_files(self.spark, self.folder, literal_glob(name.rsplit("/", 1)[-1])).orderBy("path").first()
        if row is None:
            raise ValueError(f"no media file {name}")
        return self.learned().quantize(self.extractor(name)(bytes(row["content"])))

    def learned(self) -> Codebook:
        """The codebook: held, or kept in a folder from an earlier session, or learned now."""
        if self.codebook is None and self.kept:
            self.codebook = Codebook.load(self.spark, self.kept)
        if self.codebook is None:
            rows = descriptors(self._files(), self.extractor).persist()
            try:
                self.codebook = Codebook(self.k).fit(rows)
            finally:
                rows.unpersist()
            if self.kept:
                self.codebook.save(self.spark, self.kept)
        return self.codebook


class AnyResolver:
    """The first resolver that handles a name's ending."""

    def __init__(self, *resolvers: FolderResolver):
        self.resolvers = resolvers

    def resolve(self, name: str) -> list[float]:
        for r in self.resolvers:
            if r.handles(name):
                return r.resolve(name)
        raise ValueError(f"no resolver for {name}")


def default_resolver(spark: SparkSession, folder: str, k: int = 32, kept: str | None = None) -> AnyResolver:
    """Images by SIFT where OpenCV is installed, and sound by MFCC; kept: a folder for the codebooks."""
    kinds = {"image": next(e for e in EXTRACTORS if ".png" in e), "audio": next(e for e in EXTRACTORS if ".wav" in e)}
    if importlib.util.find_spec("cv2") is None:
        del kinds["image"]
    return AnyResolver(*[FolderResolver(spark, folder, endings, k, f"{kept}/codebook_{name}" if kept else None) for name, endings in kinds.items()])

"""Loading CSV data sets into tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import flattened

#: Audio features of a song, in the order of its vector.
FEATURES = ("danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness", "instrumentalness", "liveness", "valence", "tempo", "duration_ms")
#: Endings of audio files, the preferred first.
AUDIO = (".mp3", ".wav", ".ogg")


@dataclass
class Dataset:
    """A table to be: columns with types, indexes as (column, kind, options), and its rows."""

    name: str
    columns: list[tuple[str, str]]
    indexes: list[tuple[str, str, dict]]
    rows: DataFrame
    report: dict = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def joined_last(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with the last row that right has for each key; the left's rows in order, ids from 1."""
    right = right.withColumn("_at", F.monotonically_increasing_id())
    last = right.groupBy(key).agg(F.max_by(F.struct(*[c for c in right.columns if c not in (key, "_at")]), "_at").alias("_r")).select(key, "_r.*")
    left = left.withColumn("_left", F.monotonically_increasing_id())
    return left.join(last.select(key, *[c for c in last.columns if c not in left.columns]), key)


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Ids from 1 by order: ranks within ranges of the order plus the ranges before, in one window of ranges."""
    parts = df.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p").count()
    before = counts.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parts.withColumn("_n", within).join(F.broadcast(before), "_p").withColumn("id", (F.col("_n") + F.col("_b")).cast("long")).drop("_p", "_n", "_b")


def songs(spark: SparkSession, lyrics_csv: str, features_csv: str, images: str | None = None) -> Dataset:
    """Lyrics joined to audio features; a cover's file name, or ''."""
    lyrics, features = read_csv(spark, lyrics_csv), read_csv(spark, features_csv)
    rows = joined_last(lyrics.select("track_id", "track_name", "track_artist", "lyrics"), features, "track_id")
    rows = numbered(rows, "_left")
    have = set(rows.columns)
    vec = F.array(*[F.coalesce((F.col(c) if c in have else F.lit(None)).cast("double"), F.lit(0.0)) for c in FEATURES])
    name = F.concat("track_id", F.lit(".jpg"))
    if images:
        there = file_names(spark, images, "*.jpg").withColumnRenamed("name", "_image")
        rows = rows.join(there, name == F.col("_image"), "left").withColumn("image", F.coalesce("_image", F.lit("")))
    else:
        rows = rows.withColumn("image", F.lit(""))
    rows = rows.select("id", "track_id", F.col("track_name").alias("title"), F.col("track_artist").alias("artist"), flattened(F.col("lyrics")).alias("lyrics"), vec.alias("feat"), "image")
    columns = [("id", "INT"), ("track_id", "TEXT"), ("title", "TEXT"), ("artist", "TEXT"), ("lyrics", "TEXT"), ("feat", "VECTOR"), ("image", "TEXT")]
    return Dataset("tracks", columns, [("id", "bplus", {}), ("lyrics", "inverted", {}), ("feat", "knn", {})], rows)


def file_names(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(name) of the files below folder, without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()


def tracks(spark: SparkSession, tracks_csv: str, audio: str) -> Dataset:
    """Track metadata with the first genre's title, for tracks that have an audio file."""
    meta = read_csv(spark, tracks_csv).filter("trim(track_id) <> ''").withColumn("_left", F.monotonically_increasing_id())
    meta = meta.withColumn("number", F.col("track_id").cast("long")).withColumn("stem", F.lpad(F.col("number").cast("string"), 6, "0"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(AUDIO) + "}").load(audio)
    parts = files.select(F.split("path", "/").alias("p")).select(F.element_at("p", -1).alias("name"), F.element_at("p", -2).alias("folder"))
    parts = parts.withColumn("stem", F.regexp_extract("name", r"^(.*)\.[^.]+$", 1))
    # A folder named by the first three digits comes before the top one, then the ending counts.
    rank = F.struct((F.col("folder") != F.substring("stem", 1, 3)).alias("top"), F.array_position(F.array(*map(F.lit, AUDIO)), F.regexp_extract("name", r"(\.[^.]+)$", 1)).alias("ending"))
    best = parts.groupBy("stem").agg(F.min_by("name", rank).alias("audio"))
    rows = numbered(meta.join(best, "stem"), "_left")
    genre = F.regexp_extract(F.coalesce("track_genres", F.lit("")), r"'genre_title': '([^']*)'", 1)
    rows = rows.select("id", F.col("number").cast("string").alias("track_id"), F.col("track_title").alias("title"), F.col("artist_name").alias("artist"), genre.alias("genre"), "audio")
    columns = [("id", "INT"), ("track_id", "TEXT"), ("title", "TEXT"), ("artist", "TEXT"), ("genre", "TEXT"), ("audio", "TEXT")]
    return Dataset("fma_tracks", columns, [("id", "bplus", {}), ("genre", "hash", {})], rows)


@dataclass
class ImportReport:
    table: str
    rows_inserted: int = 0
    batches: int = 0
    indexes: list[str] = field(default_factory=list)  # column:kind


def import_dataset(engine, data: Dataset, limit: int | None = None, batches: int = 1) -> ImportReport:
    """Create the table and its indexes, then load the rows in so many writes; one does for any size.

    Texts are flattened and floats kept to twelve decimals.  Booleans and nulls have
    no literal in the dialect and are refused before anything is made.
    """
    if batches < 1:
        raise ValueError("at least one batch")
    rows = data.rows.select(*[c for c, _ in data.columns])
    if refused := [f.name for f in rows.schema if isinstance(f.dataType, T.BooleanType)]:
        raise TypeError(f"booleans can't be imported: {', '.join(refused)}")
    rows = rows if limit is None else rows.orderBy(rows.columns[0]).limit(limit)
    empty = rows.agg(*[F.max(F.col(c).isNull()).alias(c) for c in rows.columns]).first().asDict()
    if nulls := [c for c, some in empty.items() if some]:
        raise TypeError(f"nulls can't be imported: {', '.join(nulls)}")
    rows = rows.select(*[_literal(f) for f in rows.schema])
    engine.storage.create(data.name, data.columns)
    report = ImportReport(data.name)
    for column, kind, options in data.indexes:
        engine.storage.add_index(data.name, column, kind, options)
        report.indexes.append(f"{column}:{kind}")
    for i in range(batches):
        part = rows if batches == 1 else rows.filter(F.pmod(F.xxhash64(rows.columns[0]), F.lit(batches)) == i)
        n = engine.load(data.name, part)
        report.rows_inserted, report.batches = report.rows_inserted + n, report.batches + (n > 0)
    return report


def _literal(f: T.StructField) -> F.Column:
    """A column's values as the dialect's literals would give them."""
    if isinstance(f.dataType, T.StringType):
        return flattened(F.col(f.name)).alias(f.name)
    return F.round(f.name, 12).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name)


class FeatureResolver:
    """Vectors for file names from a CSV of audio features: its row of the file's stem.

    Of rows that repeat a track_id the last counts; missing or empty values are 0.
    """

    def __init__(self, spark: SparkSession, features_csv: str):
        rows = read_csv(spark, features_csv).withColumn("_at", F.monotonically_increasing_id())
        rows = rows.withColumn("track_id", F.trim("track_id")).filter("track_id <> ''")
        values = F.array(*[F.coalesce((F.col(c) if c in rows.columns else F.lit(None)).cast("double"), F.lit(0.0)) for c in FEATURES[:-1]])
        self.rows = rows.groupBy("track_id").agg(F.max_by(values, "_at").alias("vec"))

    def handles(self, name: str) -> bool:
        return True

    def resolve(self, name: str) -> list[float]:
        stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        row = self.rows.filter(F.col("track_id") == stem).first()
        if row is None:
            raise ValueError(f"no features of {stem}")
        return list(row["vec"])

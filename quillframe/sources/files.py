"""Files in and out: images, texts, JSON of several shapes, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions.text import allowed_extension, strip

#: What an upload may be.
EXTENSIONS, CAP = ("jpg", "jpeg", "png", "webp", "bmp", "tiff"), 25 * 1024 * 1024
COCO = "images array<struct<id:long,file_name:string>>, annotations array<struct<image_id:long,group_id:long,attributes:struct<translation:string>,segmentation:array<array<double>>>>"
PROFILE = "user_id string, display_name string, total_corrections int, created_at string, last_updated_at string, character_confusions map<string,int>, custom_vocabulary array<string>"
MANIFEST = "train array<struct<image_path:string,text:string,source:string>>, val array<struct<image_path:string,text:string,source:string>>"
SAMPLES = "id string, title string, subject string, date string, file string, thumb string, truth string"


def uploads(spark: SparkSession, path: str, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """Files within the cap and of the right kind, and the rest in quarantine. Contents are read only where they are used."""
    files = spark.read.format("binaryFile").load(path)
    good = (F.col("length") <= cap) & allowed_extension(F.col("path"), EXTENSIONS)
    return files.filter(good), files.filter(~good).drop("content")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file as a whole; a missing path is an error."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word: lower-case distinct lines; empty if the file is absent."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(strip(F.lower("value")).alias("word")).filter("word <> ''").distinct()


def annotations(spark: SparkSession, path: str, present: DataFrame | None = None) -> DataFrame:
    """file_name, group_id, pos, text, x0, y0, x1, y1 of each usable annotation; those without an image, and of images not in `present` (file_name), go."""
    raw = spark.read.schema(COCO).json(path, multiLine=True)
    images = raw.select(F.explode("images").alias("i")).select("i.id", "i.file_name")
    marks = raw.select(F.posexplode("annotations").alias("pos", "a")).select("pos", "a.*")
    polygon = F.flatten("segmentation")
    xs = F.filter(polygon, lambda _, k: k % 2 == 0)
    ys = F.filter(polygon, lambda _, k: k % 2 == 1)
    d = marks.join(images, marks.image_id == images.id).filter((strip(F.col("attributes.translation")) != "") & (F.size(F.get("segmentation", 0)) >= 6))
    if present is not None:
        d = d.join(present.select("file_name"), "file_name", "left_semi")
    return d.select("file_name", "group_id", "pos", strip(F.col("attributes.translation")).alias("text"), F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with each missing key at its default."""
    d = spark.read.schema(PROFILE).json(path, multiLine=True)
    return d.withColumns({
        "display_name": F.coalesce("display_name", "user_id"),
        "total_corrections": F.coalesce("total_corrections", F.lit(0)),
        "character_confusions": F.coalesce("character_confusions", F.create_map().cast("map<string,int>")),
        "custom_vocabulary": F.coalesce("custom_vocabulary", F.array().cast("array<string>")),
    })


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """image_path, text, source, split of a manifest's samples."""
    d = spark.read.schema(MANIFEST).json(path, multiLine=True)
    return d.select(F.explode("train").alias("s"), F.lit("train").alias("split")).union(d.select(F.explode("val").alias("s"), F.lit("val").alias("split"))).select("s.*", "split")


def sample_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).json(path, multiLine=True)


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines, as many files as partitions."""
    rows.write.mode("overwrite").json(path)


def write_texts(rows: DataFrame, path: str, key: str, content: str = "content") -> None:
    """One folder of text for each key; a key's name cannot leave the path, as partition values are escaped."""
    rows.select(key, F.col(content).alias("value")).write.mode("overwrite").option("lineSep", "\n").partitionBy(key).text(path)


def write_profiles(rows: DataFrame, path: str) -> None:
    rows.withColumn("custom_vocabulary", F.array_sort("custom_vocabulary")).write.mode("overwrite").json(path)


def replace_partitions(rows: DataFrame, path: str, parent: str) -> None:
    """Children of the parents in `rows` give way to them; other partitions stay. Doing it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)

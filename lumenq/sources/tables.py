"""Tables, corpora and labelled folders; and the sinks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def plain_tokens(spark: SparkSession, path: str, pattern: str = tx.ARABIC) -> DataFrame:
    """Tokens line by line: a large file splits."""
    return spark.read.text(path).select(F.explode(tx.found(F.col("value"), pattern)).alias("word"))


def dump_tokens(spark: SparkSession, path: str, pattern: str = tx.ARABIC, row_tag: str | None = None) -> DataFrame:
    """Tokens of a dump's text parts; with ``row_tag`` the XML source splits large dumps by page."""
    if row_tag:
        pages = spark.read.format("xml").option("rowTag", row_tag).schema("revision struct<text string>, text string").load(path)
        lines = F.split(F.coalesce("text", "revision.text"), "\n")
        return pages.select(F.explode(lines).alias("line")).select(F.explode(tx.found(F.col("line"), pattern)).alias("word"))
    lines = whole_texts(spark, path).select(F.explode(tx.dump_text(F.col("text"))).alias("line"))
    return lines.select(F.explode(tx.found(F.col("line"), pattern)).alias("word"))


def images(spark: SparkSession, path: str, glob: str | None = None, drop_invalid: bool = False) -> DataFrame:
    """``path, h, w, channels, px``: blue, green, red by row; bad files keep a null image."""
    reader = spark.read.format("image").option("dropInvalid", str(drop_invalid).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    got = reader.load(path).select("image.*")
    good = F.col("height") > 0
    return got.select(F.col("origin").alias("path"), *[F.when(good, F.col(c)).alias(n) for c, n in (("height", "h"), ("width", "w"), ("nChannels", "channels"), ("data", "px"))])


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, name``, nothing read but the names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("name"))


def labelled_folders(files: DataFrame, synonyms: dict[str, str] | None = None) -> DataFrame:
    """``files`` with ``label``, the parent folder's name after merging synonyms."""
    from ..functions.arabic import merge_label

    return files.withColumn("label", merge_label(F.regexp_extract("path", "([^/]+)/[^/]+$", 1), synonyms or {}))


def labelled_csv(spark: SparkSession, csv: str, image_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``image_path,label`` with their images, and the rows whose image is missing or bad."""
    rows = spark.read.csv(csv, header=True, schema="image_path string, label string")
    pictures = images(spark, image_dir).withColumn("name", F.regexp_extract("path", "[^/]+$", 0)).where("px is not null")
    named = rows.withColumn("name", F.regexp_extract("image_path", "[^/]+$", 0))
    return named.join(pictures, "name"), named.join(pictures.select("name"), "name", "left_anti")


def numbered_names(rows: DataFrame, label: str, order: str, suffix: str = ".jpg") -> DataFrame:
    """``filename``: label and a running number from 0 within the label."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1
    return rows.withColumn("filename", F.concat(F.col(label), F.format_string("_%04d" + suffix, place)))


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Categories, images and annotations of a COCO file."""
    schema = "categories array<struct<id:long,name:string>>, images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,iscrowd:int>>"
    whole = spark.read.schema(schema).json(path, multiLine=True)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("categories", "images", "annotations"))


def yolo_lines(categories: DataFrame, pictures: DataFrame, annotations: DataFrame, classes: dict[str, int]) -> DataFrame:
    """``image_id, lines``: one line per annotation of a known class that is no
    crowd; pictures without any have an empty array."""
    from ..functions import boxes as bx

    known = spark_classes(categories.sparkSession, classes)
    rows = annotations.where(F.coalesce("iscrowd", F.lit(0)) == 0).join(F.broadcast(categories.join(known, "name").select(F.col("id").alias("category_id"), "cls")), "category_id")
    rows = rows.join(pictures.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    corner = bx.from_xywh(*[F.element_at("bbox", i) for i in (1, 2, 3, 4)])
    centre = bx.to_centre(corner, F.col("width"), F.col("height"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", centre["cx"], centre["cy"], centre["w"], centre["h"])
    lines = rows.select("image_id", "id", line.alias("line")).groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]).alias("lines"))
    return pictures.select(F.col("id").alias("image_id")).join(lines, "image_id", "left").select("image_id", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def spark_classes(spark: SparkSession, classes: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(classes.items()), "name string, cls int")


def read_yolo(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of five fields as columns, others dropped."""
    parts = F.split(F.trim(line), r"\s+")
    five = lines.where(F.size(parts) == 5)
    return five.select(*[c for c in lines.columns if c != line], parts[0].cast("int").alias("cls"), *[parts[i + 1].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))])


def batch_labels(rows: DataFrame, order: str, labels: str) -> DataFrame:
    """Ragged label arrays flattened: each entry with the number of its image in the batch."""
    from pyspark.sql.window import Window

    numbered = rows.withColumn("batch_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)  # one batch of images
    return numbered.select("batch_idx", F.explode(labels).alias("label"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_dataset(rows: DataFrame, label: str, order: str, folder: str) -> DataFrame:
    """A labelled set of images: ``images`` (name, label and pixels) and
    ``labels.csv`` (image_path, label); its rows are returned as they read again."""
    named = numbered_names(rows, label, order).withColumn("image_path", F.concat_ws("/", F.col(label).cast("string"), "filename"))
    write_parquet(named, f"{folder}/images")
    stored = rows.sparkSession.read.parquet(f"{folder}/images")
    stored.select("image_path", F.col(label).alias("label")).write.mode("overwrite").csv(f"{folder}/labels.csv", header=True)
    return rows.sparkSession.read.csv(f"{folder}/labels.csv", header=True, schema="image_path string, label string")


def load_features(spark: SparkSession, folder: str, classes: list[str]) -> DataFrame:
    """The features stored by class under ``folder/label=...``; an error names the classes that are not there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [c for c in classes if not system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/label={c}"))]
    if missing:
        raise FileNotFoundError(f"no features of {', '.join(missing)} in {folder}")
    return spark.read.parquet(folder).where(F.col("label").cast("string").isin(classes))


def not_yet(wanted: DataFrame, there: DataFrame, key: str = "name") -> DataFrame:
    """What is wanted and not there."""
    return wanted.join(there.select(key).distinct(), key, "left_anti")


def png(px: np.ndarray) -> bytes:
    """An 8-bit gray or BGR array as PNG."""
    px = np.ascontiguousarray(px if px.ndim == 2 else px[..., 2::-1], dtype=np.uint8)
    h, w = px.shape[:2]
    body = b"".join(b"\0" + row.tobytes() for row in px)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if px.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def requests(rows: DataFrame, known: Column, command: str = "command", content: str = "content") -> DataFrame:
    """``rows`` with ``error`` for empty contents and unknown commands, null for what can go on."""
    names = F.array_join(known, "، ")
    unknown = F.concat(F.lit("الأمر '"), F.col(command), F.lit("' غير معروف. الأوامر المتاحة: "), names)
    empty = F.col(content).isNull() | (F.length(content) == 0)
    return rows.withColumn("error", F.when(empty, F.lit("Empty image file")).when(~F.array_contains(known, F.col(command)), unknown))

"""Image queries on pages drawn from the driver's tables with small bitmap glyphs.

The tables have no images, so texts are drawn: every letter is a fixed 5 x 7
pattern made from its code by a rule, dots included. The queries run over
every row of ``benchmark`` (or ``region`` and ``nation``, for colours).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates as cd
from ..operators import images, language_model, ml
from ..operators.kernels import imaging as im
from ..operators.kernels import layout, pages, segment
from ..sources.tables import table
from . import pipelines
from .registry import query

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
PAGE = ["item_id", "page_idx"]


def spread(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def glyph(char: str, scale: int = 4) -> np.ndarray:
    """A connected 7 x 5 pattern for a character, drawn from its code."""
    rng = np.random.default_rng(ord(char))
    bits = rng.random((7, 5)) < 0.45
    bits[:, 0] = bits[6] = True  # a stem and a foot, so that it hangs together
    bits[0, :3] = True
    return np.where(np.kron(bits, np.ones((scale, scale))) > 0, im.INK, im.PAPER).astype(np.uint8)


def page(text: str, columns: int = 28, scale: int = 4) -> np.ndarray:
    """Letters in lines of whole words on white paper, blue = green = red."""
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > columns:
            lines, line = [*lines, line], word
        else:
            line = f"{line} {word}".strip()
    lines.append(line)
    step, height = 6 * scale + 2, 13 * scale
    out = np.full((height * len(lines) + 60, step * columns + 80), im.PAPER, np.uint8)
    for r, line in enumerate(lines):
        for c, char in enumerate(line):
            if char.isalpha():
                y, x = 30 + r * height, 40 + c * step
                out[y : y + 7 * scale, x : x + 5 * scale] = glyph(char, scale)
    return np.repeat(out[..., None], 3, 2)


def page_texts(text: str | None, size: int = 100, columns: int = 28) -> list[str]:
    """All letters of a text in pages of at most ``size`` characters, by whole words
    (those longer than a line in parts); an empty text has one empty page."""
    letters = "".join(c for c in (text or "").lower() if c in ALPHABET + " ")
    out = [""]
    for word in (w[i : i + columns] for w in letters.split() for i in range(0, len(w), columns)):
        if out[-1] and len(out[-1]) + 1 + len(word) > size:
            out.append(word)
        else:
            out[-1] = f"{out[-1]} {word}".strip()
    return out


def _draw(batches):
    import pyarrow as pa

    for batch in batches:
        for k, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            made = [{"item_id": k, "page_idx": i, **images.pack(page(part))} for i, part in enumerate(page_texts(t))]
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("item_id", pa.int64()), ("page_idx", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("px", pa.binary())]))


def drawn_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page holds 100 letters and spaces of an item, the next page goes on from there.
    Few rows, much work on each: they are dealt out first."""
    return spread(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id").mapInArrow(_draw, f"item_id long, page_idx int, {images.IMAGE}")


def of_items(spark: SparkSession, sf_dir: str, read) -> DataFrame:
    """``item_id`` and the texts that ``read`` makes of pages by ``page_id``, a line end between pages."""
    found = read(drawn_pages(spark, sf_dir).withColumn("page_id", F.col("item_id") * 1_000_000 + F.col("page_idx")), "page_id")
    names = [c for c in found.columns if c != "page_id"]
    rows = found.groupBy(F.floor(F.col("page_id") / 1_000_000).cast("long").alias("item_id")).agg(F.sort_array(F.collect_list(F.struct("page_id", *names))).alias("p"))
    return rows.select("item_id", *[F.array_join(F.col(f"p.{c}"), "\n").alias(c) for c in names])


def letter_model(spark: SparkSession) -> ml.Classifier:
    """A classifier of drawn letters, trained on distorted copies of them."""
    made = [(k * 100 + v, c, 35, 25, 1, bytes(np.pad(images.distorted(glyph(c), 7 * k + v) if v else glyph(c), ((3, 4), (2, 3)), constant_values=255).tobytes())) for k, c in enumerate(ALPHABET) for v in range(6)]
    rows = spark.createDataFrame(made, f"id int, label string, {images.IMAGE}").repartition(8)
    feats = images.latin_features(rows, ["id", "label"])
    return ml.Classifier("rf").train(feats)


@query()
def image_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.text_frames(drawn_pages(spark, sf_dir), PAGE).select(*PAGE, "frame_idx", "box", "h", "w")


@query()
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks between gaps, and lines by baseline, of every page."""

    def kernel(img, _):
        gray = im.gray(img)
        height = segment.character_height(gray, 50, 5)
        return [{"blocks": len(layout.blocks(img)), "lines": len(layout.baseline_lines(gray, height)), "angle": pages.orientation(gray)}]

    return images.each(drawn_pages(spark, sf_dir), PAGE, kernel, "blocks int, lines int, angle double")


@query()
def arabic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.arabic_characters(images.arabic_pages(drawn_pages(spark, sf_dir), PAGE), PAGE)
    return found.select(*PAGE, "line_idx", "paw_idx", "char_idx", "x", "y", "position", F.size("dots").alias("n_dots"), "h", "w")


@query()
def arabic_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.arabic_characters(images.arabic_pages(drawn_pages(spark, sf_dir), PAGE), PAGE)
    feats = images.arabic_features(found, [*PAGE, "line_idx", "paw_idx", "char_idx"])
    return feats.groupBy("item_id").agg(F.count("*").alias("characters"), F.min(F.size("features")).alias("length"))


@query()
def latin_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to text with the items' own words as the lexicon."""
    words = [r["word"] for r in language_model.words(table(spark, sf_dir, "benchmark")).distinct().collect()]
    return of_items(spark, sf_dir, lambda rows, key: pipelines.latin_text(rows, key, letter_model(spark), words, height=96))


@query()
def arabic_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the right-to-left chain; letters are named by two forms so that names become glyphs."""
    made = [(k, f"{name}_Isolated", *images.pack(glyph(c)).values()) for k, (c, name) in enumerate(zip("abcdefgh", ("Baa", "Taa", "Raa", "Dal", "Seen", "Lam", "Meem", "Waw"), strict=True))]
    rows = spark.createDataFrame([(r[0] * 10 + v, *r[1:]) for r in made for v in range(3)], f"id int, label string, {images.IMAGE}").withColumn("dots", F.lit(None).cast("array<struct<cx:double,cy:double,cluster_size:int,position:string>>"))
    model = ml.Classifier("rf").train(images.arabic_features(rows, ["id", "label"]))
    return of_items(spark, sf_dir, lambda rows, key: pipelines.arabic_text(rows, key, model, {"بت": 0.4, "تر": 0.3}, {"بت": 3, "در": 2}))


def _solid(batches):
    import pyarrow as pa

    for batch in batches:
        made = []
        for k in batch.column("key").to_pylist():
            rng = np.random.default_rng(int(k) + 5)
            img = np.full((64, 64, 3), rng.integers(0, 256, 3), np.uint8)
            made.append({"key": k, **(images.pack(img) if k % 9 != 8 else images.pack(None))})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("key", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("px", pa.binary())]))


@query()
def colour_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid pictures, one a nation; every ninth is undecodable and reports an error."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key")).mapInArrow(_solid, f"key long, {images.IMAGE}")
    return pipelines.colour_names(rows, "key").select("key", "color", "confidence", "error")


def _scenes(batches):
    import pyarrow as pa

    for batch in batches:
        made = []
        for k in batch.column("key").to_pylist():
            rng = np.random.default_rng(int(k))
            img = np.full((220, 260, 3), 235, np.uint8)
            y, x = rng.integers(5, 80), rng.integers(5, 100)
            img[y : y + 110, x : x + 110 : 8] = 20
            img[y : y + 110 : 10, x : x + 110] = 60
            made.append({"key": k, **images.pack(img)})
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("key", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("px", pa.binary())]))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key")), "key").mapInArrow(_scenes, f"key long, {images.IMAGE}")


def grid_model(spark: SparkSession) -> ml.Classifier:
    """Tells gridded patches from plain and noisy ones."""
    rng = np.random.default_rng(3)
    made = []
    for k in range(40):
        img = np.full((96, 96, 3), 235, np.uint8)
        if k % 2:
            step = int(rng.integers(6, 11))
            img[:, ::step] = 20
            img[::10] = 60
        else:
            img[:] = rng.integers(0, 256, 3)
            img[int(rng.integers(96)) :, : int(rng.integers(96))] = 90
        made.append((k, str(k % 2), *images.pack(img).values()))
    rows = spark.createDataFrame(made, f"id int, label string, {images.IMAGE}").repartition(4)
    return ml.Classifier("rf").train(images.patch_features(rows, ["id", "label"]))


@query()
def object_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with one gridded square each."""
    return pipelines.detections(scenes(spark, sf_dir), "key", {"chair": grid_model(spark)}, confidence=0.6)


@query()
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of plain pictures that a model takes for objects: the first 1500, a limit that is the feature."""
    windows = ml.windows(scenes(spark, sf_dir), 96, 32)
    scored = grid_model(spark).predict(images.patch_features(_patches(windows), ["key", "y", "x"]), k=2)
    scored = scored.withColumn("score", cd.total(F.filter("cands", lambda c: c["label"] == "1")))
    return ml.hard_negatives(scored, ["key", "y", "x"]).select("key", "y", "x", F.round("score", 6).alias("score"))


def _patches(windows: DataFrame) -> DataFrame:
    kernel = lambda img, row: [images.pack(img[row["y"] : row["y"] + 96, row["x"] : row["x"] + 96])]
    return images.each(windows, ["key", "y", "x"], kernel, images.IMAGE)

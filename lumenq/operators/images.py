"""Images as rows: kernels over Arrow batches.

An image is ``h, w, channels, px`` (uint8, row by row; blue, green, red); a null
``px`` gives null or no rows. Keys and the image alone go to Python.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .kernels import features as ft
from .kernels import imaging as im
from .kernels import pages, segment

IMAGE = "h int, w int, channels int, px binary"
#: Bytes of images whose results make one batch.
_TOGETHER = 4 << 20


def unpack(row: dict) -> np.ndarray | None:
    if row["px"] is None or not row["h"] or not row["w"]:
        return None
    px = np.frombuffer(row["px"], np.uint8)
    c = row["channels"] or 1
    return px.reshape(row["h"], row["w"], c) if c > 1 else px.reshape(row["h"], row["w"])


def pack(img: np.ndarray | None) -> dict:
    if img is None:
        return {"h": None, "w": None, "channels": None, "px": None}
    img = np.ascontiguousarray(img, np.uint8)
    return {"h": img.shape[0], "w": img.shape[1], "channels": 1 if img.ndim == 2 else img.shape[2], "px": img.tobytes()}


def each(rows: DataFrame, keys: list[str], kernel: Callable[[np.ndarray | None, dict], list[dict]], schema: str, carry: list[str] | None = None) -> DataFrame:
    """``keys`` and what ``kernel`` gives, one row or many, for each image;
    ``carry`` names columns that the kernel sees besides."""
    types = dict(rows.dtypes)
    out = ", ".join([*[f"`{k}` {types[k]}" for k in keys], schema])
    arrow = to_arrow_schema(_parse_datatype_string(out))

    def run(batches):
        made, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):  # one image at a time
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                made += [{**{k: row[k] for k in keys}, **r} for r in kernel(unpack(row), row)]
                size += len(row["px"] or b"")
                if size > _TOGETHER or len(made) > 5000:
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
                    made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return rows.select(*dict.fromkeys([*keys, *(carry or []), "h", "w", "channels", "px"])).mapInArrow(run, out)


def mapped(rows: DataFrame, keys: list[str], kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The same rows with another image; bad images stay null."""
    return each(rows, keys, lambda img, _: [pack(None if img is None else kernel(img))], IMAGE)


def resized(rows: DataFrame, keys: list[str], most: int = 1280, rounded: bool = False) -> DataFrame:
    return mapped(rows, keys, lambda img: im.shrink(img, most, rounded))


def arabic_pages(rows: DataFrame, keys: list[str]) -> DataFrame:
    return mapped(rows, keys, lambda img: pages.arabic_page(im.shrink(img, 2000, True)))


def text_frames(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per text frame: ``frame_idx``, its box and its image."""

    def kernel(img, _):
        found = [] if img is None else pages.text_frames(img)
        return [{"frame_idx": k, "box": dict(zip(("x1", "y1", "x2", "y2"), map(int, box), strict=True)), **pack(crop)} for k, (box, crop) in enumerate(found) if crop.size]

    return each(rows, keys, kernel, f"frame_idx int, box struct<x1:int,y1:int,x2:int,y2:int>, {IMAGE}")


def latin_pages(rows: DataFrame, keys: list[str], height: int = pages.SCALE_HEIGHT) -> DataFrame:
    return mapped(rows, keys, lambda img: pages.latin_page(img, height))


_DOT = "struct<cx:double,cy:double,cluster_size:int,position:string>"


def arabic_characters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per character of binary pages, in reading order."""

    def kernel(img, _):
        return [{**{k: c[k] for k in ("line_idx", "paw_idx", "char_idx", "x", "y", "position", "dots")}, **pack(c["img"])} for c in ([] if img is None else segment.arabic_characters(img))]

    return each(rows, keys, kernel, f"line_idx int, paw_idx int, char_idx int, x int, y int, position string, dots array<{_DOT}>, {IMAGE}")


def latin_characters(rows: DataFrame, keys: list[str]) -> DataFrame:
    def kernel(img, _):
        return [{**{k: c[k] for k in ("line_idx", "word_idx", "word_x", "char_idx", "x", "y")}, **pack(c["img"])} for c in ([] if img is None else segment.latin_characters(img))]

    return each(rows, keys, kernel, f"line_idx int, word_idx int, word_x int, char_idx int, x int, y int, {IMAGE}")


def arabic_features(chars: DataFrame, keys: list[str]) -> DataFrame:
    kernel = lambda img, row: [{"features": ft.arabic_character(img, row["dots"]).tolist()}] if img is not None else []
    return each(chars, keys, kernel, "features array<float>", ["dots"])


def latin_features(chars: DataFrame, keys: list[str]) -> DataFrame:
    return each(chars, keys, lambda img, _: [{"features": ft.latin_character(img).tolist()}] if img is not None else [], "features array<float>")


def colours(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``light, a, b`` of the dominant colour, null for bad images."""

    def kernel(img, _):
        found = None if img is None else im.dominant_lab(im.shrink(img if img.ndim == 3 else np.repeat(img[..., None], 3, 2), 1280)).tolist()
        return [dict(zip(("light", "a", "b"), found or (None,) * 3, strict=True))]

    return each(rows, keys, kernel, "light double, a double, b double")


def proposals(rows: DataFrame, keys: list[str], least: int = 48) -> DataFrame:
    """Candidate boxes: components of three gray levels and a grid of windows,
    numbered; in the place of a region proposer that is not available here."""

    def kernel(img, _):
        if img is None:
            return []
        gray = im.gray(img)
        h, w = gray.shape
        boxes = [b for level in np.unique(np.percentile(gray, (25, 50, 75))) for b in im.Components(gray < level).boxes()]
        for size in (96, 160, 256):
            boxes += [(x, y, x + size, y + size) for y in range(0, h - size + 1, size // 2) for x in range(0, w - size + 1, size // 2)]
        boxes = list(dict.fromkeys(b for b in boxes if b[2] - b[0] >= least and b[3] - b[1] >= least))
        return [{"proposal": k, "box": dict(zip(("x1", "y1", "x2", "y2"), map(float, b), strict=True)), **pack(im.crop(img, b))} for k, b in enumerate(boxes)]

    return each(rows, keys, kernel, f"proposal int, box struct<x1:double,y1:double,x2:double,y2:double>, {IMAGE}")


def patch_features(patches: DataFrame, keys: list[str]) -> DataFrame:
    return each(patches, keys, lambda img, _: [{"features": ft.patch(img).tolist()}] if img is not None and img.size else [], "features array<float>")


def augmented(patches: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The image, its mirror image, and a copy up to 30 levels lighter or darker, by hash."""

    def kernel(img, row):
        if img is None:
            return []
        shift = int(row["_shift"])
        return [{"variant": v, **pack(p)} for v, p in enumerate((img, img[:, ::-1], np.clip(img.astype(int) + shift, 0, 255)))]

    moved = patches.withColumn("_shift", F.pmod(F.xxhash64(id_col), F.lit(61)).cast("int") - 30)
    return each(moved, keys, kernel, f"variant int, {IMAGE}", ["_shift"])


def tight(img: np.ndarray, level: int = 200, pad: int = 2) -> np.ndarray:
    """Cropped to what is darker than ``level``, with a margin."""
    y, x = np.nonzero(img < level)
    if not len(y):
        return img
    return img[max(0, y.min() - pad) : y.max() + pad + 1, max(0, x.min() - pad) : x.max() + pad + 1]


def distorted(img: np.ndarray, seed: int) -> np.ndarray:
    """A character turned by up to ten degrees, with noise, and thicker or thinner; the same for a seed."""
    rng = np.random.default_rng(seed)
    out = im.rotate(img, float(rng.uniform(-10, 10)))
    if rng.random() < 0.5:
        out = np.clip(out + rng.normal(0, 8, out.shape), 0, 255).astype(np.uint8)
    dice = rng.random()
    return im.erode(out, im.box_kernel(2, 2)) if dice < 0.3 else im.dilate(out, im.box_kernel(2, 2)) if dice > 0.7 else out


def error_column(px: Column) -> Column:
    """What an undecodable image reports."""
    return F.when(px.isNull(), F.lit("Could not decode image"))

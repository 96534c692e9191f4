"""Image kernels on small images that SQL can repeat: vectors as 8 x 8 pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images
from ..operators.kernels import features as ft
from ..operators.kernels import imaging as im
from ..operators.kernels import pages
from ..sources.tables import table
from .registry import query

_LIST = "list_transform(embedding, lambda v: greatest(0, least(255, floor(128 + v::DOUBLE * 400)))::BIGINT)"
_PX = f"(SELECT vec_id, l, (i - 1) // 8 AS y, (i - 1) % 8 AS x, l[i] AS p FROM (SELECT vec_id, {_LIST} AS l, unnest(range(1, 65)) AS i FROM embeddings))"
#: Numbers that tell an image from others: its sum, and its sum by place.
_DIGEST = "sum({0})::BIGINT AS {1}, sum({0} * (y * 8 + x + 1))::BIGINT AS {1}_at"


def _at(y: str, x: str) -> str:
    """The pixel at a place, mirrored at the edges without the edge itself."""
    return f"l[(7 - abs(7 - abs({y}))) * 8 + 7 - abs(7 - abs({x})) + 1]"


def _digest(values: np.ndarray, name: str) -> dict:
    values = values.astype(np.int64)
    return {name: int(values.sum()), f"{name}_at": int((values.ravel() * np.arange(1, values.size + 1)).sum())}


def pixels(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """Images from vectors; with three channels each pixel has its own value, the next one and the one after."""
    value = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + v.cast("double") * 400).cast("int"))))
    shifted = [value, *[F.concat(F.slice(value, k + 1, 64 - k), F.slice(value, 1, k)) for k in range(1, channels)]]
    flat = value
    if channels == 3:
        flat = F.flatten(F.transform(F.arrays_zip(*[v.alias(n) for n, v in zip("bgr", shifted, strict=True)]), lambda s: F.array(s["b"], s["g"], s["r"])))
    px = F.unhex(F.array_join(F.transform(flat, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(channels).alias("channels"), px.alias("px"))


def _each(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], list[dict] | dict], schema: str, channels: int = 1) -> DataFrame:
    def run(img, _):
        out = kernel(img)
        return out if isinstance(out, list) else [out]

    return images.each(pixels(spark, sf_dir, channels), ["vec_id"], run, schema)


@query(f"""SELECT vec_id, {_DIGEST.format('g', 'gray')} FROM (SELECT vec_id, y, x, (l[y * 8 + x + 1] * 1868 + l[(y * 8 + x + 1) % 64 + 1] * 9617 + l[(y * 8 + x + 2) % 64 + 1] * 4899 + 8192) >> 14 AS g FROM {_PX}) GROUP BY 1""")
def pixel_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(spark, sf_dir, lambda img: _digest(im.gray(img), "gray"), "gray long, gray_at long", 3)


@query(f"""WITH px AS {_PX}, t AS (SELECT DISTINCT vec_id, p AS level FROM px),
 s AS (SELECT t.vec_id, level, count(*) FILTER (p <= level)::DOUBLE AS below, coalesce(sum(p) FILTER (p <= level), 0)::DOUBLE AS mass, sum(p)::DOUBLE AS total FROM t JOIN px ON px.vec_id = t.vec_id GROUP BY 1, 2),
 o AS (SELECT vec_id, level FROM s WHERE below < 64 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY (total * below - 64 * mass) * (total * below - 64 * mass) / (below * (64 - below)) DESC, level) = 1),
 r AS (SELECT vec_id, y, count(*) FILTER (p < 128) AS ink FROM px GROUP BY 1, 2)
 SELECT o.vec_id, o.level::INT AS level, (SELECT count(*) FROM px WHERE px.vec_id = o.vec_id AND p > o.level)::INT AS paper, round((SELECT var_pop(ink) FROM r WHERE r.vec_id = o.vec_id), 6) AS variance FROM o""")
def pixel_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's level, the paper above it, and the variance of ink by row."""
    kernel = lambda img: {"level": im.otsu(img), "paper": int((im.above_otsu(img) == im.PAPER).sum()), "variance": im.row_variance(img)}
    return _each(spark, sf_dir, kernel, "level int, paper int, variance double").withColumn("variance", F.round("variance", 6))


_DX = " + ".join(f"{w} * ({_at(f'y + {k}', 'x + 1')} - {_at(f'y + {k}', 'x - 1')})" for k, w in ((-1, 1), (0, 2), (1, 1)))
_DY = " + ".join(f"{w} * ({_at('y + 1', f'x + {k}')} - {_at('y - 1', f'x + {k}')})" for k, w in ((-1, 1), (0, 2), (1, 1)))


@query(f"""SELECT vec_id, {_DIGEST.format('dx', 'dx')}, {_DIGEST.format('dy', 'dy')}, sum(abs(dx) + abs(dy))::BIGINT AS edges FROM (SELECT vec_id, y, x, {_DX} AS dx, {_DY} AS dy FROM {_PX}) GROUP BY 1""")
def pixel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(img):
        dx, dy = im.sobel(img)
        return {**_digest(dx, "dx"), **_digest(dy, "dy"), "edges": int(np.abs(dx).sum() + np.abs(dy).sum())}

    return _each(spark, sf_dir, kernel, "dx long, dx_at long, dy long, dy_at long, edges long")


@query(f"""SELECT vec_id, (y // 2 * 4 + x // 2)::INT AS cell, round(avg(p), 6) AS mean, round(avg((p < 128)::INT), 6) AS ink FROM {_PX} GROUP BY 1, 2""")
def pixel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and ink of a grid of cells."""
    kernel = lambda img: [{"cell": k, "mean": float(a), "ink": float(b)} for k, (a, b) in enumerate(zip(ft.cells(img, 4, 4), ft.cells(img < 128, 4, 4), strict=True))]
    return _each(spark, sf_dir, kernel, "cell int, mean double, ink double").select("vec_id", "cell", F.round("mean", 6).alias("mean"), F.round("ink", 6).alias("ink"))


@query(f"""WITH lines AS (SELECT vec_id, 0 AS side, y AS k, count(*) FILTER (p < 128) AS ink FROM {_PX} GROUP BY ALL UNION ALL SELECT vec_id, 1, x, count(*) FILTER (p < 128) FROM {_PX} GROUP BY ALL)
 SELECT vec_id, (side * 8 + k)::INT AS k, round(ink / (max(ink) OVER (PARTITION BY vec_id, side) + 1e-8), 4) AS share FROM lines""")
def pixel_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = lambda img: [{"k": k, "share": float(v)} for k, v in enumerate(ft.profiles(img, 8))]
    return _each(spark, sf_dir, kernel, "k int, share double").withColumn("share", F.round("share", 4))


@query(f"""WITH RECURSIVE ink AS (SELECT vec_id, y, x, y * 8 + x AS i FROM {_PX} WHERE p < 100),
 near AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM ink a JOIN ink b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
 reach(vec_id, a, b) AS (SELECT * FROM near UNION SELECT r.vec_id, r.a, n.b FROM reach r JOIN near n ON n.vec_id = r.vec_id AND n.a = r.b),
 root AS (SELECT vec_id, a, min(b) AS r FROM reach GROUP BY 1, 2)
 SELECT i.vec_id, min(x)::INT AS x, min(y)::INT AS y, (max(x) - min(x) + 1)::INT AS w, (max(y) - min(y) + 1)::INT AS h, count(*)::INT AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy
 FROM ink i JOIN root ON root.vec_id = i.vec_id AND root.a = i.i GROUP BY i.vec_id, r""")
def pixel_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components with their boxes, areas and centres."""

    def kernel(img):
        parts = im.Components(img < 100)
        return [{c: getattr(parts, c)[k].item() for c in ("x", "y", "w", "h", "area", "cx", "cy")} for k in range(parts.n)]

    found = _each(spark, sf_dir, kernel, "x int, y int, w int, h int, area int, cx double, cy double")
    return found.withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


_ROW, _SQUARE = "OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", "OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(f"""SELECT vec_id, {_DIGEST.format('thin', 'eroded')}, {_DIGEST.format('thick', 'dilated')}, {_DIGEST.format('shut', 'closed')} FROM (
  SELECT *, min(wide) {_ROW} AS shut, min(narrow) {_SQUARE} AS thin, max(wide) {_SQUARE} AS thick FROM (SELECT *, max(p) {_ROW} AS wide, min(p) {_ROW} AS narrow FROM {_PX})) GROUP BY 1""")
def pixel_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Erosion and dilation by a square, closing along the rows."""
    square, row = im.box_kernel(3, 3), im.box_kernel(1, 3)
    kernel = lambda img: {**_digest(im.erode(img, square), "eroded"), **_digest(im.dilate(img, square), "dilated"), **_digest(im.closed(img, row), "closed")}
    return _each(spark, sf_dir, kernel, "eroded long, eroded_at long, dilated long, dilated_at long, closed long, closed_at long")


_AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
_MEAN = "(" + " + ".join(_at(f"y + {a}", f"x + {b}") for a, b in _AROUND) + ") / 9.0::DOUBLE"
_SQUARES = "(" + " + ".join(f"{_at(f'y + {a}', f'x + {b}')} * {_at(f'y + {a}', f'x + {b}')}" for a, b in _AROUND) + ") / 9.0::DOUBLE"


@query(f"""SELECT vec_id, round(sum(m * (1 + 0.2::DOUBLE * (sqrt(greatest(s - m * m, 0)) / 127.5::DOUBLE - 1))), 4) AS levels FROM (SELECT vec_id, {_MEAN} AS m, {_SQUARES} AS s FROM {_PX}) GROUP BY 1""")
def pixel_sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of the local thresholds."""
    return _each(spark, sf_dir, lambda img: {"levels": float(im.sauvola(img, 3, 0.2).sum())}, "levels double").withColumn("levels", F.round("levels", 4))


@query(f"""WITH px AS {_PX}, half AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, round_even(avg(p), 0)::BIGINT AS p FROM px GROUP BY ALL),
 small AS (SELECT vec_id, sum(p)::BIGINT AS small, sum(p * (y * 4 + x + 1))::BIGINT AS small_at FROM half GROUP BY 1),
 paper AS (SELECT vec_id, avg((p >= 128)::INT) < 0.5 AS dark FROM px GROUP BY 1),
 ink AS (SELECT vec_id, max(y) + 3 AS y2, greatest(0, min(y) - 2) AS y1, max(x) + 3 AS x2, greatest(0, min(x) - 2) AS x1 FROM px WHERE p < 60 GROUP BY 1)
 SELECT s.*, (CASE WHEN dark THEN 64 - n ELSE n END)::INT AS paper, coalesce(least(8, y2) - y1, 8)::INT AS tight_h, coalesce(least(8, x2) - x1, 8)::INT AS tight_w
 FROM small s JOIN paper USING (vec_id) JOIN (SELECT vec_id, count(*) FILTER (p >= 128) AS n FROM px GROUP BY 1) USING (vec_id) LEFT JOIN ink USING (vec_id)""")
def pixel_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the size by areas, paper made white, cropped to the ink."""

    def kernel(img):
        binary = np.where(img >= 128, im.PAPER, im.INK).astype(np.uint8)
        h, w = images.tight(img, 60).shape
        return {**_digest(im.resize(img, 4, 4, "area"), "small"), "paper": int((pages.dark_ink(binary) == 255).sum()), "tight_h": h, "tight_w": w}

    return _each(spark, sf_dir, kernel, "small long, small_at long, paper int, tight_h int, tight_w int")

"""Boxes, intervals and points grouped by a key: joins, windows and small folds.

All windows and joins are partitioned by the caller's key (an image, a line),
so no operator here sees more than one key's rows together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes as bx
from .folds import folded

#: Whole numbers below it, and differences of two, are exact as doubles.
EXACT = 2.0**52


def iou_join(a: DataFrame, b: DataFrame, key: str, threshold: float, cell: int = 64, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs of boxes of one key with IoU of at least ``threshold`` (> 0). Boxes
    are filed under the grid cells they touch and joined on (key, cell); a pair
    counts in the first cell that both touch."""

    def filed(frame: DataFrame, name: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{name}.{lo}") / cell), F.floor(F.col(f"{name}.{hi}") / cell))
        return frame.withColumn(f"_{name}x", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2"))).withColumnRenamed(f"_{name}x", "_cx")

    both = filed(a, left).join(filed(b, right), [key, "_cx", "_cy"])
    first = (F.col("_cx") == F.floor(F.greatest(F.col(f"{left}.x1"), F.col(f"{right}.x1")) / cell)) & (F.col("_cy") == F.floor(F.greatest(F.col(f"{left}.y1"), F.col(f"{right}.y1")) / cell))
    return both.where(first).withColumn("iou", bx.iou(F.col(left), F.col(right))).where(F.col("iou") >= threshold).drop("_cx", "_cy")


def not_overlapping(a: DataFrame, b: DataFrame, key: str, id_col: str, most: float = 0.3) -> DataFrame:
    """Rows of ``a`` whose box has an IoU over ``most`` with no box of ``b`` of the same key."""
    hit = iou_join(a.select(key, id_col, F.col("box").alias("a")), b.select(key, F.col("box").alias("b")), key, 1e-12).where(F.col("iou") > most)
    return a.join(hit.select(key, id_col).distinct(), [key, id_col], "left_anti")


def suppress(rows: DataFrame, key: str, threshold: float, score: str = "score", box: str = "box", id_col: str = "id") -> DataFrame:
    """Greedy non-maximum suppression within each key; of equal scores the later id first."""
    item = F.struct(F.col(score).alias("score"), F.col(id_col).alias("id"), F.col(box).alias("box"))
    kept = rows.groupBy(key).agg(bx.suppress(F.collect_list(item), threshold).alias("kept"))
    return kept.select(key, F.explode("kept").alias("k")).select(key, F.col("k.id").alias(id_col), F.col("k.score").alias(score), F.col("k.box").alias(box))


def union_box(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def runs(rows: DataFrame, key: str, at: str, on: Column) -> DataFrame:
    """Half-open runs ``start, end`` of neighbouring positions where ``on`` holds."""
    order = Window.partitionBy(key).orderBy(at)
    flagged = rows.withColumn("_on", on).where("_on").withColumn("_new", (F.col(at) - F.lag(at).over(order)).isNull() | (F.col(at) - F.lag(at).over(order) > 1))
    grouped = flagged.withColumn("_run", F.sum(F.col("_new").cast("int")).over(order))
    return grouped.groupBy(key, "_run").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("end")).drop("_run")


def merge_intervals(rows: DataFrame, key: str, gap: Column | float, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals joined while the next begins within ``gap`` of the largest end so far."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(end).over(before)
    gap = gap if isinstance(gap, Column) else F.lit(gap)
    grouped = rows.withColumn("_new", top.isNull() | (F.col(start) - top > gap)).withColumn("_g", F.sum(F.col("_new").cast("int")).over(order))
    return grouped.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members")).drop("_g")


def complement(rows: DataFrame, key: str, total: Column, start: str = "start", end: str = "end") -> DataFrame:
    """What disjoint intervals leave free of [0, total): the parts between them, before and after."""
    order = Window.partitionBy(key).orderBy(start)
    spans = rows.select(key, F.coalesce(F.lag(end).over(order), F.lit(0)).alias("s"), F.col(start).alias("e"))
    last = rows.groupBy(key).agg(F.max(end).alias("s"), F.first(total).alias("e"))
    return spans.unionByName(last).where("e > s").select(key, F.col("s").alias(start), F.col("e").alias(end))


def gap_threshold(gaps: Column, height: Column, scale: float = 0.75) -> Column:
    """Word gap from the positive gaps (a sorted array) of a line: between the
    means below and above the median, with fallbacks for few gaps."""
    n = F.size(gaps)
    half = F.floor(n / 2).cast("int")
    median = F.when(n % 2 == 1, F.try_element_at(gaps, half + 1)).otherwise((F.try_element_at(gaps, half) + F.try_element_at(gaps, half + 1)) / 2)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    small, large = F.filter(gaps, lambda g: g <= median), F.filter(gaps, lambda g: g > median)
    between = F.greatest((mean(small) + mean(large)) / 2, height * 0.3)
    return F.when(gaps.isNull() | (n == 0), height * scale).when(n < 4, F.array_max(gaps) * 0.75).when(F.size(large) == 0, median * 2.0).otherwise(between)


def word_gaps(blobs: DataFrame, key: str, height: Column, scale: float = 0.75) -> DataFrame:
    """``key, threshold`` of each line of blobs (x1, x2)."""
    order = Window.partitionBy(key).orderBy("x1", "x2")
    gap = F.col("x1") - F.lag("x2").over(order)
    sizes = blobs.withColumn("_gap", gap).withColumn("_h", height).groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("_gap") > 0, F.col("_gap").cast("double")))).alias("gaps"), F.first("_h").alias("_h"))
    return sizes.select(key, gap_threshold(F.col("gaps"), F.col("_h"), scale).alias("threshold"))


def group_words(blobs: DataFrame, key: str, threshold: str) -> DataFrame:
    """Blobs in x order; a gap to the one before of over ``threshold`` begins a word; union boxes."""
    order = Window.partitionBy(key).orderBy("x1", "x2", "y1", "y2")
    new = (F.col("x1") - F.lag("x2").over(order) > F.col(threshold)).cast("int")
    numbered = blobs.withColumn("word_idx", F.sum(F.coalesce(new, F.lit(0))).over(order).cast("int"))
    return union_box(numbered, key, "word_idx")


def group_lines(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """``line_idx``: rows sorted by ``at``; one that lies ``gap`` or more beyond the one before begins a line."""
    order = Window.partitionBy(key).orderBy(at)
    return rows.withColumn("line_idx", F.coalesce(F.sum((F.col(at) - F.lag(at).over(order) >= gap).cast("int")).over(order), F.lit(0)).cast("int"))


def nearest(points: DataFrame, peaks: DataFrame, key: str, id_col: str, at: str, peak: str, most: float) -> DataFrame:
    """``points`` with ``nearest``, the closest peak of the key within ``most`` (the
    lower of two), null for orphans: the peaks before and after each point in order."""
    ids = points.schema[id_col].dataType
    marks = peaks.select(key, F.lit(None).cast(ids).alias(id_col), F.col(peak).cast("double").alias("_at"), F.col(peak).alias("_peak"), F.lit(False).alias("_point"))
    both = marks.unionByName(points.select(key, id_col, F.col(at).cast("double").alias("_at"), F.lit(None).cast(marks.schema["_peak"].dataType).alias("_peak"), F.lit(True).alias("_point")))
    mine, so_far = Window.partitionBy(key), (Window.unboundedPreceding, 0)
    both = both.withColumn("_low", F.last("_peak", True).over(mine.orderBy("_at", "_point").rowsBetween(*so_far)))
    both = both.withColumn("_high", F.last("_peak", True).over(mine.orderBy(F.desc("_at"), "_point").rowsBetween(*so_far)))
    down, up = F.col("_at") - F.col("_low"), F.col("_high") - F.col("_at")
    best = F.when(F.col("_low").isNull() | (up < down), F.col("_high")).otherwise(F.col("_low"))
    found = both.where("_point").select(key, id_col, F.when(F.abs(F.col("_at") - best) <= most, best).alias("nearest")).distinct()
    return points.join(found, [key, id_col])


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, the smallest of equal ones."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("mode"))


def character_height(rows: DataFrame, key: str, share: float = 0.5, least_area: int = 0, default: float = 20.0) -> DataFrame:
    """Percentile of the components' heights, ``default`` without any over ``least_area``."""
    return rows.groupBy(key).agg(F.coalesce(F.percentile(F.when(F.col("area") > least_area, F.col("height")), share), F.lit(default)).alias("height"))


def position_tag(index: Column, count: Column) -> Column:
    return F.when(count == 1, "isolated").when(index == 0, "initial").when(index == count - 1, "final").otherwise("medial")


def with_positions(chars: DataFrame, keys: list[str], order: str) -> DataFrame:
    mine = Window.partitionBy(*keys)
    return chars.withColumn("position", position_tag(F.row_number().over(mine.orderBy(order)) - 1, F.count("*").over(mine)))


def cap_per_key(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key: a limit that is the feature."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def first_then_large(proposals: DataFrame, key: str, order: str, most: int = 500, least: int = 48) -> DataFrame:
    """The first ``most`` proposals, and only then those of ``least`` pixels a side."""
    return cap_per_key(proposals, [key], [order], most).where((F.col("box.x2") - F.col("box.x1") >= least) & (F.col("box.y2") - F.col("box.y1") >= least))


def valid_word(w: Column, h: Column, area: Column, median: Column) -> Column:
    """Word rules; ``area`` is the box's own, so the fill rule holds for all."""
    aspect, relative = w / (h + 1e-5), h / (median + 1e-5)
    return (area > 100) & (h > 8) & (aspect > 0.1) & (aspect < 20) & (relative > 0.4) & (relative < 1.6) & (area / (w * h + 1e-5) > 0.08)


def valid_character(w: Column, h: Column, height: Column) -> Column:
    return (w > 0) & (h > 0) & (h > 0.3 * height) & (h < 4.5 * height) & (w * h > 0.05 * height * height) & (w > 0.1 * height) & (w < 1.8 * height)


def sampled_frames(total: Column, n: int) -> Column:
    """n frame numbers evenly over 0 .. total - 1, truncated; 0 alone for one."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * (total - 1) / max(n - 1, 1)).cast("int"))


def line_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least squares line of each key; null for points of one x. Of whole numbers
    the sums are exact and divided once, so the order of the rows changes
    nothing; others, or sums beyond EXACT, go by running moments."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x).cast("double")), F.when(F.col(x).isNotNull(), F.col(y).cast("double"))
    sums = {"_n": F.count(a).cast("double"), "_x": F.sum(a), "_y": F.sum(b), "_xx": F.sum(a * a), "_xy": F.sum(a * b), "_yy": F.sum(b * b), "_whole": F.bool_and((a == F.rint(a)) & (b == F.rint(b)))}
    moments = points.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), *[c.alias(n) for n, c in sums.items()])
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in ("_n", "_x", "_y", "_xx", "_xy", "_yy"))
    exact = F.col("_whole") & (F.greatest(n * sxx, n * syy, F.abs(sy * sxx), F.abs(sx * sxy)) < EXACT)
    under = n * sxx - sx * sx
    fit = lambda over, rough: F.when(exact & (under > 0), over / under).otherwise(F.col(rough)).alias(rough)
    return moments.select(key, fit(n * sxy - sx * sy, "slope"), fit(sy * sxx - sx * sxy, "intercept"))


def assemble_text(words: DataFrame, page: list[str], line: str, x: str, text: str) -> DataFrame:
    """Words by (x, text) into lines, lines in order into texts."""
    lines = words.groupBy(*page, line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(x, text))), lambda s: s[text]), " ").alias("_t"))
    return lines.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, "_t"))), lambda s: s["_t"]), "\n").alias("text"))


def confident_text(words: DataFrame, page: list[str], line: str, x: str, text: str, score: str, least: float = 0.7) -> DataFrame:
    """The text of recognised crops: empty and unsure ones are left out."""
    return assemble_text(words.where((F.col(text) != "") & (F.col(score) >= least)), page, line, x, text)


def region_line_numbers(cy: list[float], height: list[float], share: float) -> list[int]:
    """Line number of each region in centre order: a region joins the line if it
    is near the mean centre of the line so far."""
    reach = sum(height) / max(len(height), 1) * share
    line, total, n, out = 0, 0.0, 0, []
    for c in cy:
        if n and abs(c - total / n) > reach:
            line, total, n = line + 1, 0.0, 0
        total, n = total + c, n + 1
        out.append(line)
    return out


def region_lines(regions: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """``key, region, cx, line_idx`` for regions with a polygon: one image's regions are folded together."""
    xs, ys = F.transform("polygon", lambda p: p["x"].cast("double")), F.transform("polygon", lambda p: p["y"].cast("double"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    flat = regions.select(key, "region", mean(xs).alias("cx"), mean(ys).alias("cy"), (F.array_max(ys) - F.array_min(ys)).alias("height"))

    def fold(rows: list[dict]) -> list[dict]:
        lines = region_line_numbers([r["cy"] for r in rows], [r["height"] for r in rows], share)
        return [{key: r[key], "region": r["region"], "cx": r["cx"], "line_idx": n} for r, n in zip(rows, lines, strict=True)]

    types = dict(regions.dtypes)
    return folded(flat, [key], ["cy", "region"], fold, f"`{key}` {types[key]}, region {types['region']}, cx double, line_idx int")


def region_text(regions: DataFrame, key: str, share: float = 0.6) -> DataFrame:
    """Texts of regions joined by lines: ``key, text``; empty texts are left out."""
    placed = region_lines(regions, key, share).join(regions.select(key, "region", "text"), [key, "region"]).where("text != ''")
    return assemble_text(placed, [key], "line_idx", "cx", "text")


def clusters(points: np.ndarray, reach: float) -> np.ndarray:
    """Smallest member of each point's cluster."""
    near = np.hypot(points[:, None, 0] - points[None, :, 0], points[:, None, 1] - points[None, :, 1]) <= reach
    root = np.arange(len(points))
    while True:
        after = np.where(near, root[None, :], len(points)).min(1)
        if (after == root).all():
            return root
        root = after


def cluster_dots(points: DataFrame, key: str, reach: float, baseline: Column) -> DataFrame:
    """Points (cx, cy) of one key that hang together within ``reach``: mean
    centre, size, and above or below the baseline. One sub-word's dots are few."""
    flat = points.select(key, F.col("cx").cast("double"), F.col("cy").cast("double"), baseline.cast("double").alias("base"))

    def fold(rows: list[dict]) -> list[dict]:
        at = np.array([(r["cx"], r["cy"]) for r in rows])
        root, out = clusters(at, reach), []
        for r in np.unique(root):
            cx, cy = at[root == r].mean(0)
            out.append({key: rows[0][key], "cx": float(cx), "cy": float(cy), "cluster_size": int((root == r).sum()), "position": "above" if cy < rows[r]["base"] else "below"})
        return out

    return folded(flat, [key], ["cx", "cy"], fold, f"`{key}` {dict(points.dtypes)[key]}, cx double, cy double, cluster_size int, position string")


def dot_features(dots: Column) -> Column:
    """Dots above, below, any, and the spread of their centres, from an array of dots."""
    count = lambda where: F.aggregate(F.filter(dots, lambda d: d["position"] == where), F.lit(0.0), lambda s, d: s + d["cluster_size"])
    xs = F.transform(dots, lambda d: d["cx"])
    n = F.size(xs)
    mean = F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    zero = F.array(*[F.lit(0.0)] * 4)
    return F.when(dots.isNull() | (n == 0), zero).otherwise(F.array(count("above"), count("below"), F.lit(1.0), F.when(n > 1, spread).otherwise(0.0)))

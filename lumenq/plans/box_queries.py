"""Boxes, intervals, points and colours, on integer boxes derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes as bx
from ..functions import color
from ..operators import geometry as geo
from ..sources.tables import read_yolo, table
from .registry import query

_BOXES = """(SELECT l_orderkey AS img, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 97)::DOUBLE AS x1, (l_suppkey % 7 * 5)::DOUBLE AS y1,
 (l_partkey % 97 + 10 + l_quantity::INT % 30)::DOUBLE AS x2, (l_suppkey % 7 * 5 + 8 + l_linenumber * 2)::DOUBLE AS y2, floor(l_extendedprice) / 100000 AS score, l_linenumber AS n
 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"""
_IW = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0)"
_IH = "greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_IOU = f"({_IW} * {_IH}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IW} * {_IH})"
_SMALL = f"({_IW} * {_IH}) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey") % 7 * 5
    return rows.select(
        F.col("l_orderkey").alias("img"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 10 + F.bround("l_quantity").cast("int") % 30).cast("double").alias("x2"), (y + 8 + F.col("l_linenumber") * 2).cast("double").alias("y2"),
        (F.floor("l_extendedprice") / 100000).alias("score"), F.col("l_linenumber").alias("n"),
    )


def _structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).withColumn("box", bx.box(*[F.col(c) for c in bx.CORNERS]))


@query(f"""SELECT a.img, a.id AS a_id, b.id AS b_id, round({_IOU}, 9) AS iou FROM {_BOXES} a JOIN {_BOXES} b ON a.img = b.img AND a.id < b.id WHERE {_IOU} >= 0.1""")
def iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _structs(spark, sf_dir)
    a, b = rows.select("img", F.col("id").alias("a_id"), F.col("box").alias("a")), rows.select("img", F.col("id").alias("b_id"), F.col("box").alias("b"))
    return geo.iou_join(a, b, "img", 0.1).where("a_id < b_id").select("img", "a_id", "b_id", F.round("iou", 9).alias("iou"))


@query(f"""SELECT a.img, a.id AS a_id, b.id AS b_id, round({_SMALL}, 9) AS share FROM {_BOXES} a JOIN {_BOXES} b ON a.img = b.img AND a.n = b.n - 1""")
def overlap_of_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _structs(spark, sf_dir)
    a = rows.select("img", F.col("id").alias("a_id"), "n", F.col("box").alias("a"))
    b = rows.select("img", F.col("id").alias("b_id"), (F.col("n") - 1).alias("n"), F.col("box").alias("b"))
    return a.join(b, ["img", "n"]).select("img", "a_id", "b_id", F.round(bx.overlap_of_smaller(F.col("a"), F.col("b")), 9).alias("share"))


@query(f"""SELECT id FROM {_BOXES} a WHERE n > 2 AND NOT EXISTS (SELECT 1 FROM {_BOXES} b WHERE b.img = a.img AND b.n <= 2 AND {_IOU} > 0.3)""")
def overlap_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _structs(spark, sf_dir)
    return geo.not_overlapping(rows.where("n > 2"), rows.where("n <= 2"), "img", "id").select("id")


@query(f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY score DESC, id DESC) AS k, count(*) OVER (PARTITION BY img) AS m FROM {_BOXES}),
 walk AS (SELECT img, 1 AS k, m, [struct_pack(id := id, score := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM r WHERE k = 1
  UNION ALL SELECT w.img, w.k + 1, w.m, CASE WHEN len(list_filter(w.kept, lambda b: {_IOU} >= 0.3)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(id := a.id, score := a.score, x1 := a.x1, y1 := a.y1, x2 := a.x2, y2 := a.y2)) END
  FROM walk w JOIN r a ON a.img = w.img AND a.k = w.k + 1)
 SELECT img, s.id AS id, s.score AS score FROM (SELECT img, unnest(kept) AS s FROM walk WHERE k = m)""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.suppress(_structs(spark, sf_dir), "img", 0.3).select("img", "id", "score")


@query(f"SELECT img, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {_BOXES} GROUP BY img")
def union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.union_box(_boxes(spark, sf_dir), "img")


@query(f"""SELECT id, greatest(0, least(1, (x1 + x2) / 2 / 120)) AS cx, greatest(0, least(1, (y1 + y2) / 2 / 40)) AS cy, greatest(0, least(1, (x2 - x1) / 120)) AS w, greatest(0, least(1, (y2 - y1) / 40)) AS h,
 greatest(x1 - greatest(1, floor((x2 - x1) * 0.2 / 2)), 0) AS px1, greatest(y1 - greatest(1, floor((y2 - y1) * 0.2)), 0) AS py1, least(x2 + greatest(1, floor((x2 - x1) * 0.2 / 2)), 120) AS px2, least(y2 + greatest(1, floor((y2 - y1) * 0.2)), 40) AS py2 FROM {_BOXES}""")
def box_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    box, wide, high = F.col("box"), F.lit(120.0), F.lit(40.0)
    rows = _structs(spark, sf_dir).select("id", bx.to_centre(box, wide, high).alias("c"), bx.pad(box, wide, high).alias("p"))
    return rows.select("id", *[F.col(f"c.{k}").alias(k) for k in ("cx", "cy", "w", "h")], *[F.col(f"p.{k}").cast("double").alias(f"p{k}") for k in bx.CORNERS])


@query(f"""SELECT img, word_idx, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM (
 SELECT *, coalesce(sum(new) OVER (PARTITION BY img ORDER BY x1, x2, y1, y2 ROWS UNBOUNDED PRECEDING), 0)::INT AS word_idx FROM (
 SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY img ORDER BY x1, x2, y1, y2) > 6 THEN 1 ELSE 0 END AS new FROM {_BOXES})) GROUP BY 1, 2""")
def word_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.group_words(_boxes(spark, sf_dir).withColumn("threshold", F.lit(6.0)), "img", "threshold")


@query(f"""WITH g AS (SELECT img, x1 - lag(x2) OVER (PARTITION BY img ORDER BY x1, x2) AS gap FROM {_BOXES}),
 p AS (SELECT img, list(gap ORDER BY gap) FILTER (gap > 0) AS gaps FROM g GROUP BY img), m AS (SELECT img, gaps, list_aggregate(gaps, 'median') AS med FROM p)
 SELECT img, round(CASE WHEN gaps IS NULL OR len(gaps) = 0 THEN 15.0 WHEN len(gaps) < 4 THEN list_max(gaps) * 0.75 WHEN len(list_filter(gaps, lambda v: v > med)) = 0 THEN med * 2
  ELSE greatest((list_avg(list_filter(gaps, lambda v: v <= med)) + list_avg(list_filter(gaps, lambda v: v > med))) / 2, 6.0) END, 9) AS threshold FROM m""")
def word_gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.word_gaps(_boxes(spark, sf_dir), "img", F.lit(20.0)).select("img", F.round("threshold", 9).alias("threshold"))


@query(f"""SELECT img, min(x1) AS x1, max(x2) AS x2, count(*) AS members FROM (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN x1 - max(x2) OVER (PARTITION BY img ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS new FROM {_BOXES})) GROUP BY img, g""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.merge_intervals(_boxes(spark, sf_dir), "img", 3.0, "x1", "x2")


@query(f"""WITH s AS (SELECT img, min(x1) AS a, max(x2) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY img ORDER BY x1, x2 ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN x1 - max(x2) OVER (PARTITION BY img ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM {_BOXES})) GROUP BY img, g)
 SELECT * FROM (SELECT img, coalesce(lag(b) OVER (PARTITION BY img ORDER BY a), 0)::DOUBLE AS x1, a AS x2 FROM s UNION ALL SELECT img, max(b), 140.0::DOUBLE FROM s GROUP BY img) WHERE x2 > x1""")
def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = geo.merge_intervals(_boxes(spark, sf_dir), "img", 0.0, "x1", "x2")
    return geo.complement(spans, "img", F.lit(140.0), "x1", "x2")


@query("""SELECT img, min(pos) AS "start", max(pos) + 1 AS "end" FROM (SELECT img, pos, pos - row_number() OVER (PARTITION BY img ORDER BY pos) AS g FROM (SELECT DISTINCT l_orderkey // 4 AS img, l_partkey % 60 AS pos FROM lineitem)) GROUP BY img, g""")
def nonzero_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4).cast("long").alias("img"), (F.col("l_partkey") % 60).alias("pos")).distinct()
    return geo.runs(marks, "img", "pos", F.lit(True))


@query(f"""SELECT img, id, coalesce(sum(new) OVER (PARTITION BY img ORDER BY cy ROWS UNBOUNDED PRECEDING), 0)::INT AS line_idx FROM (
 SELECT img, id, cy, CASE WHEN cy - lag(cy) OVER (PARTITION BY img ORDER BY cy) >= 4 THEN 1 ELSE 0 END AS new FROM (SELECT img, id, (y1 + y2) / 2 + id % 10 / 100.0::DOUBLE AS cy FROM {_BOXES}))""")
def line_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumn("cy", (F.col("y1") + F.col("y2")) / 2 + F.col("id") % 10 / 100.0)
    return geo.group_lines(rows, "img", "cy", 4.0).select("img", "id", "line_idx")


@query(f"""SELECT a.img, a.id, CASE WHEN abs(a.x1 - b.peak) <= 12 THEN b.peak END AS nearest FROM {_BOXES} a LEFT JOIN LATERAL (
 SELECT peak FROM (VALUES (5.0::DOUBLE), (30.0), (60.0)) v(peak) ORDER BY abs(a.x1 - peak), peak LIMIT 1) b ON true""")
def nearest_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select("img", "id", "x1")
    peaks = rows.select("img").distinct().withColumn("peak", F.explode(F.array(F.lit(5.0), F.lit(30.0), F.lit(60.0))))
    return geo.nearest(rows, peaks, "img", "id", "x1", "peak", 12.0).select("img", "id", "nearest")


@query(f"SELECT img, v AS mode FROM (SELECT img, y2 AS v, row_number() OVER (PARTITION BY img ORDER BY count(*) DESC, y2) AS k FROM {_BOXES} GROUP BY img, y2) WHERE k = 1")
def baseline_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.mode(_boxes(spark, sf_dir), "img", "y2")


@query(f"""SELECT img, round(coalesce(quantile_cont(y2 - y1, 0.5) FILTER ((x2 - x1) * (y2 - y1) > 200), 20.0), 9) AS median, round(quantile_cont(y2 - y1, 0.7), 9) AS p70, round(var_pop(x2 - x1), 6) AS spread FROM {_BOXES} GROUP BY img""")
def character_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumns({"height": F.col("y2") - F.col("y1"), "area": ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("int")})
    median = geo.character_height(rows, "img", 0.5, 200).withColumnRenamed("height", "median")
    rest = geo.character_height(rows, "img", 0.7).withColumnRenamed("height", "p70")
    spread = rows.groupBy("img").agg(F.round(F.var_pop(F.col("x2") - F.col("x1")), 6).alias("spread"))
    return median.join(rest, "img").join(spread, "img").select("img", F.round("median", 9).alias("median"), F.round("p70", 9).alias("p70"), "spread")


@query(f"""SELECT id, CASE WHEN c = 1 THEN 'isolated' WHEN k = 1 THEN 'initial' WHEN k = c THEN 'final' ELSE 'medial' END AS position FROM (
 SELECT id, row_number() OVER (PARTITION BY img ORDER BY id) AS k, count(*) OVER (PARTITION BY img) AS c FROM {_BOXES})""")
def position_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_positions(_boxes(spark, sf_dir), ["img"], "id").select("id", "position")


@query(f"SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY id) AS k FROM {_BOXES}) WHERE k <= 3 AND x2 - x1 >= 20 AND y2 - y1 >= 10")
def proposal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.first_then_large(_structs(spark, sf_dir), "img", "id", 3, 10).where("box.x2 - box.x1 >= 20").select("id")


@query("""SELECT l_returnflag AS label, l_orderkey * 10 + l_linenumber AS id FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5((l_orderkey * 10 + l_linenumber)::VARCHAR), l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k <= 50""")
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return geo.cap_per_key(rows, ["label"], [F.md5(F.col("id").cast("string")), "id"], 50)


@query(f"""SELECT img, id, score FROM {_BOXES} WHERE score >= 0.3 AND (x2 - x1) * (y2 - y1) > 100 AND y2 - y1 > 8""")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return _boxes(spark, sf_dir).where((F.col("score") >= 0.3) & (w * h > 100) & (h > 8)).select("img", "id", "score")


@query(f"""WITH b AS (SELECT *, quantile_cont(y2 - y1, 0.5) OVER (PARTITION BY img) AS med FROM {_BOXES})
 SELECT id, (x2 - x1) * (y2 - y1) > 100 AND y2 - y1 > 8 AND (x2 - x1) / (y2 - y1 + 1e-5) > 0.1 AND (x2 - x1) / (y2 - y1 + 1e-5) < 20 AND (y2 - y1) / (med + 1e-5) > 0.4 AND (y2 - y1) / (med + 1e-5) < 1.6 AS valid_word,
 y2 - y1 > 0.3 * med AND y2 - y1 < 4.5 * med AND (x2 - x1) * (y2 - y1) > 0.05 * med * med AND x2 - x1 > 0.1 * med AND x2 - x1 < 1.8 * med AS valid_char FROM b""")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    median = F.percentile(h, 0.5).over(Window.partitionBy("img"))
    rows = _boxes(spark, sf_dir).withColumn("median", median)
    return rows.select("id", geo.valid_word(w, h, w * h, F.col("median")).alias("valid_word"), geo.valid_character(w, h, F.col("median")).alias("valid_char"))


@query(f"SELECT img, round(regr_slope(y1, x1), 6) AS slope, round(regr_intercept(y1, x1), 6) AS intercept FROM {_BOXES} GROUP BY img HAVING count(DISTINCT x1) > 1")
def line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir)
    some = rows.groupBy("img").agg(F.countDistinct("x1").alias("k")).where("k > 1").select("img")
    return geo.line_fit(rows.join(some, "img", "left_semi"), "img", "x1", "y1").select("img", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"""SELECT img, string_agg(line, chr(10) ORDER BY y1) AS text FROM (SELECT img, y1, string_agg('w' || (id % 100), ' ' ORDER BY x1, 'w' || (id % 100)) AS line FROM {_BOXES} GROUP BY img, y1) GROUP BY img""")
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).withColumn("word", F.concat(F.lit("w"), (F.col("id") % 100).cast("string")))
    return geo.assemble_text(words, ["img"], "y1", "x1", "word")


@query("SELECT o_orderkey AS id, list_transform(range(0, 5), lambda i: floor(i * (o_custkey + 9) / 4)::INT) AS frames FROM orders")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.sampled_frames(F.col("o_custkey") + 10, 5).alias("frames"))


@query("""SELECT o_orderkey AS image_id, coalesce(list(l_partkey % 5 || ' ' || l_linenumber ORDER BY l_linenumber, l_partkey % 5) FILTER (l_partkey % 5 < 3), []) AS lines
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY o_orderkey""")
def annotations_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with their lines; crowds and unmapped classes go, images without any stay."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R' AND l_partkey % 5 < 3")
    line = F.concat_ws(" ", (F.col("l_partkey") % 5).cast("string"), F.col("l_linenumber").cast("string"))
    lines = rows.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), line.alias("line")))).alias("s"))
    out = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id")).join(lines, "image_id", "left")
    return out.select("image_id", F.coalesce(F.transform("s", lambda x: x["line"]), F.array().cast("array<string>")).alias("lines"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, p_brand AS class, o_orderstatus AS status FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 25 JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 32""")
def annotation_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of known classes and existing images; the optimizer broadcasts the small sides."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity >= 32")
    classes = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class"))
    pictures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return rows.join(classes, "l_partkey").join(pictures, "l_orderkey").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "class", "status")


@query("""SELECT l_orderkey AS id, (l_partkey % 80)::INT AS cls, l_discount AS cx, l_tax AS cy, l_quantity AS w, l_linenumber::DOUBLE AS h FROM lineitem WHERE l_linenumber <> 4""")
def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five fields are read, others (here those of item 4) dropped."""
    rows = table(spark, sf_dir, "lineitem")
    fields = [(F.col("l_partkey") % 80).cast("string"), *[F.col(c).cast("string") for c in ("l_discount", "l_tax", "l_quantity", "l_linenumber")]]
    line = F.concat_ws(" ", *fields, F.when(F.col("l_linenumber") == 4, F.lit("x")))
    return read_yolo(rows.select(F.col("l_orderkey").alias("id"), line.alias("line")))


@query("""SELECT w, d, (w - 0.3) * (w - 0.3) + d AS score FROM (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5)) a(w) CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5)) b(d)""")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(x / 10,) for x in (1, 2, 3, 4, 5)], "w double")
    boosts = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5)], "d double")
    grid = weights.crossJoin(boosts)  # a fixed grid of parameters
    return grid.withColumn("score", (F.col("w") - 0.3) * (F.col("w") - 0.3) + F.col("d")).orderBy("score", F.abs(F.col("w") - 0.3))


_LAB = "(SELECT vec_id, 40 + embedding[1]::DOUBLE * 600 AS l, 128 + embedding[2]::DOUBLE * 400 AS a, 128 + embedding[3]::DOUBLE * 400 AS b FROM embeddings)"


@query(f"""SELECT vec_id, round(c, 6) AS chroma, round(h, 6) AS hue, CASE WHEN c < 15 THEN CASE WHEN l > 210 THEN 'white' WHEN l < 50 THEN 'black' ELSE 'gray' END
 WHEN d < 83 AND c < 45 AND l < 145 THEN 'brown' WHEN d >= 340 OR d < 16 THEN CASE WHEN l >= 160 THEN 'pink' ELSE 'red' END WHEN d < 51 THEN 'red' WHEN d < 84 THEN 'orange' WHEN d < 119 THEN 'yellow'
 WHEN d < 220 THEN 'green' WHEN d < 315 THEN 'blue' ELSE 'purple' END AS name FROM (SELECT *, CASE WHEN degrees(h) < 0 THEN degrees(h) + 360 ELSE degrees(h) END AS d FROM (
 SELECT vec_id, l, sqrt((a - 128) * (a - 128) + (b - 128) * (b - 128)) AS c, atan2(b - 128, a - 128) AS h FROM {_LAB}))""")
def colour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (40 + e(0) * 600).alias("l"), (128 + e(1) * 400).alias("a"), (128 + e(2) * 400).alias("b"))
    light, a, b = F.col("l"), F.col("a"), F.col("b")
    return rows.select("vec_id", F.round(color.chroma(a, b), 6).alias("chroma"), F.round(color.hue(a, b), 6).alias("hue"), color.name_by_rules(light, a, b).alias("name"))


@query(f"""SELECT img, least(8, floor((x1) / 12.125) + 1)::INT AS bin, round(sum(score), 6) AS weight FROM {_BOXES} GROUP BY 1, 2""")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight bins over 0..97, the last one closed."""
    place = F.least(F.lit(8), F.floor(F.col("x1") / 12.125) + 1).cast("int")
    return _boxes(spark, sf_dir).groupBy("img", place.alias("bin")).agg(F.round(F.sum("score"), 6).alias("weight"))


@query(f"""WITH RECURSIVE o AS (SELECT img, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, avg(y2 - y1) OVER (PARTITION BY img) * 0.6 AS reach, 'w' || (id % 100) AS text, row_number() OVER (PARTITION BY img ORDER BY (y1 + y2) / 2, id) AS k FROM {_BOXES}),
 s(img, k, line, total, n, cx, text) AS (SELECT img, k, 0, cy, 1, cx, text FROM o WHERE k = 1
  UNION ALL SELECT o.img, o.k, CASE WHEN far THEN line + 1 ELSE line END, CASE WHEN far THEN cy ELSE total + cy END, CASE WHEN far THEN 1 ELSE n + 1 END, cx, text
  FROM (SELECT s.line, s.total, s.n, o.*, abs(o.cy - s.total / s.n) > o.reach AS far FROM s JOIN o ON o.img = s.img AND o.k = s.k + 1) o)
 SELECT img, string_agg(t, chr(10) ORDER BY line) AS text FROM (SELECT img, line, string_agg(text, ' ' ORDER BY cx, text) AS t FROM s GROUP BY 1, 2) GROUP BY 1""")
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with polygons, in the role of a detector's output, to lines and text."""
    rows = _boxes(spark, sf_dir)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    polygon = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"))
    regions = rows.select("img", F.col("id").alias("region"), polygon.alias("polygon"), F.concat(F.lit("w"), (F.col("id") % 100).cast("string")).alias("text"))
    return geo.region_text(regions, "img")


@query(f"""WITH RECURSIVE p AS (SELECT img, row_number() OVER () AS r, x1, y1 FROM {_BOXES}),
 near AS (SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON a.img = b.img AND (a.x1 - b.x1) * (a.x1 - b.x1) + (a.y1 - b.y1) * (a.y1 - b.y1) <= 100),
 reach(a, b) AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b)
 SELECT img, round(avg(x1), 6) AS cx, round(avg(y1), 6) AS cy, count(*)::INT AS cluster_size, CASE WHEN avg(y1) < 15 THEN 'above' ELSE 'below' END AS position
 FROM (SELECT p.*, (SELECT min(b) FROM reach WHERE a = p.r) AS root FROM p) GROUP BY img, root""")
def dot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _boxes(spark, sf_dir).select("img", F.col("x1").alias("cx"), F.col("y1").alias("cy"))
    out = geo.cluster_dots(points, "img", 10.0, F.lit(15.0))
    return out.select("img", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "cluster_size", "position")


_FEATS = f"""SELECT img, sum(n) FILTER (y1 < 15)::DOUBLE AS above, sum(n) FILTER (y1 >= 15)::DOUBLE AS below, round(CASE WHEN count(*) > 1 THEN stddev_pop(x1) ELSE 0 END, 6) AS spread FROM {_BOXES} GROUP BY img"""


@query(f"SELECT img, coalesce(above, 0) AS above, coalesce(below, 0) AS below, spread FROM ({_FEATS})")
def dot_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    dot = F.struct(F.col("x1").alias("cx"), F.col("n").alias("cluster_size"), F.when(F.col("y1") < 15, "above").otherwise("below").alias("position"))
    rows = _boxes(spark, sf_dir).groupBy("img").agg(F.sort_array(F.collect_list(dot)).alias("dots"))
    f = geo.dot_features(F.col("dots"))
    return rows.select("img", f[0].alias("above"), f[1].alias("below"), F.round(f[3], 6).alias("spread"))


@query("""SELECT c AS command, CASE WHEN n = 0 THEN 'Empty image file' WHEN c NOT IN ('كشف', 'نص', 'لون', 'نصا', 'نصعر') THEN 'الأمر ''' || c || ''' غير معروف. الأوامر المتاحة: كشف، نص، لون، نصا، نصعر' END AS error
 FROM (VALUES ('كشف', 3), ('نص', 0), ('xyz', 5), ('لون', 1)) v(c, n)""")
def request_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import requests

    rows = spark.createDataFrame([("كشف", b"abc"), ("نص", b""), ("xyz", b"hello"), ("لون", b"1")], "command string, content binary")
    known = F.array(*[F.lit(c) for c in ("كشف", "نص", "لون", "نصا", "نصعر")])
    return requests(rows, known).select("command", "error")

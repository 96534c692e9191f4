"""Sources, streams, functions and geometry that no oracle query covers."""

import itertools
import json
import random

import numpy as np
from pyspark.sql import functions as F

from lumenq.functions import arabic, boxes, color, text
from lumenq.operators import geometry, images, language_model, metrics, ml
from lumenq.plans import pipelines
from lumenq.sources import tables
from lumenq.streaming import files


def test_images_through_png(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 256, (12, 9, 3)).astype(np.uint8)
    (tmp_path / "red").mkdir()
    (tmp_path / "red/a.png").write_bytes(tables.png(px))
    (tmp_path / "red/bad.png").write_bytes(b"not an image")
    got = {r.path.rsplit("/", 1)[1]: r for r in tables.images(spark, str(tmp_path / "red"), "*.png").collect()}
    assert bytes(got["a.png"].px) == px.tobytes() and (got["a.png"].h, got["a.png"].w) == (12, 9) and got["bad.png"].px is None
    names = tables.labelled_folders(tables.listing(spark, str(tmp_path), "*.png"), {"red": "rot"}).collect()
    assert {r.label for r in names} == {"rot"} and {r.name for r in names} == {"a.png", "bad.png"}
    (tmp_path / "labels.csv").write_text("image_path,label\nred/a.png,red\nred/none.png,blue\n")
    good, failed = tables.labelled_csv(spark, str(tmp_path / "labels.csv"), str(tmp_path / "red"))
    assert [r.label for r in good.collect()] == ["red"] and [r.label for r in failed.collect()] == ["blue"]
    shown = pipelines.colour_names(tables.images(spark, str(tmp_path / "red")), "path").collect()
    assert sorted(r.error is None for r in shown) == [False, True]


def test_corpora(spark, tmp_path):
    (tmp_path / "dump.xml").write_text("<page>\nno كلمة\n<text x='1'>نص أول\n{{قالب}}\n| جدول\nسطر ثان</text>\nخارج\n</page>", encoding="utf-8")
    assert {r.word for r in tables.dump_tokens(spark, str(tmp_path / "dump.xml")).collect()} == {"نص", "أول", "سطر", "ثان"}
    paged = tables.dump_tokens(spark, str(tmp_path / "dump.xml"), row_tag="page")
    assert "ثان" in {r.word for r in paged.collect()}
    assert tables.plain_tokens(spark, str(tmp_path / "dump.xml")).count() == 8
    book = spark.createDataFrame([("head\r\n*** START OF X ***\r\nbody one\r\ntwo\r\n*** END OF X ***\r\ntail",)], "t string")
    assert book.select(text.body_between(F.col("t"), r"\*\*\* START", r"\*\*\* END")).first()[0] == "body one\ntwo"


def test_coco_to_yolo_and_back(spark, tmp_path):
    coco = {
        "categories": [{"id": 7, "name": "chair"}, {"id": 9, "name": "other"}], "images": [{"id": 1, "file_name": "a", "width": 100, "height": 50}, {"id": 2, "file_name": "b", "width": 10, "height": 10}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 10], "iscrowd": 0}, {"id": 2, "image_id": 1, "category_id": 7, "bbox": [0, 0, 1, 1], "iscrowd": 1}, {"id": 3, "image_id": 1, "category_id": 9, "bbox": [0, 0, 1, 1], "iscrowd": 0}, {"id": 4, "image_id": 1, "category_id": 7, "bbox": [90, 40, 40, 40], "iscrowd": 0}],
    }
    (tmp_path / "c.json").write_text(json.dumps(coco))
    got = {r.image_id: r.lines for r in tables.yolo_lines(*tables.coco(spark, str(tmp_path / "c.json")), {"chair": 0}).collect()}
    assert got == {1: ["0 0.200000 0.300000 0.200000 0.200000", "0 1.000000 1.000000 0.400000 0.800000"], 2: []}
    back = tables.read_yolo(spark.createDataFrame([(x,) for x in [*got[1], "1 2 3"]], "line string")).collect()
    assert [(r.cls, r.w) for r in back] == [(0, 0.2), (0, 0.4)]
    flat = tables.batch_labels(spark.createDataFrame([("b", [1, 2]), ("a", []), ("c", [3])], "k string, l array<int>"), "k", "l")
    assert {(r.batch_idx, r.label) for r in flat.collect()} == {(1, 1), (1, 2), (2, 3)}


def test_sinks_names_and_requests(spark, tmp_path):
    rows = spark.createDataFrame([("red", 1), ("red", 2), ("blue", 3)], "label string, k int")
    assert sorted(r.filename for r in tables.numbered_names(rows, "label", "k").collect()) == ["blue_0000.jpg", "red_0000.jpg", "red_0001.jpg"]
    tables.write_json(rows, str(tmp_path / "j"))
    tables.write_parquet(rows, str(tmp_path / "p"))
    tables.write_text(rows.select("label"), str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == spark.read.text(str(tmp_path / "t")).count() == 3
    assert [r.label for r in tables.not_yet(rows, rows.where("k < 3"), "label").collect()] == ["blue"]
    keys = spark.createDataFrame([("out/f0_w1_c2_x30.png",)], "p string").select(*text.crop_key(F.col("p"), "fwcx")).first()
    assert tuple(keys) == (0, 1, 2, 30)


def test_language_model_round_trips(spark):
    corpus = spark.createDataFrame([("بيت بيت بيت",)], "text string")
    p = language_model.probabilities(language_model.bigram_counts(corpus, pattern=text.ARABIC))
    assert {(r.a + r.b): r.p for r in p.collect()} == {"بي": 1.0, "يت": 1.0}
    again = language_model.from_json(language_model.to_json(p))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, p.collect()))
    assert language_model.from_json(spark.createDataFrame([("broken",)], "json string")).count() == 0
    counts = language_model.frequencies_from_json(spark.createDataFrame([('{"a": 3}',)], "json string"))
    assert [tuple(r) for r in counts.collect()] == [("a", 3)]
    rows = spark.createDataFrame([([("ي", 0.4), ("ا", 0.6)], "ب"), ([("ي", 0.4)], None)], "c array<struct<label string, conf double>>, prev string")
    got = rows.select(language_model.rescore_candidates(F.col("c"), F.col("prev"), language_model.as_map(p)).alias("r")).collect()
    assert [x.label for x in got[0].r] == ["ي", "ا"] and got[1].r[0].conf == 0.4


def test_arabic_tables(spark):
    forms, dots = arabic.form_glyphs(), arabic.letter_dots()
    assert forms["Ain_Start"] == "عـ" and forms["Baa_Middle"] == "ـبـ" and forms["Ha_End"] == "ـه" and forms["7"] == "٧" and forms["Laa_End"] == "لا"
    assert "Alef_Hamza_Isolated" in forms and "Alef_Hamza_Start" not in forms and dots["Sheen"] == (3, 0) and dots["Kha"] == (1, 0)
    rows = spark.createDataFrame([("Ain_Start",), ("بـ",), ("nope",), ("",)], "l string")
    got = rows.select(arabic.label_to_text(F.col("l")).alias("t"), arabic.label_to_glyph(F.col("l")).alias("g")).collect()
    assert [r.t for r in got] == ["ع", "ب", "_", "_"] and got[0].g == "عـ" and got[2].g == ""
    assert spark.range(1).select(arabic.body_letter(F.lit("ba"), F.lit(2), F.lit(0)).alias("x")).first().x == "ت"


def test_text_columns(spark):
    def value(column):
        return spark.range(1).select(column.alias("x")).first().x

    assert value(text.normalise_for_eval(F.lit("A[b]__c  *d* é!"))) == "a b c d é"
    assert value(text.cer(F.lit(""), F.lit("abc"))) == 0.0 and value(text.cer(F.lit("abcd"), F.lit("abxd"))) == 0.25
    assert value(text.restore_case(F.lit("hello"), F.lit("HxLlo"))) == "HeLlo"
    assert value(text.wrap(F.lit("aa bb cccccccc d"), 5)) == ["aa bb", "cccccccc", "d"]
    assert value(text.joined(F.array(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b"))))) == "a\nb"
    assert value(text.label_from_filename(F.lit("Red_12"))) == "red"


def test_word_distance_matches_plain_table(spark):
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    pairs = [([f"w{rng.randrange(6)}" for _ in range(rng.randrange(9))], [f"w{rng.randrange(6)}" for _ in range(rng.randrange(9))]) for _ in range(60)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a array<string>, b array<string>")
    got = {r.k: r.d for r in frame.select("k", text.word_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {k: plain(a, b) for k, (a, b) in enumerate(pairs)}


def test_suppression_matches_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for k in range(140):
        x, y = rng.randrange(40), rng.randrange(40)
        rows.append((k % 7, k, round(rng.random(), 4), (float(x), float(y), float(x + rng.randrange(5, 30)), float(y + rng.randrange(5, 30)))))
    frame = spark.createDataFrame(rows, "img int, id int, score double, box struct<x1 double, y1 double, x2 double, y2 double>")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0

    want = set()
    for img in range(7):
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[2], -r[1])):
            if all(iou(r[3], k[3]) < 0.3 for k in kept):
                kept.append(r)
        want |= {(img, r[1]) for r in kept}
    got = geometry.suppress(frame, "img", 0.3)
    assert {(r.img, r.id) for r in got.collect()} == want
    assert geometry.suppress(got, "img", 0.3).count() == len(want)
    pairs = geometry.iou_join(frame.select("img", F.col("id").alias("i"), F.col("box").alias("a")), frame.select("img", F.col("id").alias("j"), F.col("box").alias("b")), "img", 0.2, cell=16)
    assert {(r.i, r.j) for r in pairs.collect()} == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and iou(a[3], b[3]) >= 0.2}
    assert spark.range(1).select(boxes.iou(boxes.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), boxes.box(F.lit(5), F.lit(5), F.lit(15), F.lit(15))).alias("x")).first().x == 25 / 175


def test_regions_to_lines(spark):
    rect = lambda x, y, w, h: [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]
    rows = [("p", 0, rect(50, 2, 20, 10), "world"), ("p", 1, rect(0, 0, 20, 10), "hello"), ("p", 2, rect(0, 30, 20, 10), "next"), ("p", 3, rect(30, 31, 5, 10), ""), ("q", 0, rect(0, 0, 1, 1), "one")]
    frame = spark.createDataFrame(rows, "img string, region int, polygon array<struct<x double, y double>>, text string")
    assert {tuple(r) for r in geometry.region_text(frame, "img").collect()} == {("p", "hello world\nnext"), ("q", "one")}
    box = frame.where("region = 1").select(boxes.polygon_box(F.col("polygon")).alias("b")).first().b
    assert tuple(box) == (0, 0, 21, 11)


def test_dots_by_cluster(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 9.0, 20.0), (2, 5.0, 5.0)], "k int, cx double, cy double")
    got = {tuple(r) for r in geometry.cluster_dots(rows, "k", 2.0, F.lit(10.0)).collect()}
    assert got == {(1, 0.5, 0.0, 2, "above"), (1, 9.0, 20.0, 1, "below"), (2, 5.0, 5.0, 1, "above")}


def test_classifiers_save_and_load(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, "abcd"[i % 4], (rng.normal(0, 0.3, 6) + np.eye(4, 6)[i % 4] * 3).tolist()) for i in range(160)]
    frame = spark.createDataFrame(rows, "id int, label string, features array<double>")
    for name in ("rf", "svm", "lr", "cnn"):
        model = ml.Classifier(name, hidden=8).train(frame)
        out = model.predict(frame, k=3).collect()
        assert sum(r.predicted == r.label for r in out) >= 0.9 * len(out)
        assert all(len(r.cands) == 3 and r.cands[0].conf >= r.cands[1].conf >= r.cands[2].conf and sum(c.conf for c in r.cands) <= 1.01 for r in out)
        model.save(str(tmp_path / name))
        again = ml.Classifier(name).load(str(tmp_path / name)).predict(frame, k=3)
        assert {(r.id, r.predicted) for r in again.collect()} == {(r.id, r.predicted) for r in out}
    try:
        ml.get_classifier("nope")
    except ValueError as e:
        assert "known" in str(e)
    assert ml.folds_possible(frame, "label") == 5
    margins = spark.createDataFrame([(x / 10, int(x > 0)) for x in range(-20, 21)], "m double, y int")
    fitted = ml.calibrated(margins, "m", "y").transform(margins.select(F.col("m"), ml.array_to_vector(F.array("m")).alias("vector")))
    assert fitted.where("m > 1").agg(F.min("prediction")).first()[0] == 1.0


def test_windows_and_augmentation(spark):
    px = np.random.default_rng(1).integers(0, 256, (100, 130, 3)).astype(np.uint8)
    frame = spark.createDataFrame([(1, 100, 130, 3, px.tobytes()), (2, 50, 50, 1, bytes(2500)), (3, None, None, None, None)], f"k int, {images.IMAGE}")
    assert {(r.y, r.x) for r in ml.windows(frame).collect()} == {(0, 0), (0, 32)}
    spots = ml.random_windows(frame, "k").collect()
    assert len(spots) == 4 and all(0 <= r.x <= 34 and 0 <= r.y <= 4 for r in spots)
    more = images.augmented(frame.where("k = 1"), ["k"], "k").orderBy("variant").collect()
    assert len(more) == 3 and bytes(more[1].px) == px[:, ::-1].tobytes()
    assert images.resized(frame, ["k"], 65).where("k = 1").first().w == 65
    assert images.mapped(frame, ["k"], lambda x: x).where("k = 3").first().px is None


def test_averages_and_comparison(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    report = {r.label: r for r in metrics.class_report(frame, "t", "p").collect()}
    assert report["a"].precision == 1 and report["a"].recall == 0.5 and report["c"].f1 == 0 and report["b"].support == 1
    one = spark.createDataFrame([(1, "بيت x")], "k int, text string")
    two = spark.createDataFrame([(1, "بيت")], "k int, text string")
    row = metrics.compare_runs(one, two, "k").first()
    assert (row.base_outside, row.other_outside, row.distance) == (1, 0, 2)
    assert metrics.best_of(spark.createDataFrame([(0.5, 1), (0.7, 3), (0.7, 2)], "s double, k int"), "s", "k").first().k == 2
    assert color.COLOURS[0] == "red"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    (tmp_path / "in/b.bin").write_bytes(b"")
    found = files.to_memory(files.arriving_files(spark, str(tmp_path / "in"), "*.bin"), "arrived")
    assert {bytes(r.content) for r in found.collect()} - {b""} == {b"abc"}
    rows = spark.sql("SELECT * FROM VALUES (timestamp_ntz'2024-01-01 00:01:00', 'a'), (timestamp_ntz'2024-01-01 00:06:00', 'a'), (timestamp_ntz'2024-01-01 00:07:00', 'b') v(ts, k)")
    rows.write.parquet(str(tmp_path / "events"))
    events = files.timed(files.arriving_tables(spark, str(tmp_path / "events"), rows.schema), "ts", "10 minutes")
    counts = files.to_memory(files.windowed(events, "ts", "5 minutes", ["k"], F.count("*").alias("n")), "counts", "complete")
    assert sorted((r.k, r.n) for r in counts.collect()) == [("a", 1), ("a", 1), ("b", 1)]
    gaps = files.to_memory(files.sessions(events, "ts", "6 minutes", ["k"], F.count("*").alias("n")), "gaps", "complete")
    assert sorted((r.k, r.n) for r in gaps.collect()) == [("a", 2), ("b", 1)]


def test_line_fit_is_exact_in_every_order(spark):
    lines = [[(7, 10), (7, 15), (71, 15)], [(0, 0), (1, 5), (2, 5), (9, 30)], [(3, 1), (3, 9)]]
    data = [(f"{k} {m}", x, y) for k, line in enumerate(lines) for m, order in enumerate(itertools.permutations(line)) for x, y in [*order, (None, 3), (4, None)]]
    points = spark.createDataFrame(data, "img string, x long, y long").coalesce(1)
    for shift, kind in ((0, "long"), (20, "double")):
        for r in geometry.line_fit(points.select("img", (F.col("x") + shift).cast(kind).alias("x"), F.col("y").cast(kind).alias("y")), "img", "x", "y").collect():
            line = [(x + shift, y) for x, y in lines[int(r.img.split()[0])]]
            n, sx, sy, sxx, sxy = len(line), sum(x for x, _ in line), sum(y for _, y in line), sum(x * x for x, _ in line), sum(x * y for x, y in line)
            under = n * sxx - sx * sx
            want = ((n * sxy - sx * sy) / under, (sy * sxx - sx * sxy) / under) if under else (None, None)
            assert (r.slope, r.intercept) == want
    rough = geometry.line_fit(spark.createDataFrame([(1, 1e12 + x, 2.5 * x) for x in (0.5, 1.5, 2.0)] + [(2, 1e12 + x, 3.0 * x) for x in range(3)], "img long, x double, y double"), "img", "x", "y").collect()
    assert {r.img: round(r.slope, 2) for r in rough} == {1: 2.5, 2: 3.0}

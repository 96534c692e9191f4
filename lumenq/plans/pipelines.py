"""The end-to-end queries: detection, right-to-left and left-to-right recognition, colours.

Each takes a table of images with a key and gives one row per image; every
classifier is one of ``operators.ml``. Images go through Python once per
kernel, everything after the characters is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import candidates as cd
from ..functions import color
from ..operators import decode, geometry, images, ml

# fixed values
CONFIDENCE, IOU, TOP_ARABIC, TOP_LATIN = 0.85, 0.15, 15, 5


def detections(rows: DataFrame, key: str, models: dict[str, ml.Classifier], confidence: float = CONFIDENCE, threshold: float = IOU) -> DataFrame:
    """``key, objects``: labelled boxes over the confidence, suppressed across
    classes. ``models`` hold one binary classifier ('0', '1') per class."""
    found = geometry.first_then_large(images.proposals(images.resized(rows, [key]), [key]), key, "proposal")
    feats = images.patch_features(found, [key, "proposal", "box"])
    scored = None
    for name, model in models.items():
        part = model.predict(feats, k=2).withColumn("score", cd.total(F.filter("cands", lambda c: c["label"] == "1")))
        part = part.where(F.col("score") >= confidence).select(key, "proposal", "box", "score", F.lit(name).alias("label"))
        scored = part if scored is None else scored.unionByName(part)
    item = F.struct("score", F.struct("label", "proposal").alias("id"), "box")
    kept = scored.groupBy(key).agg(F.collect_list(item).alias("rows")).select(key, _suppressed(threshold).alias("kept"))
    corner = lambda k: F.struct(*[k["box"][c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    shaped = F.transform("kept", lambda k: F.struct(k["id"]["label"].alias("label"), F.bround(k["score"], 4).alias("confidence"), corner(k).alias("bbox")))
    return rows.select(key).join(kept.select(key, shaped.alias("objects")), key, "left")


def _suppressed(threshold: float):
    from ..functions.boxes import suppress

    return suppress(F.col("rows"), threshold)


def arabic_text(rows: DataFrame, key: str, model: ml.Classifier, bigrams: dict[str, float] | None, lexicon: dict[str, int], boost: float = 0.20, penalty: float = 0.10) -> DataFrame:
    """``key, text`` of each page: characters, candidates, dots, words by line."""
    chars = images.arabic_characters(images.arabic_pages(rows, [key]), [key])
    place = [key, "line_idx", "paw_idx", "char_idx"]
    feats = images.arabic_features(chars, [*place, "position", "dots"])
    # one step a column: nested, the lambdas would be resolved again and again
    scored = model.predict(feats, k=TOP_ARABIC).withColumn("seen", geometry.dot_features(F.col("dots")))
    scored = scored.withColumn("cands", cd.rerank(F.col("cands"), F.col("seen")[0], F.col("seen")[1], boost, penalty))
    scored = scored.select(*place, cd.as_text(F.col("cands")).alias("cands"))
    lines = decode.line_texts(scored, [key, "line_idx"], bigrams, lexicon).where("text <> ''")
    texts = lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return rows.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def latin_text(rows: DataFrame, key: str, model: ml.Classifier, lexicon: list[str] | None, height: int = 1000) -> DataFrame:
    """``key, text, clean`` of each picture: frames, characters, dictionary words, lines."""
    frames = images.text_frames(rows, [key])
    place = [key, "frame_idx"]
    chars = images.latin_characters(images.latin_pages(frames, place, height), place)
    spot = [*place, "char_idx"]
    feats = images.latin_features(chars, [*spot, "line_idx", "word_idx", "word_x", "x"])
    scored = model.predict(feats, k=TOP_LATIN)
    words = scored.groupBy(*place, "word_idx").agg(F.min("line_idx").alias("line_idx"), F.min("word_x").alias("word_x"), F.sort_array(F.collect_list(F.struct("x", "char_idx", "cands"))).alias("s"))
    words = words.withColumn("d", decode.dictionary_text(F.transform("s", lambda s: s["cands"]), lexicon))
    words = words.withColumn("word", F.when(cd.unreliable(F.col("d.text"), F.col("d.conf")), F.lit("___")).otherwise(F.col("d.text")))
    lines = words.withColumn("line", F.struct("frame_idx", "line_idx"))
    texts = geometry.assemble_text(lines, [key], "line", "word_x", "word")
    clean = F.translate(F.lower("text"), "?_", "")
    return rows.select(key).join(texts, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(clean, F.lit("")).alias("clean"))


def colour_names(rows: DataFrame, key: str, model: ml.Classifier | None = None) -> DataFrame:
    """``key, color, confidence, top3, error``: by rules, or by a model over the five features."""
    lab = images.colours(rows, [key])
    light, a, b = F.col("light"), F.col("a"), F.col("b")
    error = images.error_column(F.col("light"))
    if model is None:
        return lab.select(key, F.when(light.isNotNull(), color.name_by_rules(light, a, b)).alias("color"), F.when(light.isNotNull(), F.lit(1.0)).alias("confidence"), F.array().cast(cd.KIND).alias("top3"), error.alias("error"))
    good = lab.where("light IS NOT NULL").withColumn("features", color.features(light, a, b))
    named = model.predict(good, k=3).select(key, "predicted", F.transform("cands", lambda c: cd.pair(c["label"], F.bround(c["conf"], 4))).alias("top3"))
    out = lab.select(key, error.alias("error")).join(named, key, "left")
    return out.select(key, F.col("predicted").alias("color"), F.col("top3")[0]["conf"].alias("confidence"), "top3", "error")

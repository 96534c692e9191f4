"""Names, labels, candidates, models on disk and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic
from ..functions import boxes as bx
from ..functions import candidates as cd
from ..functions import text as tx
from ..operators import geometry, metrics
from ..operators import language_model as lm
from ..sources import tables
from ..sources.tables import table
from ..streaming import files
from .box_queries import _BOXES, _boxes
from .ml_queries import _CANDS_SQL, _DOTS_SQL, _NAMES, _NOISY, _bigrams, _cands, _noisy
from .pixel_queries import pixels
from .registry import query
from .text_queries import _FREQ, _PROBS, _documents
from .text_queries import _bigrams as _probabilities


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lumenq-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CROP = "'line/f' || l_orderkey || '_w' || l_linenumber || '_c' || (l_partkey % 9) || '_x' || (l_suppkey % 40 - 5) || '.png'"


@query(f"SELECT {', '.join(f'''regexp_extract(p, '{c}(-?[0-9]+)', 1)::INT AS {c}''' for c in ('/f', '_w', '_c', '_x')).replace('AS /f', 'AS f').replace('AS _', 'AS ')} FROM (SELECT {_CROP} AS p FROM lineitem)")
def crop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame, word, character and place from the names of crops."""
    path = F.format_string("line/f%d_w%d_c%d_x%d.png", "l_orderkey", "l_linenumber", F.col("l_partkey") % 9, F.col("l_suppkey") % 40 - 5)
    return table(spark, sf_dir, "lineitem").select(*tx.crop_key(path, "fwcx"))


_SIZE = "SELECT o_orderkey AS id, 20 + o_custkey % 900 AS w, 1 + o_orderkey % 700 AS h FROM orders"


@query(f"""SELECT id, {', '.join(f"greatest(1, {fit}({c} * s))::INT AS {c}_{name}" for name, fit in (("cut", "floor"), ("even", "round_even")) for c in "wh").replace("round_even(w * s)", "round_even(w * s, 0)").replace("round_even(h * s)", "round_even(h * s, 0)")}
 FROM (SELECT *, least(1, 512::DOUBLE / greatest(w, h)) AS s FROM ({_SIZE}))""")
def size_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of images after the cap on their longer side, truncated and rounded."""
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (20 + F.col("o_custkey") % 900).alias("w"), (1 + F.col("o_orderkey") % 700).alias("h"))
    sizes = {name: bx.shrink(F.col("w"), F.col("h"), 512, rounded) for name, rounded in (("cut", False), ("even", True))}
    return images.select("id", *[size[i].alias(f"{c}_{name}") for name, size in sizes.items() for i, c in enumerate("wh")])


_SUFFIX = "CASE pos WHEN 'isolated' THEN '_Isolated' WHEN 'initial' THEN '_Start' WHEN 'medial' THEN '_Middle' WHEN 'final' THEN '_End' ELSE '_?' END"


@query(f"""WITH p AS (SELECT v.*, ends_with(label, {_SUFFIX}) AS fits FROM {_CANDS_SQL}), q AS (SELECT * FROM p QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY id)),
 m AS (SELECT q.*, CASE WHEN d.base IS NULL THEN conf WHEN ea = da AND eb = db THEN conf + 0.2 ELSE greatest(0, conf - 0) END AS s FROM q LEFT JOIN {_DOTS_SQL} ON d.base = regexp_replace(label, '_[^_]*$', ''))
 SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s DESC, k) - 1)::INT AS k, label, round(s / sum(s) OVER (PARTITION BY id), 9) AS conf FROM m""")
def position_and_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cd.position_and_dots(F.col("cands"), F.col("pos"), F.col("da"), F.col("db"))
    return _cands(spark, sf_dir).select("id", F.posexplode(found).alias("k", "c")).select("id", "k", F.col("c.label").alias("label"), F.round("c.conf", 9).alias("conf"))


@query(f"""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY m DESC, k) - 1)::INT AS k, label, round(m / sum(m) OVER (PARTITION BY id), 9) AS conf
 FROM (SELECT *, 0.6::DOUBLE * conf + 0.4::DOUBLE / (1 + (id + k) % 5) AS m FROM {_CANDS_SQL})""")
def blended_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a second model's probabilities mixed in."""
    rows = _cands(spark, sf_dir)
    second = F.transform("cands", lambda c, i: 1.0 / (1 + (F.col("id") + i + 1) % 5))
    return rows.select("id", F.posexplode(cd.blend(F.col("cands"), second)).alias("k", "c")).select("id", "k", F.col("c.label").alias("label"), F.round("c.conf", 9).alias("conf"))


_GLYPHS = {n: arabic.form_glyphs().get(n, "") for n in _NAMES}
_BARE = {n: g.replace(arabic.TATWEEL, "") or arabic.UNDETECTED for n, g in _GLYPHS.items()}


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query(f"""SELECT DISTINCT label, {_case('label', {'Baa_Start': 'بـ', 'Taa_Start': 'تـ', 'Baa_Middle': 'ـبـ', 'Noon_Middle': 'ـنـ', 'Taa_Middle': 'ـتـ', 'Ba_Middle': 'ـبـ', 'Alef_End': 'ـا', 'xyz': '', 'Raa_End': 'ـر', 'Dal_End': 'ـد'})} AS glyph,
 {_case('label', {'Baa_Start': 'ب', 'Taa_Start': 'ت', 'Baa_Middle': 'ب', 'Noon_Middle': 'ن', 'Taa_Middle': 'ت', 'Ba_Middle': 'ب', 'Alef_End': 'ا', 'xyz': '_', 'Raa_End': 'ر', 'Dal_End': 'د'})} AS letter,
 regexp_replace(label, '_[^_]*$', '') AS name, coalesce(d.ea, -1) AS above, coalesce(d.eb, -1) AS below, regexp_full_match({_case('label', _BARE)}, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic, CASE label WHEN 'Ba_Middle' THEN 'Baa_Middle' ELSE label END AS merged
 FROM {_CANDS_SQL} LEFT JOIN {_DOTS_SQL} ON d.base = regexp_replace(label, '_[^_]*$', '')""")
def form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form labels (and an alias) to glyphs, letters, dots, and merged with their synonym."""
    label, letter = F.col("label"), arabic.label_to_text(F.col("label"))
    rows = _cands(spark, sf_dir).select(F.explode("cands.label").alias("label")).distinct()
    dots = arabic.expected_dots(label)
    return rows.select(
        "label", arabic.label_to_glyph(label).alias("glyph"), letter.alias("letter"), arabic.base_name(label).alias("name"), F.coalesce(dots["above"], F.lit(-1)).alias("above"), F.coalesce(dots["below"], F.lit(-1)).alias("below"),
        arabic.is_arabic(letter).alias("arabic"), arabic.merge_label(label, {"Ba_Middle": "Baa_Middle"}).alias("merged"),
    )


@query("""SELECT DISTINCT w AS model, array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN substr(w, i, 1) <> lower(substr(w, i, 1)) THEN upper(substr(reverse(w), i, 1)) ELSE lower(substr(reverse(w), i, 1)) END), '') AS word
 FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)""")
def restored_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words (here spelt backwards) in the case of a model word of their length."""
    words = _documents(spark, sf_dir).select(F.explode(tx.found(F.col("text"), "[A-Za-z]+")).alias("model")).distinct()
    return words.select("model", tx.restore_case(F.reverse("model"), F.col("model")).alias("word"))


@query(f"""SELECT n.word, n.i::INT AS i, (row_number() OVER (PARTITION BY n.word, n.i ORDER BY m DESC, o) - 1)::INT AS k, label, round(m, 9) AS conf FROM (
  SELECT n.*, CASE WHEN i = 1 THEN conf ELSE 0.7::DOUBLE * conf + 0.3::DOUBLE * coalesce(q.p, 1e-6) END AS m, CASE WHEN i = 1 THEN 0 ELSE 1 END AS moved FROM ({_NOISY}) n LEFT JOIN ({_PROBS}) q ON q.a = substr(n.word, (n.i - 1)::BIGINT, 1) AND q.b = n.label) n WHERE moved = 1""")
def rescored_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter candidates with the probability after the letter before mixed in."""
    rows = _noisy(spark, sf_dir).select("word", F.posexplode("cands").alias("at", "c")).where("at > 0")
    mixed = lm.rescore_candidates(F.col("c"), F.substring("word", F.col("at"), F.lit(1)), _bigrams(spark, sf_dir))
    flat = rows.select("word", (F.col("at") + 1).alias("i"), F.posexplode(mixed).alias("k", "c"))
    return flat.select("word", "i", "k", F.col("c.label").alias("label"), F.round("c.conf", 9).alias("conf"))


@query(f"SELECT a, b, round(p, 9) AS p FROM ({_PROBS})")
def stored_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bigram table written as nested JSON and read again."""
    path = scratch(spark, "bigrams")
    lm.to_json(_probabilities(spark, sf_dir)).write.text(path)
    return lm.from_json(spark.read.text(path, wholetext=True), "value").withColumn("p", F.round("p", 9))


@query(f"SELECT word, n FROM ({_FREQ}) WHERE n >= 2")
def stored_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts written as JSON lines and read again; the lexicon from them."""
    path = scratch(spark, "frequencies")
    tables.write_json(lm.frequencies(_documents(spark, sf_dir)), path)
    return lm.lexicon(spark.read.schema("word string, n long").json(path))


@query("SELECT unnest(regexp_extract_all(line, '[a-z]+')) AS word FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)")
def stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as plain text and scanned for tokens line by line."""
    path = scratch(spark, "texts")
    tables.write_text(table(spark, sf_dir, "benchmark").select("text"), path)
    return tables.plain_tokens(spark, path, "[a-z]+")


@query("""SELECT page_id, label || '_' || printf('%04d', row_number() OVER (PARTITION BY label ORDER BY page_id) - 1) || '.jpg' AS filename
 FROM (SELECT page_id, regexp_extract(url, '//[^/]*[.]([a-z]+)', 1) AS label FROM pages)""")
def numbered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of a labelled set: label and running number."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"//[^/]*[.]([a-z]+)", 1).alias("label"))
    return tables.numbered_names(rows, "label", "page_id").select("page_id", "filename")


@query("""SELECT label || '/' || label || '_' || printf('%04d', row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) || '.jpg' AS image_path, label::VARCHAR AS label FROM embeddings""")
def stored_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled images written with their list of labels, and the list read again."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return tables.write_dataset(pixels(spark, sf_dir).join(labels, "vec_id"), "label", "vec_id", scratch(spark, "dataset"))


@query("SELECT vec_id, label::INT AS label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE label IN (0, 1, 2, 3, 4)")
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written by class; those of five classes loaded."""
    path = scratch(spark, "features")
    table(spark, sf_dir, "embeddings").write.partitionBy("label").parquet(path)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v)
    return tables.load_features(spark, path, ["0", "1", "2", "3", "4"]).select("vec_id", "label", F.round(total, 5).alias("total"))


@query(f"""SELECT img, string_agg(t, chr(10) ORDER BY n) AS text FROM (SELECT img, n, string_agg('w' || (id % 100), ' ' ORDER BY x1, 'w' || (id % 100)) AS t FROM {_BOXES} WHERE score >= 0.2 GROUP BY 1, 2) GROUP BY 1""")
def confident_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words with a sure score, by line and place."""
    words = _boxes(spark, sf_dir).select("img", "n", "x1", "score", F.concat(F.lit("w"), (F.col("id") % 100).cast("string")).alias("word"))
    return geometry.confident_text(words, ["img"], "n", "x1", "word", "score", 0.2)


@query(r"SELECT c AS char, CASE WHEN regexp_full_match(c, '\p{L}') THEN lower(c) ELSE c END AS lower FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''")
def lower_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = _documents(spark, sf_dir).select(F.explode(F.split("text", "")).alias("char")).where("char <> ''").distinct()
    return chars.select("char", tx.lower_letter(F.col("char")).alias("lower"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def files_not_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "pages").select("page_id")
    return tables.not_yet(wanted, wanted.where("page_id % 3 = 0"), "page_id")


@query("""SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS batch_idx, unnest(range(0, n_regionkey + 1))::INT AS label FROM nation""")
def collated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged label arrays of one batch, flattened with the image's place in it."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.sequence(F.lit(0), F.col("n_regionkey")).alias("labels"))
    return tables.batch_labels(rows, "n_nationkey", "labels")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the runs, as a checkpoint is chosen: one row is the feature."""
    return metrics.best_of(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey")


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that is there, run through the stream; its last complete result."""
    out = scratch(spark, name)
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = files.arriving_tables(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    return files.timed(stream, "ts", "1 hour")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind, as a stream."""
    rows = files.windowed(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    return _streamed(spark, rows, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS new FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, ended by half an hour without an event, as a stream."""
    rows = files.sessions(_events(spark, sf_dir), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))
    return _streamed(spark, rows, "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")

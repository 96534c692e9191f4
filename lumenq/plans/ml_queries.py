"""Feature vectors, candidates, decoders and classifiers on embeddings and benchmark words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import candidates as cd
from ..operators import decode, language_model, metrics, ml
from ..sources.tables import table
from .registry import query
from .text_queries import _ITEMS, _PROBS

WORD_FREQ_TOPN = 100_000  # the reference's

_FLAT = "(SELECT vec_id, label, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_DIST = f"(SELECT f.vec_id, f.label AS truth, c.label AS label, sum((f.v - c.m) * (f.v - c.m)) AS d FROM {_FLAT} f JOIN (SELECT label, dim, avg(v) AS m FROM {_FLAT} GROUP BY 1, 2) c ON c.dim = f.dim GROUP BY 1, 2, 3)"
_PRED = f"(SELECT vec_id, truth, arg_min(label, (round(d, 9), label)) AS predicted FROM {_DIST} GROUP BY 1, 2)".replace("arg_min(label, (round(d, 9), label))", "first(label ORDER BY round(d, 9), label)")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return ml.distances(rows, "vec_id", ml.centroids(rows, "label"), "label")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _distances(spark, sf_dir).groupBy("vec_id").agg(F.min_by("label", F.struct(F.round("distance", 9).alias("d"), "label")).alias("predicted"))
    return near.join(_vectors(spark, sf_dir).select("vec_id", F.col("label").alias("truth")), "vec_id")


@query(f"SELECT truth, {', '.join(f'count(*) FILTER (predicted = {k}) AS {chr(34)}{k}{chr(34)}' for k in range(10))} FROM {_PRED} GROUP BY truth")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predicted(spark, sf_dir), "truth", "predicted", list(range(10)))


_REPORT = f"""(SELECT l.label, coalesce(t.hits / nullif(p.n, 0), 0) AS precision, coalesce(t.hits / nullif(t.n, 0), 0) AS recall, coalesce(t.n, 0) AS support FROM (SELECT DISTINCT label FROM embeddings) l
 LEFT JOIN (SELECT truth, count(*) AS n, count(*) FILTER (truth = predicted) AS hits FROM {_PRED} GROUP BY truth) t ON t.truth = l.label LEFT JOIN (SELECT predicted, count(*) AS n FROM {_PRED} GROUP BY 1) p ON p.predicted = l.label)"""


@query(f"SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, support FROM {_REPORT}")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.class_report(_predicted(spark, sf_dir), "truth", "predicted")
    return out.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"SELECT 'macro' AS kind, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, sum(support)::BIGINT AS support FROM {_REPORT} UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), sum(support)::BIGINT FROM {_REPORT}")
def report_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.report_averages(metrics.class_report(_predicted(spark, sf_dir), "truth", "predicted"))
    return out.select("kind", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "support")


@query(f"SELECT round(avg((truth = predicted)::INT), 9) AS accuracy, count(*) AS n FROM {_PRED}")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_predicted(spark, sf_dir), "truth", "predicted").select(F.round("accuracy", 9).alias("accuracy"), "n")


_TOP = f"""SELECT vec_id, k::INT AS k, label, p FROM (SELECT vec_id, label, round(exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id), 6) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), label DESC) AS k FROM {_DIST}) WHERE k <= 3"""


def _nearest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _distances(spark, sf_dir).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("label", (-F.round("distance", 9)).alias("s")))).alias("x"))
    return rows.select("vec_id", cd.top_k(F.transform("x", lambda s: s["label"].cast("string")), cd.softmax(F.transform("x", lambda s: s["s"])), 3).alias("cands"))


@query(_TOP)
def topk_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _nearest_classes(spark, sf_dir).select("vec_id", F.posexplode("cands").alias("k", "c"))
    return flat.select("vec_id", (F.col("k") + 1).alias("k"), F.col("c.label").cast("int").alias("label"), F.round("c.conf", 6).alias("p"))


@query(f"""SELECT vec_id, (dim - 1)::INT AS dim, round((v - avg(v) OVER (PARTITION BY dim)) / stddev_pop(v) OVER (PARTITION BY dim), 6) AS z FROM {_FLAT}""")
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    scaled = ml.standardised(rows, ml.scaling(rows))
    return scaled.select("vec_id", F.posexplode("features").alias("dim", "z")).select("vec_id", "dim", F.round("z", 6).alias("z"))


@query("""SELECT vec_id, k <= floor(n * 0.15 + 0.5) AS held_out, ((k - 1) % 5)::INT AS fold FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ml.stratified_folds(ml.stratified_split(_vectors(spark, sf_dir), "label", "vec_id", 0.15), "label", "vec_id", 5)
    return rows.select("vec_id", "held_out", "fold")


@query("SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code, round((SELECT count(*) FROM embeddings) / (count(*) OVER () * n), 9) AS weight FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    weights = ml.balanced_weights(rows, "label").groupBy("label").agg(F.round(F.first("weight"), 9).alias("weight"))
    return ml.label_codes(rows, "label").join(weights, "label")


#: Labels in the place of the ten classes; one is no letter.
_NAMES = ["Baa_Start", "Taa_Start", "Baa_Middle", "Noon_Middle", "Taa_Middle", "Ba_Middle", "Alef_End", "xyz", "Raa_End", "Dal_End"]
_POSITIONS = ["isolated", "initial", "medial", "final", "none"]
_CANDS_SQL = f"(SELECT vec_id AS id, ({_POSITIONS})[vec_id % 5 + 1] AS pos, (vec_id % 4)::INT AS da, (vec_id // 4 % 3)::INT AS db, k, ({_NAMES})[label + 1] AS label, p AS conf FROM ({_TOP})) v"
_DOTS_SQL = "(VALUES ('Baa', 0, 1), ('Ba', 0, 1), ('Taa', 2, 0), ('Noon', 1, 0), ('Alef', 0, 0), ('Raa', 0, 0), ('Dal', 0, 0)) d(base, ea, eb)"


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest classes of each vector as letter candidates."""
    named = lambda c: cd.pair(F.element_at(F.array(*[F.lit(n) for n in _NAMES]), c["label"].cast("int") + 1), F.round(c["conf"], 6))
    position = F.element_at(F.array(*[F.lit(p) for p in _POSITIONS]), (F.col("vec_id") % 5 + 1).cast("int"))
    return _nearest_classes(spark, sf_dir).select(
        F.col("vec_id").alias("id"), position.alias("pos"), (F.col("vec_id") % 4).cast("int").alias("da"), (F.floor(F.col("vec_id") / 4) % 3).cast("int").alias("db"), F.transform("cands", named).alias("cands")
    )


@query(f"""WITH m AS (SELECT v.*, CASE WHEN d.base IS NULL THEN conf WHEN ea = da AND eb = db THEN conf + 0.2 ELSE greatest(0, conf - 0.1) END AS s FROM {_CANDS_SQL} LEFT JOIN {_DOTS_SQL} ON d.base = regexp_replace(label, '_[^_]*$', ''))
 SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s DESC, k) - 1)::INT AS k, label, round(s / sum(s) OVER (PARTITION BY id), 9) AS conf FROM m""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cands(spark, sf_dir).select("id", F.posexplode(cd.rerank(F.col("cands"), F.col("da"), F.col("db"))).alias("k", "c"))
    return rows.select("id", "k", F.col("c.label").alias("label"), F.round("c.conf", 9).alias("conf"))


@query(f"""WITH p AS (SELECT v.*, ends_with(label, CASE pos WHEN 'isolated' THEN '_Isolated' WHEN 'initial' THEN '_Start' WHEN 'medial' THEN '_Middle' WHEN 'final' THEN '_End' ELSE '_?' END) AS fits, d.base IS NULL OR (ea = da AND eb = db) AS dotted FROM {_CANDS_SQL} LEFT JOIN {_DOTS_SQL} ON d.base = regexp_replace(label, '_[^_]*$', '')),
 q AS (SELECT *, bool_or(fits) OVER (PARTITION BY id) AS anyfit, bool_or(dotted) OVER (PARTITION BY id) AS dots FROM p)
 SELECT id, label, fits OR NOT anyfit AS by_position, dotted OR NOT dots OR (da = 0 AND db = 0) AS by_dots FROM q""")
def candidate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cands")
    rows = _cands(spark, sf_dir).select("id", "cands", cd.by_position(c, F.col("pos")).alias("p"), cd.by_dots(c, F.col("da"), F.col("db")).alias("d"))
    has = lambda name: F.exists(name, lambda x: x["label"] == F.col("c.label"))
    return rows.select("id", "p", "d", F.explode("cands").alias("c")).select("id", F.col("c.label").alias("label"), has("p").alias("by_position"), has("d").alias("by_dots"))


@query(f"""WITH g AS (SELECT id, CASE regexp_replace(label, '_[^_]*$', '') WHEN 'Baa' THEN 'ب' WHEN 'Ba' THEN 'ب' WHEN 'Taa' THEN 'ت' WHEN 'Noon' THEN 'ن' WHEN 'Alef' THEN 'ا' WHEN 'Raa' THEN 'ر' WHEN 'Dal' THEN 'د' END AS label, conf FROM {_CANDS_SQL})
 SELECT id, label, round(sum(conf) / sum(sum(conf)) OVER (PARTITION BY id), 9) AS conf FROM g WHERE label IS NOT NULL GROUP BY id, label""")
def candidates_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cands(spark, sf_dir).select("id", F.explode(cd.as_text(F.col("cands"))).alias("c"))
    return rows.select("id", F.col("c.label").alias("label"), F.round("c.conf", 9).alias("conf"))


_NOISY = f"""SELECT word, i, unnest([1, 2, 3]) AS o, unnest([c, chr(97 + (ord(c) - 96) % 26), 'e']) AS label, unnest([sure, 0.7::DOUBLE - sure, 0.3::DOUBLE]) AS conf
 FROM (SELECT word, i, c, 0.35::DOUBLE + ((ord(c) * 7 + (i - 1) * 3) % 10) / 25.0::DOUBLE AS sure FROM (SELECT word, i, substr(word, i, 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM ({_ITEMS}))))"""
#: Every way to spell lexicon words by the candidates, letter by letter.
_SPELT = f"""WITH RECURSIVE noisy AS MATERIALIZED ({_NOISY}), items AS MATERIALIZED ({_ITEMS}), begun AS MATERIALIZED (SELECT DISTINCT substr(word, 1, k) AS prefix FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM items)),
 tried(truth, i, text, total, path) AS (SELECT word, 0, '', 0::DOUBLE, '' FROM items
  UNION ALL SELECT n.word, n.i::INT, t.text || n.label, t.total + n.conf, t.path || n.o FROM tried t JOIN noisy n ON n.word = t.truth AND n.i = t.i + 1 JOIN begun b ON b.prefix = t.text || n.label),
 ended AS (SELECT truth, text, total / i AS conf, path FROM tried WHERE i = length(truth) AND text IN (SELECT word FROM items))"""


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words as candidates: the letter, its successor and 'e', with fixed noise."""
    words = language_model.words(table(spark, sf_dir, "benchmark")).distinct()
    letters = F.filter(F.split("word", ""), lambda c: c != "")

    def options(c, i):
        after = F.translate(c, "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza")
        sure = 0.35 + (F.pmod(F.ascii(c) * 7 + i * 3, F.lit(10))) / 25.0
        return F.array(cd.pair(c, sure), cd.pair(after, 0.7 - sure), cd.pair(F.lit("e"), F.lit(0.3)))

    return words.select("word", F.transform(letters, options).alias("cands"))


def _bigrams(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    return language_model.as_map(language_model.probabilities(language_model.bigram_counts(table(spark, sf_dir, "documents"))))


@query(f"""WITH RECURSIVE noisy AS MATERIALIZED ({_NOISY}), probs AS MATERIALIZED (SELECT a || b AS g, p FROM ({_PROBS})),
 beams(word, i, place, score, text, last) AS (SELECT word, 0, 1::BIGINT, 0::DOUBLE, '', '' FROM (SELECT DISTINCT word FROM noisy)
  UNION ALL SELECT word, i, place, score, text, last FROM (SELECT n.word, n.i::INT AS i, b.score + CASE WHEN n.i = 1 THEN ln(greatest(n.conf, 1e-9)) ELSE ln(greatest(n.conf, 1e-9)) + 0.3::DOUBLE * ln(coalesce(g.p, 1e-6)) END AS score, b.text || n.label AS text, n.label AS last,
    row_number() OVER (PARTITION BY n.word ORDER BY b.score + CASE WHEN n.i = 1 THEN ln(greatest(n.conf, 1e-9)) ELSE ln(greatest(n.conf, 1e-9)) + 0.3::DOUBLE * ln(coalesce(g.p, 1e-6)) END DESC, b.place, n.o) AS place
    FROM beams b JOIN noisy n ON n.word = b.word AND n.i = b.i + 1 LEFT JOIN probs g ON g.g = b.last || n.label) WHERE place <= 5)
 SELECT word, text FROM beams WHERE i = length(word) AND place = 1""")
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _noisy(spark, sf_dir).select("word", decode.beam_text(F.col("cands"), _bigrams(spark, sf_dir)).alias("text"))


@query(f"""WITH RECURSIVE noisy AS MATERIALIZED (SELECT word, i, label, arg_max(conf, o) AS conf, min(o) AS o FROM ({_NOISY}) GROUP BY 1, 2, 3), probs AS MATERIALIZED (SELECT a || b AS g, p FROM ({_PROBS})),
 best(word, i, label, o, score, text) AS (SELECT word, 1, label, o, ln(greatest(conf, 1e-9)), label FROM noisy WHERE i = 1
  UNION ALL SELECT word, i, label, o, score, text FROM (SELECT n.word, n.i::INT AS i, n.label, n.o, b.score + 0.3::DOUBLE * ln(coalesce(g.p, 1e-6)) + ln(greatest(n.conf, 1e-9)) AS score, b.text || n.label AS text,
    row_number() OVER (PARTITION BY n.word, n.label ORDER BY b.score + 0.3::DOUBLE * ln(coalesce(g.p, 1e-6)) DESC, b.o) AS k
    FROM best b JOIN noisy n ON n.word = b.word AND n.i = b.i + 1 LEFT JOIN probs g ON g.g = b.label || n.label) WHERE k = 1)
 SELECT word, text, round(score, 6) AS score FROM best WHERE i = length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY best.score DESC, o) = 1""")
def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _noisy(spark, sf_dir).select("word", decode.viterbi_text(F.col("cands"), _bigrams(spark, sf_dir)).alias("v"))
    return found.select("word", "v.text", F.round("v.score", 6).alias("score"))


@query(_SPELT + " SELECT truth AS word, text, round(conf, 9) AS conf, text = '' OR conf < 0.3 AS blank FROM ended QUALIFY row_number() OVER (PARTITION BY truth ORDER BY ended.conf DESC, path) = 1")
def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon here is the benchmark's words: a table of fixed size."""
    rows = _noisy(spark, sf_dir)
    lexicon = [r["word"] for r in language_model.words(table(spark, sf_dir, "benchmark")).distinct().collect()]
    found = rows.select("word", decode.dictionary_text(F.col("cands"), lexicon).alias("d"))
    return found.select("word", "d.text", F.round("d.conf", 9).alias("conf"), cd.unreliable(F.col("d.text"), F.col("d.conf")).alias("blank"))


@query(_SPELT + " SELECT text, round(max(conf), 9) AS conf FROM ended GROUP BY 1")
def dictionary_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words by semi-joins on the prefix table."""
    rows = _noisy(spark, sf_dir).withColumnRenamed("word", "truth")
    lexicon = language_model.words(table(spark, sf_dir, "benchmark")).distinct()
    prefixes = lexicon.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("word")), lambda n: F.substring("word", F.lit(1), n))).alias("prefix"))
    found = decode.combinations(rows, "truth", "cands", prefixes)
    found = found.select(F.col("word").alias("text"), "conf").join(lexicon.withColumnRenamed("word", "text"), "text", "left_semi")
    return found.groupBy("text").agg(F.round(F.max("conf"), 9).alias("conf"))


@query()
def word_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, all letters, as lines of sub-words (of two letters), decoded
    into words. Counts are of the WORD_FREQ_TOPN most frequent words, as in the
    reference; every lexicon word a run of eight sub-words can spell gets the bonus."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "")).alias("char_idx", "c")).where("c <> ''")
    lines = rows.select("item_id", F.floor(F.col("char_idx") / 2).cast("long").alias("paw_idx"), "char_idx", F.array(cd.pair(F.col("c"), F.lit(0.9)), cd.pair(F.lit("e"), F.lit(0.1))).alias("cands"))
    known = language_model.frequencies(table(spark, sf_dir, "documents"))
    counts = {r["word"]: r["n"] for r in language_model.most_common(known, WORD_FREQ_TOPN).collect()}
    members = {r["word"] for r in language_model.lexicon(known).where("length(word) <= 16").select("word").collect()}
    return decode.line_texts(lines, ["item_id"], _bigrams(spark, sf_dir), counts, words=members)


def _fitted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = ml.stratified_split(_vectors(spark, sf_dir), "label", "vec_id", 0.15)
    model = ml.Classifier(name, hidden=32).train(rows.where("NOT held_out"))
    return model.predict(rows.where("held_out"), k=3).select("vec_id", "label", "predicted", F.size("cands").alias("n_cands"))


@query()
def classify_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "rf")


@query()
def classify_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "svm")


@query()
def classify_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir, "cnn")


@query()
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.cross_validated(_vectors(spark, sf_dir), "lr", "label", "vec_id", 3)


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.clusters(_vectors(spark, sf_dir), 3).select("vec_id", "cluster")


@query("""SELECT vec_id, candidate, (candidate = label)::INT AS target FROM (SELECT vec_id, label, label AS candidate FROM embeddings UNION ALL
 SELECT vec_id, label, c FROM (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY md5(c || vec_id::VARCHAR)) AS k FROM (SELECT vec_id, label::VARCHAR AS label, unnest(['0','1','2','3','4','5','6','7','8','9']) AS c FROM embeddings) WHERE c <> label) WHERE k <= 4)""")
def reranker_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.col("label").cast("string").alias("label"))
    return ml.reranker_rows(rows, "vec_id", "label", [str(k) for k in range(10)]).select("vec_id", "candidate", "target")


@query("""SELECT o_orderkey AS id, y, x FROM (SELECT o_orderkey, unnest(range(0, (100 + o_custkey % 60) - 96 + 1, 32)) AS y, 100 + o_orderkey % 90 AS w FROM orders) CROSS JOIN LATERAL (SELECT unnest(range(0, w - 96 + 1, 32)) AS x)""")
def window_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (100 + F.col("o_custkey") % 60).alias("h"), (100 + F.col("o_orderkey") % 90).alias("w"))
    return ml.windows(images).select("id", "y", "x")

"""Language model, lexicon, text function and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic
from ..functions import text as tx
from ..operators import language_model as lm
from ..operators import metrics
from ..sources.tables import table
from .registry import query

_TOKENS = "SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents"
_FREQ = f"SELECT word, count(*) AS n FROM ({_TOKENS}) GROUP BY word"
_GRAMS = f"""SELECT substr(g, 1, 1) AS a, substr(g, 2, 1) AS b, sum(n)::BIGINT AS n FROM (
  SELECT n, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS g FROM ({_FREQ}) WHERE length(word) >= 2) GROUP BY 1, 2"""
_PROBS = f"SELECT a, b, n / sum(n) OVER (PARTITION BY a) AS p FROM ({_GRAMS})"
_ITEMS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark"
_LETTERS = "SELECT unnest(string_split_regex('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '))"
_SMOOTH = f"""SELECT l.a, m.b, (coalesce(g.n, 0) + 0.01::DOUBLE) / (coalesce(t.total, 0) + 0.01::DOUBLE * 26) AS p
 FROM ({_LETTERS} AS a) l CROSS JOIN ({_LETTERS} AS b) m LEFT JOIN ({_GRAMS}) g ON g.a = l.a AND g.b = m.b
 LEFT JOIN (SELECT a, sum(n) AS total FROM ({_GRAMS}) GROUP BY a) t ON t.a = l.a"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.words(table(spark, sf_dir, "benchmark")).distinct()


def _frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.frequencies(_documents(spark, sf_dir))


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.probabilities(lm.bigram_counts(_documents(spark, sf_dir)))


@query(f"SELECT a, b, round(p, 9) AS p FROM ({_PROBS})")
def bigram_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigrams(spark, sf_dir).withColumn("p", F.round("p", 9))


@query(f"SELECT word, n FROM ({_FREQ}) ORDER BY n DESC, word LIMIT 1000")
def word_freq_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.most_common(_frequencies(spark, sf_dir), 1000)


@query(f"SELECT word, n FROM ({_FREQ}) WHERE n >= 2")
def lexicon_minfreq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lexicon(_frequencies(spark, sf_dir))


@query(f"SELECT sum(n)::BIGINT AS total, count(*) AS distinct_words, count(*) FILTER (n = 1) AS once FROM ({_FREQ})")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.corpus_statistics(_frequencies(spark, sf_dir))


@query(f"SELECT a, b, round(p, 9) AS p FROM ({_SMOOTH})")
def bigram_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.smoothed(lm.bigram_counts(_documents(spark, sf_dir))).withColumn("p", F.round("p", 9))


@query("""SELECT a, b, n FROM (SELECT l[i] AS a, l[i + 1] AS b, count(*) AS n FROM (
  SELECT l, unnest(range(1, len(l))) AS i FROM (SELECT string_split(regexp_replace(lower(text), '[^a-z]', '', 'g'), '') AS l FROM documents)) GROUP BY 1, 2)""")
def bigram_cross_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.bigram_counts_across(_documents(spark, sf_dir))


@query(f"""SELECT i.word, round(coalesce(sum(ln(coalesce(p, 1e-6::DOUBLE))) FILTER (i.g IS NOT NULL), 0), 6) AS score
 FROM (SELECT word, unnest(CASE WHEN length(word) < 2 THEN [NULL] ELSE list_transform(range(1, length(word)), lambda i: substr(word, i, 2)) END) AS g FROM ({_ITEMS})) i
 LEFT JOIN ({_PROBS}) q ON i.g = q.a || q.b GROUP BY i.word""")
def bigram_score_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_sum(_items(spark, sf_dir), _bigrams(spark, sf_dir)).withColumn("score", F.round("score", 6))


_MEAN = f"""SELECT i.word, coalesce(avg(ln(p + 1e-10::DOUBLE)), 0) AS score
 FROM (SELECT word, unnest(CASE WHEN length(word) < 2 THEN [NULL] ELSE list_transform(range(1, length(word)), lambda i: substr(word, i, 2)) END) AS g FROM ({_ITEMS})) i
 LEFT JOIN ({_SMOOTH}) q ON i.g = q.a || q.b GROUP BY i.word"""


@query(f"SELECT word, round(score, 6) AS score FROM ({_MEAN})")
def bigram_score_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = lm.smoothed(lm.bigram_counts(_documents(spark, sf_dir)))
    return lm.score_mean(_items(spark, sf_dir), table_).withColumn("score", F.round("score", 6))


@query(f"""SELECT i.word, round(0.5 + CASE WHEN f.n >= 2 THEN 0.25 ELSE 0 END + 15.0 * ln(coalesce(f.n, 0) + 1) / ln((SELECT max(n) FROM ({_FREQ})) + 1), 6) AS rescored
 FROM ({_ITEMS}) i LEFT JOIN ({_FREQ}) f USING (word)""")
def rescore_word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _frequencies(spark, sf_dir)
    out = lm.rescore_words_by_frequency(_items(spark, sf_dir).withColumn("conf", F.lit(0.5)), lm.lexicon(counts), counts)
    return out.select("word", F.round("rescored", 6).alias("rescored"))


@query(f"""SELECT m.word, round(least(1.0, 0.7 * 0.5 + 0.3 / (1 + exp(-m.score)) + CASE WHEN f.n >= 2 THEN 0.25 ELSE 0 END), 6) AS rescored
 FROM ({_MEAN}) m LEFT JOIN ({_FREQ}) f ON f.word = m.word""")
def rescore_word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = lm.smoothed(lm.bigram_counts(_documents(spark, sf_dir)))
    out = lm.rescore_words_by_bigrams(_items(spark, sf_dir).withColumn("conf", F.lit(0.5)), lm.lexicon(_frequencies(spark, sf_dir)), table_)
    return out.select("word", F.round("rescored", 6).alias("rescored"))


@query(f"SELECT word FROM ({_ITEMS}) WHERE word IN (SELECT word FROM ({_FREQ}) WHERE n >= 2)")
def lexicon_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.in_lexicon(_items(spark, sf_dir), lm.lexicon(_frequencies(spark, sf_dir)))


@query(f"""SELECT p.prefix, f.word FROM (SELECT DISTINCT substr(word, 1, 4) AS prefix FROM ({_ITEMS})) p
 JOIN ({_FREQ}) f ON starts_with(f.word, p.prefix) WHERE f.n >= 2""")
def prefix_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = _items(spark, sf_dir).select(F.substring("word", 1, 4).alias("prefix"))
    return lm.completions(prefixes, lm.lexicon(_frequencies(spark, sf_dir)))


@query(f"""SELECT i.word, i.word IN (SELECT substr(word, 1, k) FROM (SELECT word, unnest(range(0, length(word) + 1)) AS k FROM ({_FREQ}) WHERE n >= 2)) OR regexp_full_match(i.word, '[0-9]+') AS known
 FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) i""")
def prefix_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lm.words(table(spark, sf_dir, "benchmark"), pattern="[a-z0-9]+").distinct()
    return lm.known_or_number(items, lm.lexicon(_frequencies(spark, sf_dir)), prefix=True)


@query(f"""SELECT word, bool_and(fresh) AS added FROM (SELECT DISTINCT word, false AS fresh FROM ({_FREQ}) UNION ALL SELECT word, true FROM ({_ITEMS})) GROUP BY word""")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.vocabulary_union(_frequencies(spark, sf_dir), _items(spark, sf_dir))


@query(f"""WITH f AS ({_FREQ}), q AS (SELECT CASE WHEN length(word) > 3 THEN substr(word, 1, 2) || substr(word, 4) ELSE word END AS word FROM ({_ITEMS})),
 d AS (SELECT DISTINCT word FROM q),
 c AS (SELECT d.word, f.word AS known, f.n, levenshtein(d.word, f.word) AS e FROM d JOIN f ON abs(length(d.word) - length(f.word)) <= 2 WHERE f.n >= 3 AND levenshtein(d.word, f.word) <= 2)
 SELECT d.word, coalesce((SELECT c.known FROM c WHERE c.word = d.word ORDER BY e, n DESC, known LIMIT 1), d.word) AS correction FROM d""")
def spelling_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.length("word") > 3, F.concat(F.substring("word", 1, 2), F.substring("word", 4, 1000))).otherwise(F.col("word"))
    return lm.corrected(_items(spark, sf_dir).select(broken.alias("word")), _frequencies(spark, sf_dir).where("n >= 3"))


_NORM = r"""trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\[\]]', ' ', 'g'), '_+', ' ', 'g'), '\*+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g')), '\s+', ' ', 'g'))"""


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", tx.normalise_for_eval(F.col("text")).alias("norm"))


_ARABIC = ["كَتَبَ", "بِسْمِ اللَّهِ", "abc كتاب 12", "آ", "", "مُحَمَّد"]
_ARABIC_SQL = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_ARABIC))


@query(rf"""SELECT id, nfc_normalize(regexp_replace(t, '[\x{{064B}}-\x{{065F}}]', '', 'g')) AS norm, length(regexp_replace(t, '[\x{{0600}}-\x{{06FF}}\s]', '', 'g')) AS outside,
 chr(8207) || array_to_string(string_split(t, ' '), ' ') || chr(8207) AS rtl FROM (VALUES {_ARABIC_SQL}) v(id, t)""")
def arabic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_ARABIC)), "id int, t string")
    t = F.col("t")
    return rows.select("id", arabic.normalise(t).alias("norm"), arabic.outside_script(t).cast("long").alias("outside"), arabic.join_rtl(F.split(t, " ")).alias("rtl"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '([^/]+)$', 1)), '_[0-9]+$', '') AS label FROM pages")
def label_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.label_from_filename(F.regexp_extract("url", "([^/]+)$", 1)).alias("label"))


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(array_to_string(regexp_extract_all(html, '(?s)<p\\b.*?</p>'), chr(10))), '[a-z]+')) AS w FROM pages) GROUP BY w""".replace("\\\\", "\\"))
def dump_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_join(tx.found(F.col("html"), r"(?s)<p\b.*?</p>"), "\n")
    return table(spark, sf_dir, "pages").select(F.explode(tx.tokens(parts)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_PAIRS = """SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS truth, b.text AS result
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


def _single_bytes(a: str, b: str, rows: str) -> str:
    """SQL for ``rows`` with columns a and b in which each character beyond ASCII of a pair is a
    control character of its own: DuckDB's distance counts bytes."""
    coded = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) > 127 THEN chr((13 + list_position(_far, c))::INT) ELSE c END), '')"
    return f"SELECT * REPLACE ({coded.format(a)} AS {a}, {coded.format(b)} AS {b}) FROM (SELECT *, list_distinct(list_filter(string_split({a} || {b}, ''), lambda c: ord(c) > 127)) AS _far FROM ({rows}))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    a = turns.select("conv_id", "turn", F.col("text").alias("truth"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "truth", "result")


_T, _R = _NORM.format("truth"), _NORM.format("result")


_CER = f"""SELECT pair_id, CASE WHEN length(t) = 0 THEN 0 ELSE levenshtein(r, t) / length(t) END AS cer FROM ({_single_bytes("t", "r", f"SELECT pair_id, {_T} AS t, {_R} AS r FROM ({_PAIRS})")})"""


@query(f"SELECT pair_id, round(cer, 9) AS cer FROM ({_CER})")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = _pairs(spark, sf_dir).select("pair_id", tx.normalise_for_eval(F.col("truth")).alias("t"), tx.normalise_for_eval(F.col("result")).alias("r"))
    return norm.select("pair_id", F.round(tx.cer(F.col("t"), F.col("r")), 9).alias("cer"))


_WORDS = f"""SELECT pair_id, list_filter(string_split({_T}, ' '), lambda w: w <> '') AS t, list_filter(string_split({_R}, ' '), lambda w: w <> '') AS r FROM ({_PAIRS})"""


_RECALL = f"""WITH p AS ({_WORDS}), a AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(t) AS w FROM p) GROUP BY 1, 2),
 b AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, unnest(r) AS w FROM p) GROUP BY 1, 2)
 SELECT p.pair_id, CASE WHEN len(p.t) = 0 THEN 1 ELSE coalesce(h.hits, 0) / len(p.t) END AS recall
 FROM p LEFT JOIN (SELECT a.pair_id, sum(least(a.n, b.n)) AS hits FROM a JOIN b ON a.pair_id = b.pair_id AND a.w = b.w GROUP BY 1) h ON h.pair_id = p.pair_id"""
#: Row by row of the distance table; the way along a row is a running minimum.
_WER = f"""WITH RECURSIVE p AS MATERIALIZED ({_WORDS}),
 cells AS MATERIALIZED (SELECT pair_id, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS j FROM p),
 steps AS MATERIALIZED (SELECT pair_id, unnest(r) AS w, unnest(range(1, len(r) + 1)) AS i FROM p),
 grid(pair_id, i, j, d) AS (SELECT pair_id, 0::BIGINT, unnest(range(0, len(t) + 1)), unnest(range(0, len(t) + 1)) FROM p
  UNION ALL SELECT pair_id, i, j, min(v) OVER (PARTITION BY pair_id ORDER BY j ROWS UNBOUNDED PRECEDING) + j FROM (
   SELECT g.pair_id, s.i, g.j, CASE WHEN g.j = 0 THEN s.i ELSE least(g.d + 1, g.before + (c.w <> s.w)::INT) END - g.j AS v
   FROM (SELECT *, lag(d) OVER (PARTITION BY pair_id ORDER BY j) AS before FROM grid) g JOIN steps s ON s.pair_id = g.pair_id AND s.i = g.i + 1 LEFT JOIN cells c ON c.pair_id = g.pair_id AND c.j = g.j))
 SELECT p.pair_id, CASE WHEN len(t) = 0 THEN 0 ELSE d / len(t) END AS wer, len(t)::INT AS truth_words, len(r)::INT AS result_words FROM p JOIN grid g ON g.pair_id = p.pair_id AND g.i = len(r) AND g.j = len(t)"""


@query(f"SELECT pair_id, round(recall, 9) AS recall FROM ({_RECALL})")
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = _pairs(spark, sf_dir).select("pair_id", tx.words(tx.normalise_for_eval(F.col("truth"))).alias("truth_words"), tx.words(tx.normalise_for_eval(F.col("result"))).alias("result_words"))
    return metrics.word_recall(norm, "pair_id").select("pair_id", F.round("recall", 9).alias("recall"))


@query(f"SELECT pair_id, round(wer, 9) AS wer, truth_words, result_words FROM ({_WER})")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.text_pairs(_pairs(spark, sf_dir), "pair_id").select("pair_id", F.round("wer", 9).alias("wer"), "truth_words", "result_words")


@query(f"SELECT count(*) AS n, round(avg(recall), 9) AS recall, round(avg(cer), 9) AS cer, round(avg(wer), 9) AS wer FROM ({_RECALL}) JOIN ({_CER}) USING (pair_id) JOIN ({_WER}) USING (pair_id)")
def evaluation_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = metrics.text_pairs(_pairs(spark, sf_dir), "pair_id")
    return metrics.macro_average(scores, "recall", "cer", "wer").select("n", *[F.round(c, 9).alias(c) for c in ("recall", "cer", "wer")])


@query(f"""SELECT pair_id, levenshtein(truth, result)::INT AS distance, round(levenshtein(truth, result) / greatest(length(truth), length(result), 1), 9) AS change FROM ({_single_bytes("truth", "result", _PAIRS)})""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    out = metrics.compare_runs(pairs.select("pair_id", F.col("truth").alias("text")), pairs.select("pair_id", F.col("result").alias("text")), "pair_id")
    return out.select("pair_id", "distance", F.round("change", 9).alias("change"))


@query("""SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3)""")
def missing_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return metrics.missing(turns.where("turn = 0"), turns.where("turn = 3"), "conv_id")


@query("""SELECT doc_id, (floor((k - 1) / 3))::INT AS page, string_agg(line, chr(10) ORDER BY k) AS text FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE k <= 90 GROUP BY 1, 2""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three lines, thirty pages at most: the limit is the feature."""
    lines = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where("k < 90")
    pages = lines.groupBy("doc_id", F.floor(F.col("k") / 3).cast("int").alias("page")).agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("l"))
    return pages.select("doc_id", "page", F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))


@query(r"""SELECT item_id, unnest(l) AS line, unnest(range(0, len(l)))::INT AS k FROM (SELECT item_id, string_split(list_reduce(w, lambda a, x: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 40 THEN a || ' ' || x ELSE a || chr(10) || x END), chr(10)) AS l
 FROM (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0)""")
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tx.wrap(F.col("text"), 40)).alias("k", "line"))


@query("SELECT doc_id, translate(lower(line), '?_', '') AS line, k FROM (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l)))::INT AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select("doc_id", tx.clean_line(F.col("line")).alias("line"), "k")


@query(r"""SELECT page_id, regexp_replace(CASE WHEN strpos(tail, '</body>') > 0 THEN left(tail, strpos(tail, '</body>') - 1) ELSE tail END, '^\s+|\s+$', '', 'g') AS body FROM (
 SELECT page_id, substr(html, strpos(html, '<body>') + 6) AS tail FROM pages WHERE strpos(html, '<body>') > 0)""")
def body_between_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.contains("html", F.lit("<body>")))
    marked = F.regexp_replace("html", "<body>", "<body>\n")
    return pages.select("page_id", tx.body_between(marked, "<body>", "</body>").alias("body"))

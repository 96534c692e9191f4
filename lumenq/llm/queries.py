"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, lm, mixing, quality, secrets, sharding, suffix, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after two edits of every text: new words in its middle, and a new beginning."""
    middle = F.floor(F.length("text") / 2).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("replacement"))
    edits = F.array(edit(middle, middle + 12, " rewritten here "), edit(F.lit(0), F.lit(3), "Title: "))
    return tokens.count(_table(spark, sf_dir, "documents"), edits)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove(_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rule of op4 alone, which SQL can express."""
    found = quality.judge(_table(spark, sf_dir, "documents"), None)
    return found.select("doc_id", *quality.COUNTS, "base_failed")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op10 alone, which SQL can express."""
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_mixing_sources, op3_lm_scoring, op4_quality_rules, op5_benchmark_decontamination,
    op6_token_counts, op7_ngram_jaccard_join, op8_sharding, op9_suffix_array_dedup, op10_secret_scans,
    quality_base_counts, secret_base_spans,
)}

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_SHARE = "SELECT {0} AS v, power(sum(tokens), {1}) / sum(power(sum(tokens), {1})) OVER () AS goal FROM cells GROUP BY 1 HAVING sum(tokens) > 0"

_OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t, len({_WORDS.format("text")}) AS n_tokens FROM documents),
 sized AS (SELECT *, greatest(length(t), 1) AS size, length(t) - length(replace(t, '|', '')) AS bars, length(t) - length(regexp_replace(t, '[#*$%&<>{{}}=]', '', 'g')) AS symbols, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digits FROM d),
 rows AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens = 0 THEN 'none' WHEN bars * 40 > size THEN 'table' WHEN symbols * 12 > size THEN 'symbols' WHEN digits * 8 > size THEN 'numbers' WHEN size < 600 THEN 'short' ELSE 'prose' END AS topic FROM sized),
 cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM rows GROUP BY ALL),
 gs AS ({_SHARE.format("source", mixing.FLATTEN["source"])}), gl AS ({_SHARE.format("lang", mixing.FLATTEN["lang"])}), gt AS ({_SHARE.format("topic", mixing.FLATTEN["topic"])}),
 raked(k, source, lang, topic, tokens, s, l, t, total, now) AS (
  SELECT 0, source, lang, topic, tokens, gs.goal, gl.goal, gt.goal, sum(tokens) OVER (), tokens FROM cells LEFT JOIN gs ON gs.v = source LEFT JOIN gl ON gl.v = lang LEFT JOIN gt ON gt.v = topic
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, s, l, t, total, CASE WHEN have > 0 THEN now * coalesce(CASE k % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END, 0) * total / have ELSE now END
  FROM (SELECT *, sum(now) OVER (PARTITION BY CASE k % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE topic END) AS have FROM raked WHERE k < {3 * mixing.SWEEPS})),
 weights AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN now / tokens ELSE 1 END AS weight FROM raked WHERE k = {3 * mixing.SWEEPS}),
 halved(k, low, high) AS (SELECT 0, 0::DOUBLE, 1e6::DOUBLE UNION ALL SELECT k + 1, CASE WHEN short THEN (low + high) / 2 ELSE low END, CASE WHEN short THEN high ELSE (low + high) / 2 END
  FROM (SELECT *, (SELECT sum(tokens * least(1, (low + high) / 2 * weight)) < {mixing.BUDGET} * sum(tokens) FROM weights) AS short FROM halved WHERE k < 200)),
 worth AS (SELECT w.*, least(1, high * weight) AS p FROM weights w, halved WHERE k = 200)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS probability, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / power(2, 52) < p AS selected
FROM rows JOIN worth USING (source, lang, topic)"""

_OP7 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
 sets AS (SELECT r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {jaccard.SHINGLE - 2}), lambda i: array_to_string(w[i : i + {jaccard.SHINGLE - 1}], ' '))) END AS s FROM d),
 grams AS (SELECT r, unnest(s) AS g FROM sets), sizes AS (SELECT r, len(s) AS n FROM sets),
 links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2) JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE c >= {jaccard.THRESHOLD} * (p.n + q.n - c) - 1e-9),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 classes AS (SELECT a AS r, min(doc_id) AS class_id FROM (SELECT a, b FROM reach UNION SELECT r, r FROM d) JOIN d ON d.r = b GROUP BY 1),
 counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM d JOIN classes USING (r) LEFT JOIN counts USING (r)"""

#: CRC-32 by its table; bytes from the code points.
_OP8 = f"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
 coded AS (SELECT doc_id, coalesce(text, '') AS text, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE WHEN c = '' THEN []::BIGINT[] WHEN ord(c) < 128 THEN [ord(c)]
  WHEN ord(c) < 2048 THEN [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] WHEN ord(c) < 65536 THEN [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)]
  ELSE [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] END)) AS b FROM documents),
 sized AS (SELECT doc_id, octet_length(encode(text)) + {sharding.OVERHEAD} AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM coded, tab),
 placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM sized),
 cut AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM cut"""

_BASE_COUNTS = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
 lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
 grams AS (SELECT r, i, array_to_string(w[i : i + {quality.WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM d)),
 covered AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + {quality.WINDOW})) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM grams) WHERE k > 1) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < {quality.MIN_WORDS} OR 100 * coalesce(c.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(w) AS base_failed FROM d LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)"""

#: A match begins after the pieces between matches and the matches before it.
_BASE_SPANS = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 kinds(kind, name, p) AS (VALUES (0, 'assign', '{secrets.ASSIGN.replace("'", "''")}'), (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+')),
 found AS (SELECT r, kind, name, unnest(regexp_extract_all(t, p)) AS hit, unnest(string_split_regex(t, p)[:-2]) AS gap, unnest(range(1, len(regexp_extract_all(t, p)) + 1)) AS k FROM d, kinds WHERE regexp_matches(t, p)),
 placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY k) AS e FROM found),
 spans AS (SELECT r, kind, name, (e - length(hit))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE CASE kind WHEN 0 THEN length(regexp_replace(hit, '^{secrets.ASSIGN_HEAD.replace("'", "''")}', '')) >= 12 WHEN 1 THEN length(hit) >= 18 ELSE length(hit) >= 16 END),
 per AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS x FROM spans GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN per USING (r)"""

ORACLES = {"quality_base_counts": _BASE_COUNTS, "secret_base_spans": _BASE_SPANS, "op2_mixing_sources": _OP2, "op7_ngram_jaccard_join": _OP7, "op8_sharding": _OP8}

"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three fixed patterns.
Weak candidates (long key material, endpoints) are reported only when the
complementary parts lie in the same scope: a weak secret needs an access
identifier within SCOPE characters, an endpoint needs an access identifier and
a secret. The link is an interval join: each access identifier is filed under
its scope bucket and the two beside it, candidates join on (row, bucket) and
the distance decides. Only parts are shuffled, never texts; places come from a
running sum over the matches of a row, so work grows with their number.

A null text counts as empty. Rows are told apart by a key of their own, so
null, repeated or clashing ids are no matter. Of spans that begin together the
kinds come in the order listed. A weak secret that overlaps an assignment or
an access identifier is that part already. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import saved

#: Fixed values of the base patterns.
ASSIGN_HEAD = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ASSIGN_HIT = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]{12,}"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts and the reach of a scope, in characters.
WEAK_SECRET = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?:https?|s3|ftp)://[A-Za-z0-9][^\x00-\x20"'<>|]{3,}"""
SCOPE = 400
KINDS = {"assign": 0, "access": 1, "hex": 2, "weak_secret": 3, "endpoint": 4}
BASE = ("assign", "access", "hex")
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_MATCH = "array<struct<kind:int,gap:int,size:int>>"


def _matches(text: Column, pattern: str, kind: str, needs: str | None = None, value: bool = False) -> Column:
    """The matches in turn: characters since the one before, and their own.
    ``needs`` is a pattern without which none counts; with ``value`` those whose
    group 2 has under 12 characters are of kind -1 - they count as a gap."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(hits))
    of = F.lit(KINDS[kind])
    kinds = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.when(F.length(v) >= 12, of).otherwise(-1 - of)) if value else F.transform(hits, lambda _: of)
    rows = F.arrays_zip(kinds.alias("kind"), gaps.alias("gap"), F.transform(hits, F.length).alias("size")).cast(_MATCH)
    return F.when(text.rlike(needs or pattern), rows).otherwise(F.array().cast(_MATCH))


def _placed(parts: DataFrame) -> DataFrame:
    """``key, kind, start, end`` of each match: a running sum within its row and pattern."""
    flat = parts.where(F.size("matches") > 0).repartition("key").select("key", F.posexplode("matches").alias("pos", "m"))
    flat = flat.select("key", "pos", "m.*", F.when(F.col("m.kind") < 0, -1 - F.col("m.kind")).otherwise(F.col("m.kind")).alias("pattern"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key", "pattern").orderBy("pos")).cast("int")
    return flat.withColumn("end", end).where("kind >= 0").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _named(spans: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, n in KINDS.items() for x in (n, name)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _apart(a: str, b: str) -> Column:
    """Characters between two spans, 0 if they touch or overlap."""
    return F.greatest(F.col(f"{a}_start") - F.col(f"{b}_end"), F.col(f"{b}_start") - F.col(f"{a}_end"), F.lit(0))


def _kind(spans: DataFrame, name: str, *kinds: str) -> DataFrame:
    return spans.where(F.col("kind").isin([KINDS[k] for k in kinds])).select("key", *[F.col(c).alias(f"{name}_{c}") for c in ("start", "kind", "end")])


def _near(left: DataFrame, name: str, right: DataFrame, other: str, overlapping: bool = False) -> DataFrame:
    """Rows of ``left`` with a row of ``right`` in their scope, or one that overlaps."""
    # a span may be longer than a scope: it is filed under all it touches, and one beside
    buckets = F.sequence((F.col(f"{other}_start") / SCOPE).cast("int") - 1, (F.col(f"{other}_end") / SCOPE).cast("int") + 1)
    filed = right.withColumn("bucket", F.explode(buckets)).withColumnRenamed("key", "other_key")
    spread = left.withColumn("bucket_of", F.explode(F.sequence((F.col(f"{name}_start") / SCOPE).cast("int"), (F.col(f"{name}_end") / SCOPE).cast("int"))))
    near = (F.col(f"{other}_start") < F.col(f"{name}_end")) & (F.col(f"{name}_start") < F.col(f"{other}_end")) if overlapping else _apart(name, other) <= SCOPE
    on = (F.col("key") == F.col("other_key")) & (F.col("bucket_of") == F.col("bucket")) & near
    return spread.join(filed, on, "left_semi").drop("bucket_of").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the counts of the base kinds, the
    base spans, and all spans as sorted arrays of (start, kind number, end)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(_MATCH)
    linking = F.col("text").rlike(ACCESS)  # without an access identifier nothing links
    matches = F.concat(
        _matches(F.col("text"), ASSIGN, "assign", ASSIGN_HIT, value=True), _matches(F.col("text"), ACCESS, "access"), _matches(F.col("text"), HEX, "hex"),
        F.when(linking, _matches(F.col("text"), WEAK_SECRET, "weak_secret")).otherwise(none), F.when(linking, _matches(F.col("text"), ENDPOINT, "endpoint")).otherwise(none),
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", matches.alias("matches"), F.monotonically_increasing_id().alias("key"))
    parts = saved(rows, "parts")
    spans = saved(_placed(parts), "spans")
    access, weak = _kind(spans, "a", "access"), _kind(spans, "s", "weak_secret")
    known = _near(weak, "s", _kind(spans, "b", "assign", "access"), "b", overlapping=True)
    linked = _near(weak.join(known, weak.columns, "left_anti"), "s", access, "a")
    strong = _kind(spans, "s", "assign", "hex").join(access.select("key").distinct(), "key", "left_semi")
    ends = _near(_near(_kind(spans, "e", "endpoint"), "e", access, "a"), "e", linked.unionByName(strong), "s")
    named = lambda frame, name: frame.select("key", *[F.col(f"{name}_{c}").alias(c) for c in ("kind", "start", "end")])
    found = spans.where(F.col("kind").isin([KINDS[k] for k in BASE])).unionByName(named(linked, "s")).unionByName(named(ends, "e"))
    is_base = F.col("kind").isin([KINDS[k] for k in BASE])
    span = F.struct("start", "kind", "end")
    found = found.groupBy("key").agg(
        *[F.count_if(F.col("kind") == KINDS[k]).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"), F.array_sort(F.collect_list(span)).alias("spans"),
    )
    empty = F.array().cast(_SPAN)
    return parts.select("key", "doc_id").join(found, "key", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The spans written out, and the hash of the base ones."""
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))

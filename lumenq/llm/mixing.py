"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked until the
shares of each dimension meet their targets. A row's weight is its cell's
raked total over its own; its probability is the weight times a factor, at
most 1, with the factor solved so that the expected tokens are the budget.
Rows are drawn by a hash of their id, so a draw can be repeated.

Texts are measured in Arrow batches, in one reading for ``mix``: it writes a
narrow table (id, labels, tokens) from which cells are raked and rows are
answered. ``sample`` measures a second time, to let the rows through that are
drawn. Cells are pre-aggregated before the shuffle. Up to CELLS of them are
raked on the driver and broadcast; beyond that the raking and the join are
made with DataFrames on the narrow table, salted because cells are hot, and
``sample`` joins texts by id. Otherwise texts are never shuffled.

Null or missing labels are the value ''. Targets name values and shares;
values without a target keep their share. The share of a target whose value
has no tokens goes to the other targets of its dimension in proportion; if
none of them has tokens, the dimension keeps its shares. Raking ends when no
total moves by more than 1e-9; targets that contradict each other (zeros among
the cells) end after SWEEPS sweeps with a warning that names what is left.
A row without words has no weight of its own but the probability of its cell;
cells without tokens have weight 1. Rows with the same id and cell are drawn
alike; a null id is drawn as ''. Null and empty texts are of topic 'none'. An
empty table gives no rows. Names that begin with ``_lq_`` are ours.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, release, runs, saved, separators, text_bytes

CELLS, SWEEPS, BUDGET, SEED, SALTS = 200_000, 200, 0.8, "mix-1", 64
DIMENSIONS = ("source", "lang", "topic")
#: Exponents that flatten the shares when no targets are given.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOPICS = np.array(["none", "table", "symbols", "numbers", "short", "prose"])


def _classes() -> np.ndarray:
    """Of each byte, one bit each for: in a word, begins a character, bar, symbol, digit."""
    table = (~separators()).astype(np.uint8)
    table[(np.arange(256) & 0xC0) != 0x80] |= 2
    for bit, members in ((4, b"|"), (8, b"#*$%&<>{}="), (16, b"0123456789")):
        table[list(members)] |= bit
    return table


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Topic number and words ``[^ \\t-\\r]+`` of each text. The topic is a
    coarse one, from the form of a text: shares of bars, symbols and digits
    among its characters, and its length."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    topics, words = np.zeros(n, np.int64), np.zeros(n, np.int64)
    table = _classes()
    for i, j in chunks(offsets):
        bits = table[data[offsets[i] : offsets[j]]]
        cuts = offsets[i : j + 1] - offsets[i]
        inside = (bits & 1).astype(bool)
        words[i:j] = np.bincount(runs(inside, cuts)[2], minlength=j - i)
        many = []
        for bit in (2, 4, 8, 16):
            before = np.concatenate([[0], np.cumsum((bits & bit) != 0, dtype=np.int64)])
            many.append(before[cuts[1:]] - before[cuts[:-1]])
        size, bars, symbols, digits = many
        size = np.maximum(size, 1)
        topics[i:j] = np.select([words[i:j] == 0, bars * 40 > size, symbols * 12 > size, digits * 8 > size, size < 600], [0, 1, 2, 3, 4], 5)
    return topics, words


def flattened(totals: dict[str, float], exponent: float) -> dict[str, float]:
    powered = {k: v**exponent for k, v in totals.items() if v > 0}
    return {k: v / sum(powered.values()) for k, v in powered.items()}


def rake(cells: list[tuple], tokens: np.ndarray, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """Raked totals of the cells."""
    now = tokens.astype(float)
    index = []
    for d, name in enumerate(DIMENSIONS):
        values, at = np.unique(np.array([c[d] for c in cells], object), return_inverse=True)
        index.append((at, np.array([targets[name].get(v, 0) for v in values])))
    total, worst = now.sum(), 0.0
    for _ in range(SWEEPS):
        worst = 0.0
        for at, share in index:
            have = np.bincount(at, weights=now, minlength=len(share))
            scale = np.where(have > 0, share * total / np.where(have > 0, have, 1), 1)
            worst = max(worst, np.abs(scale - 1).max())
            now = now * scale[at]
        if worst < 1e-9:
            break
    _warn(worst)
    return now


def _warn(worst: float) -> None:
    if worst > 1e-3:
        warnings.warn(f"the targets are not met: the last sweep still moved a total by {worst:.2g} of itself", stacklevel=3)


def _factor(weight: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """Multiplier that makes the expected tokens the budget's share of all."""
    goal, low, high = budget * tokens.sum(), 0.0, 1.0
    if goal >= tokens[weight > 0].sum():
        return float("inf")
    while (tokens * np.minimum(1, high * weight)).sum() < goal and high < 1e18:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if (tokens * np.minimum(1, middle * weight)).sum() < goal else (low, middle)
    return high


def _rake_frame(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """The same for any number of cells: sums and joins, written after each sweep."""
    spark = cells.sparkSession
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {d: spark.createDataFrame([*targets[d].items(), (None, 0.0)], f"{d} string, share double") for d in DIMENSIONS}
    kept, worst = None, 0.0
    for _ in range(SWEEPS):
        now = now.withColumn("moved", F.lit(0.0))
        for d in DIMENSIONS:
            have = now.groupBy(d).agg(F.sum("raked").alias("have"))
            scale = have.join(goals[d], d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("have")).otherwise(F.lit(1.0)).alias("scale"))
            now = now.join(scale, d).withColumn("raked", F.col("raked") * F.col("scale")).withColumn("moved", F.greatest("moved", F.abs(F.col("scale") - 1))).drop("scale")
        now = saved(now, "raked")
        if kept is not None:
            release(kept)
        kept, worst = now, now.agg(F.max("moved")).first()[0] or 0.0
        if worst < 1e-9:
            break
    _warn(worst)
    now = now.withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(F.lit(1.0)))
    goal, low, high = budget * total, 0.0, float("inf")
    if goal < (now.where("weight > 0").agg(F.sum("tokens")).first()[0] or 0):
        high = 1.0
        expected = lambda f: now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(f) * F.col("weight")))).first()[0]
        while expected(high) < goal and high < 1e18:
            high *= 2
        for _ in range(50):
            middle = (low + high) / 2
            low, high = (middle, high) if expected(middle) < goal else (low, middle)
    probability = F.when(F.col("weight") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if high == float("inf") else F.least(F.lit(1.0), F.lit(high) * F.col("weight"))
    return now.select(*DIMENSIONS, "weight", probability.alias("probability"))


def _goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> dict[str, dict[str, float]]:
    """The share of every value that has tokens, by dimension."""
    goals = {}
    for d in DIMENSIONS:
        # the values of one dimension: as many as there are sources, languages, topics
        own = {r[d]: float(r["n"] or 0) for r in cells.groupBy(d).agg(F.sum("tokens").alias("n")).collect()}
        own = {k: v for k, v in own.items() if v > 0}
        given = (targets or {}).get(d)
        if given is None:
            goals[d] = flattened(own, FLATTEN[d])
            continue
        met = {k: v for k, v in given.items() if k in own and v > 0}
        named, rest = min(1.0, sum(given.values())), {k: v for k, v in own.items() if k not in given}
        if not met and not rest:
            goals[d] = flattened(own, 1.0)
            continue
        for_met = 0.0 if not met else named if rest else 1.0
        goals[d] = {k: v / sum(met.values()) * for_met for k, v in met.items()}
        goals[d] |= {k: v * (1 - for_met) for k, v in flattened(rest, 1.0).items()} if rest else {}
    return goals


def _worth(rows: DataFrame, targets: dict[str, dict[str, float]] | None, budget: float) -> tuple[DataFrame, bool]:
    """``source, lang, topic, weight, probability`` of each cell of the narrow
    rows, and whether they are few enough to be broadcast."""
    cells = saved(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    goals = _goals(cells, targets)
    if cells.count() > CELLS:
        return _rake_frame(cells, goals, budget), False
    found = cells.collect()
    release(cells)
    tokens = np.array([r["tokens"] or 0 for r in found], float)
    names = [tuple(r[d] for d in DIMENSIONS) for r in found]
    raked = rake(names, tokens, goals) if len(found) else tokens
    weight = np.where(tokens > 0, raked / np.where(tokens > 0, tokens, 1), 1.0)
    factor = _factor(weight, tokens, budget)
    p = (weight > 0).astype(float) if np.isinf(factor) else np.minimum(1, factor * weight)
    # at most CELLS rows
    return rows.sparkSession.createDataFrame([(*n, float(w), float(q)) for n, w, q in zip(names, weight, p, strict=True)], "source string, lang string, topic string, weight double, probability double"), True


def _label(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


_MEASURED = "doc_id long, id string, source string, lang string, topic string, tokens long"


def _labelled(docs: DataFrame, id_col: str, text_col: str, source: str, lang: str, topic: Column | None) -> DataFrame:
    """The narrow row of each row: id, labels, tokens."""
    given = F.lit(None).cast("string") if topic is None else _label(topic)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _label(F.col(id_col)).alias("id"), _label(F.col(source)).alias("source"), _label(F.col(lang)).alias("lang"), given.alias("topic"), F.col(text_col).cast("string").alias("text"))
    own = topic is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, tokens = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(TOPICS[topics], pa.string()) if own else batch.column("topic"), pa.array(tokens)], names=["doc_id", "id", "source", "lang", "topic", "tokens"])

    return rows.mapInArrow(run, _MEASURED)


def _with_topic(docs: DataFrame, text_col: str, topic: Column | None) -> DataFrame:
    """The whole rows with a last column ``_lq_topic``."""
    if topic is not None:
        return docs.withColumn("_lq_topic", _label(topic))
    rows = docs.withColumn("_lq_topic", F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, _ = measure(batch.columns[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(TOPICS[topics], pa.string())], names=[*batch.schema.names, "_lq_topic"])

    return docs.mapInArrow(run, rows.schema)


def _joined(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Narrow rows with the weight and probability of their cells."""
    if small:
        return rows.join(F.broadcast(table), [*DIMENSIONS])
    salted = table.withColumn("_lq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_lq_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*DIMENSIONS, "_lq_salt"]).drop("_lq_salt")


def drawn(id_: Column, probability: Column, seed: str = SEED) -> Column:
    """Whether a row with this id (as text) is drawn."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52)) < probability


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, selected`` of each row."""
    rows = saved(_labelled(docs, id_col, text_col, source, lang, topic), "measured")
    found = _joined(rows, *_worth(rows, targets, budget))
    return found.select("doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), "weight", "probability", drawn(F.col("id"), F.col("probability")).alias("selected"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, id_col: str = "doc_id", source: str = "source", lang: str = "lang", topic: Column | None = None, text_col: str = "text") -> DataFrame:
    """The rows drawn, with the columns they came with."""
    labelled = _labelled(docs, id_col, text_col, source, lang, topic)
    table, small = _worth(labelled, targets, budget)
    rows = _with_topic(docs, text_col, topic).withColumn("_lq_id", _label(F.col(id_col))).withColumn("_lq_source", _label(F.col(source))).withColumn("_lq_lang", _label(F.col(lang)))
    if small:
        named = table.select(*[F.col(d).alias(f"_lq_{d}") for d in DIMENSIONS], F.col("probability").alias("_lq_p"))
        kept = rows.join(F.broadcast(named), [f"_lq_{d}" for d in DIMENSIONS]).where(drawn(F.col("_lq_id"), F.col("_lq_p")))
    else:
        chosen = _joined(labelled, table, small).where(drawn(F.col("id"), F.col("probability"))).select(*[F.col(c).alias(f"_lq_{c}") for c in ("id", *DIMENSIONS)]).distinct()
        kept = rows.join(chosen, chosen.columns, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

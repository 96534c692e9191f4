"""Splits, scaling, labels and classifiers over feature arrays.

Classifiers are ``pyspark.ml`` pipelines over ``array<float>`` features with a
common shape: ``label, features`` in, candidate arrays out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import candidates as cd


def hash_order(*columns: Column, seed: str = "42") -> Column:
    """A reproducible random order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in columns]))


def _places(rows: DataFrame, label: str, id_col: str) -> DataFrame:
    """``rows`` with ``_place`` (from 1, in hash order) and ``_total`` of their label.
    A label is ranked in parts by the first digits of the hash, so no task ranks
    a whole one; the parts' sizes give where each begins."""
    hashed = rows.withColumn("_hash", hash_order(F.col(id_col))).withColumn("_part", F.substring("_hash", 1, 3))
    mine = Window.partitionBy("_label")
    parts = hashed.groupBy(F.col(label).alias("_label"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))  # 4096 rows a label
    parts = parts.select("_label", "_of", (F.sum("_n").over(mine.orderBy("_of")) - F.col("_n")).alias("_before"), F.sum("_n").over(mine).alias("_total"))
    both = hashed.join(parts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_hash", id_col)) + F.col("_before")
    return both.withColumn("_place", place).drop("_hash", "_part", "_label", "_of", "_before")


def stratified_split(rows: DataFrame, label: str, id_col: str, share: float) -> DataFrame:
    """``held_out``: in each label the first ``share`` of the rows in hash order."""
    placed = _places(rows, label, id_col)
    return placed.withColumn("held_out", F.col("_place") <= F.floor(F.col("_total") * share + 0.5)).drop("_place", "_total")


def stratified_folds(rows: DataFrame, label: str, id_col: str, k: int) -> DataFrame:
    """``fold`` 0 .. k - 1, dealt out in turn within each label."""
    return _places(rows, label, id_col).withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_place", "_total")


def folds_possible(rows: DataFrame, label: str, most: int = 5) -> int:
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return min(most, least)


def scaling(rows: DataFrame, features: str = "features") -> DataFrame:
    """``dim, mean, sd`` with the population deviation, 1 where it is 0."""
    flat = rows.select(F.posexplode(features).alias("dim", "v"))
    sd = F.stddev_pop("v")
    return flat.groupBy("dim").agg(F.avg("v").alias("mean"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("sd"))


def standardised(rows: DataFrame, scale: DataFrame, features: str = "features") -> DataFrame:
    """Feature arrays scaled; the scale has one row per dimension and travels as arrays."""
    packed = scale.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "sd"))).alias("_s"))
    both = rows.crossJoin(F.broadcast(packed))  # one row
    return both.withColumn(features, F.zip_with(features, "_s", lambda v, s: (v - s["mean"]) / s["sd"])).drop("_s")


def label_codes(rows: DataFrame, label: str) -> DataFrame:
    """``label, code``: sorted labels numbered from 0."""
    distinct = rows.select(label).distinct()
    return distinct.withColumn("code", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)  # as many rows as labels


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: rows over (labels times the label's rows)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    table = counts.crossJoin(F.broadcast(whole)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return rows.join(F.broadcast(table), label)


def centroids(rows: DataFrame, label: str, features: str = "features") -> DataFrame:
    flat = rows.select(label, F.posexplode(features).alias("dim", "v")).groupBy(label, "dim").agg(F.avg("v").alias("m"))
    return flat.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))


def distances(rows: DataFrame, id_col: str, centres: DataFrame, label: str, features: str = "features") -> DataFrame:
    """``id, label, distance`` (squared) to each centroid: as many as classes."""
    both = rows.select(id_col, features).crossJoin(F.broadcast(centres.select(label, "centroid")))
    return both.select(id_col, label, F.aggregate(F.zip_with(features, "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("distance"))


class KernelFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: their products are near a Gaussian kernel whose
    gamma is one over the number of (scaled) dimensions."""

    size = Param(Params._dummy(), "size", "features made", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, size=256, seed=42):
        super().__init__()
        self._setDefault(size=256, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, rows: DataFrame) -> DataFrame:
        size, seed = self.getOrDefault("size"), self.getOrDefault("seed")

        @F.pandas_udf("array<double>")
        def run(values: pd.Series) -> pd.Series:
            x = np.stack(values.to_numpy())
            rng = np.random.default_rng(seed)
            directions = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], size))
            return pd.Series(list(np.cos(x @ directions + rng.uniform(0, 2 * np.pi, size)) * np.sqrt(2 / size)))

        return rows.withColumn(self.getOutputCol(), array_to_vector(run(vector_to_array(self.getInputCol()))))


def _kernel_svm() -> Pipeline:
    """Scaled values, kernel features, one margin a class, and probabilities from the margins."""
    return Pipeline(stages=[
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True), KernelFeatures(inputCol="scaled", outputCol="mapped"),
        OneVsRest(classifier=LinearSVC(maxIter=15, regParam=1e-3), featuresCol="mapped", labelCol="code", predictionCol="nearest"),
        LogisticRegression(featuresCol="rawPrediction", labelCol="code", rawPredictionCol="logits", regParam=1e-3),
    ])


CLASSIFIERS = {
    "svm": _kernel_svm,
    "rf": lambda: RandomForestClassifier(numTrees=50, maxDepth=10, seed=42, featuresCol="vector", labelCol="code"),
    "lr": lambda: LogisticRegression(maxIter=50, regParam=1e-3, featuresCol="vector", labelCol="code"),
}


def get_classifier(name: str, layers: list[int] | None = None):
    """An estimator by name; a perceptron (``cnn``) needs its layers."""
    if name == "cnn":
        return MultilayerPerceptronClassifier(layers=layers, maxIter=60, seed=42, featuresCol="vector", labelCol="code")
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier {name!r}; known: cnn, {', '.join(CLASSIFIERS)}")
    return CLASSIFIERS[name]()


class Classifier:
    """Train, predict, save and load; labels are strings, features arrays."""

    def __init__(self, name: str, hidden: int = 64):
        self.name, self.hidden, self.model = name, hidden, None

    def train(self, rows: DataFrame, label: str = "label", features: str = "features") -> Classifier:
        rows = rows.select(F.col(label).cast("string").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("vector")).persist()  # read again in every iteration
        indexer = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc", handleInvalid="skip")
        layers = None
        if self.name == "cnn":
            layers = [rows.first()["vector"].size, self.hidden, rows.select("label").distinct().count()]
        fitted = indexer.fit(rows)
        names = IndexToString(inputCol="prediction", outputCol="predicted", labels=fitted.labels)
        model = get_classifier(self.name, layers).fit(fitted.transform(rows))
        self.labels, self.model = fitted.labels, PipelineModel([model, names])
        rows.unpersist()
        return self

    def scores(self, rows: DataFrame, features: str = "features") -> DataFrame:
        out = self.model.transform(rows.withColumn("vector", array_to_vector(F.col(features).cast("array<double>"))))
        raw = "probability" if "probability" in out.columns else "rawPrediction"
        scores = vector_to_array(raw)
        if raw == "rawPrediction":
            scores = cd.softmax(scores)  # margins, made to sum to one
        return out.withColumn("_scores", scores).drop("vector", "rawPrediction", "probability", "prediction", "scaled", "mapped", "nearest", "logits")

    def predict(self, rows: DataFrame, features: str = "features", k: int = 15) -> DataFrame:
        """``rows`` with ``predicted`` and ``cands``, the k likeliest."""
        names = F.array(*[F.lit(x) for x in self.labels])
        return self.scores(rows, features).withColumn("cands", cd.top_k(names, F.col("_scores"), k)).drop("_scores")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> Classifier:
        self.model = PipelineModel.load(path)
        self.labels = self.model.stages[-1].getLabels()
        return self


def calibrated(scores: DataFrame, margin: str, label: str) -> PipelineModel:
    """A sigmoid over a margin, fitted on (margin, 0/1 label)."""
    rows = scores.select(array_to_vector(F.array(F.col(margin).cast("double"))).alias("vector"), F.col(label).cast("double").alias("code"))
    return Pipeline(stages=[LogisticRegression(featuresCol="vector", labelCol="code", regParam=1e-6)]).fit(rows)


def cross_validated(rows: DataFrame, name: str, label: str, id_col: str, k: int, features: str = "features") -> DataFrame:
    """``id, label, predicted`` of every row from the model of the other folds."""
    folded = stratified_folds(rows, label, id_col, k)
    out = None
    for fold in range(k):
        model = Classifier(name).train(folded.where(F.col("fold") != fold), label, features)
        part = model.predict(folded.where(F.col("fold") == fold), features).select(id_col, label, "predicted")
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(scored: DataFrame, order: list[str], most: int = 1500, least: float = 0.5) -> DataFrame:
    """The first ``most`` windows, in reading order, that a model takes for positives: a limit that is the feature."""
    return scored.where(F.col("score") >= least).orderBy(*order).limit(most)


def windows(images: DataFrame, size: int = 96, stride: int = 32) -> DataFrame:
    """``y, x`` of every window of each image (h, w)."""
    steps = lambda c: F.sequence(F.lit(0), F.col(c) - size, F.lit(stride))
    large = images.where((F.col("h") >= size) & (F.col("w") >= size))
    return large.withColumn("y", F.explode(steps("h"))).withColumn("x", F.explode(steps("w")))


def random_windows(images: DataFrame, id_col: str, n: int = 4, size: int = 96, seed: int = 42) -> DataFrame:
    """n windows of each image at hashed places."""
    spot = lambda c, s: F.pmod(F.xxhash64(F.lit(seed), F.lit(s), id_col, "k"), F.col(c) - size + 1).cast("int")
    large = images.where((F.col("h") >= size) & (F.col("w") >= size)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return large.withColumn("x", spot("w", 1)).withColumn("y", spot("h", 2))


def reranker_rows(rows: DataFrame, id_col: str, label: str, labels: list[str], negatives: int = 4) -> DataFrame:
    """One positive and ``negatives`` other labels, in hash order, of each row: ``id, candidate, target``."""
    others = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: x != F.col(label))
    mixed = F.transform(F.array_sort(F.transform(others, lambda x: F.struct(F.md5(F.concat(x, F.col(id_col).cast("string"))).alias("k"), x.alias("x")))), lambda s: s["x"])
    return rows.select("*", F.explode(F.concat(F.array(F.col(label)), F.slice(mixed, 1, negatives))).alias("candidate")).withColumn("target", (F.col("candidate") == F.col(label)).cast("int"))


def clusters(rows: DataFrame, k: int, features: str = "features", seed: int = 0) -> DataFrame:
    fitted = KMeans(k=k, seed=seed, featuresCol="vector").fit(rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("vector")))
    return fitted.transform(rows.withColumn("vector", array_to_vector(F.col(features).cast("array<double>")))).drop("vector").withColumnRenamed("prediction", "cluster")

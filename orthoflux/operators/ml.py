"""Pixel classification: features, random forest, probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.classification import RandomForestClassifier as SparkForest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indices as X
from ..grid import GridMeta
from ..scratch import scratch
from ..sources.files import read_file, write_file
from . import forest
from .joins import training_patch
from .stencil import gradient, sobel, variance3

# fixed values: the order of the reference's features
FEATURES7 = ("R", "G", "B", "H", "S", "V", "ExG")
FEATURES14 = (*FEATURES7, "ExR", "ExB", "ExGR", "Variance", "Sobel", "MDS", "Slope")


def pixel_features(pixels: DataFrame, res: float = 1.0, full: bool = True, mds: str = "mds") -> DataFrame:
    """Pixels with the 7 or 14 feature columns; stencils run on the dense table, before any mask."""
    h, s, v = X.hsv8()
    named = {"R": F.col("r").cast("double"), "G": F.col("g").cast("double"), "B": F.col("b").cast("double"), "H": h.cast("double"), "S": s.cast("double"), "V": v.cast("double"), "ExG": X.exg()}
    if full:
        named |= {"ExR": X.exr(), "ExB": X.exb(), "ExGR": X.exgr(), "__g": X.gray().cast("double")}
    keep = [c for c in pixels.columns if c not in ("r", "g", "b")]
    out = pixels.select(*keep, *[e.alias(n) for n, e in named.items()])
    if full:
        out = gradient(sobel(variance3(out, "__g", "Variance"), "__g"), mds, res)
        extra = {"Sobel": F.col("sobel"), "MDS": F.col(mds).cast("double"), "Slope": X.slope_percent(F.col("d_row"), F.col("d_col"))}
        have = [c for c in FEATURES14 if c not in extra]
        out = out.select(*[c for c in keep if c != mds], *have, *[e.alias(n) for n, e in extra.items()])
    return out


def training_features(points: DataFrame, features: DataFrame, grid: GridMeta, buffer_m: float) -> DataFrame:
    """Feature rows of the pixels around labelled points."""
    return training_patch(points, features, grid, grid.buffer_px(buffer_m))


#: Rows up to which trees are grown whole, one a task: every worker holds the table, a byte a feature.
FIT_ROWS = 1 << 22
#: Pixels that pass through all trees at once.
JUDGED = 1 << 18


@dataclass(frozen=True)
class Forest:
    """Trees in files of the shared folder, the ends of the features' bins, and what the trees say of the features."""

    uri: str
    trees: int
    ends: list[np.ndarray]
    numClasses: int  # noqa: N815  as in MLlib's model
    featureImportances: np.ndarray  # noqa: N815


class RandomForestClassifier(SparkForest):
    """MLlib's parameters and rules with trees grown whole, one a task, over 8-bit features that every worker holds.

    MLlib grows all trees together, one pass over the table for as many nodes as fit its memory; deep trees on labels
    that do not part well have millions of nodes.  Beyond ``FIT_ROWS`` rows, 255 features, 256 bins or 16 classes MLlib fits.
    """

    def fit(self, dataset: DataFrame, params=None) -> Forest | RandomForestClassificationModel:
        spark, label, bins = dataset.sparkSession, self.getLabelCol(), self.getMaxBins()
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(label).cast("double").alias("y"))
        told = rows.mapInArrow(_told, "feature int, v binary, w binary, n long, top int").collect()
        n, n_classes = sum(r.n for r in told if r.feature == 0), max((r.top for r in told), default=0) + 1
        width = max((r.feature for r in told), default=-1) + 1
        if not 0 < n <= FIT_ROWS or width > 254 or bins > 256 or n_classes > 16:
            return super().fit(dataset, params)
        ends = []
        for i in range(width):
            own = [r for r in told if r.feature == i]
            ends.append(forest.cuts(*(np.concatenate([np.frombuffer(r[c]) for r in own]) for c in ("v", "w")), bins))
        parts = rows.mapInArrow(_binned(ends), "x binary, y binary").collect()
        x = np.concatenate([np.frombuffer(r.x, np.uint8) for r in parts]).reshape(-1, width)
        held = spark.sparkContext.broadcast(forest.in_order(x, np.concatenate([np.frombuffer(r.y, np.uint8) for r in parts])))
        n_trees, depth, seed, n_features = self.getNumTrees(), self.getMaxDepth(), self.getSeed(), max(1, math.ceil(math.sqrt(width)))
        uri = scratch(spark, "forest")

        def run(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    nodes, leaves, share = forest.grow(*held.value, n_classes, depth, n_features, (seed, k))
                    write_file(f"{uri}/{k}", forest.to_bytes(nodes, leaves))
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([share.tobytes()], pa.binary())], names=["k", "share"])

        grown = sorted(spark.range(0, n_trees, 1, n_trees).mapInArrow(run, "k long, share binary").collect())
        held.unpersist()
        share = np.sum([np.frombuffer(r.share) for r in grown], axis=0)
        return Forest(uri, n_trees, ends, n_classes, share / share.sum() if share.sum() > 0 else share)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _told(batches):
    """Distinct values of each feature with their counts, or quantiles, a row a feature for each partition."""
    have: list[tuple[np.ndarray, np.ndarray]] = []
    n, top = 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            have = have or [(np.zeros(0), np.zeros(0))] * x.shape[1]
            both = [(np.r_[v, c], np.r_[w, np.ones(len(c))]) for (v, w), c in zip(have, x.T, strict=True)]
            have = [forest.summary(v, w, 64 * forest.TOLD) for v, w in both]
            y = batch.column(1).to_numpy(zero_copy_only=False)
            n, top = n + len(x), max(top, int(y.max()) if (y == np.floor(np.clip(y, 0, 254))).all() else 255)  # no class: MLlib says what is wrong
    for i, (v, w) in enumerate(have):
        v, w = forest.summary(v, w, forest.TOLD)
        values = [pa.array([i], pa.int32()), pa.array([v.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([n]), pa.array([top], pa.int32())]
        yield pa.RecordBatch.from_arrays(values, names=["feature", "v", "w", "n", "top"])


def _binned(ends: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = forest.binned(list(_matrix(batch.column(0)).T), ends), batch.column(1).to_numpy().astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    return run


def fit_forest(rows: DataFrame, features: tuple[str, ...], label: str = "label", trees: int = 250, depth: int = 25, seed: int = 42) -> Forest | RandomForestClassificationModel:
    """A Gini forest with square-root feature choice; 8-bit features get a bin each.

    A training table in fewer partitions than there are cores is dealt anew: where MLlib fits, every level
    of the trees is a pass over it, and one small file would keep one core busy.
    """
    vec = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if vec.rdd.getNumPartitions() < cores:
        vec = vec.repartition(cores)
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, maxBins=256, featureSubsetStrategy="sqrt", seed=seed, subsamplingRate=1.0, cacheNodeIds=True).fit(vec.select("features", label))


def _judge(model: Forest, features: tuple[str, ...], schema: T.StructType):
    """Rows with shares and prediction; as many rows as ``JUDGED`` pass through a tree before the next is read."""
    names, uri, n_classes, ends, trees = schema.names, model.uri, model.numClasses, model.ends, model.trees
    places = [names.index(f) for f in features]

    def judged(held: list[pa.RecordBatch]):
        cols = [[pa.Array.to_numpy(b.column(i).cast(pa.float64()), zero_copy_only=False) for b in held] for i in places]
        cols = [np.concatenate(c) for c in cols]
        gap = np.isnan(cols).any(axis=0)
        x = forest.binned([c[~gap] for c in cols], ends)
        total = np.zeros((len(x), n_classes))
        for k in range(trees if len(x) else 0):
            forest.add_shares(read_file(f"{uri}/{k}"), x, total)
        out, best = np.zeros((len(gap), n_classes)), np.zeros(len(gap), np.int32)
        out[~gap], best[~gap] = total / trees, total.argmax(axis=1)
        at = 0
        for b in held:
            own = slice(at, at + b.num_rows)
            at += b.num_rows
            added = [pa.array(v[own], mask=gap[own]) for v in (*(np.ascontiguousarray(c) for c in out.T), best)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*names, *(f"p{i}" for i in range(n_classes)), "prediction"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= JUDGED:
                yield from judged(held)
                held = []
        if held:
            yield from judged(held)

    return run


def predict(model: Forest | RandomForestClassificationModel, rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``p0``, ``p1``, ... (mean leaf shares) and ``prediction``; null where a feature is null or NaN, so no pixel is lost."""
    if isinstance(model, Forest):
        added = [T.StructField(f"p{i}", T.DoubleType()) for i in range(model.numClasses)] + [T.StructField("prediction", T.IntegerType())]
        return rows.mapInArrow(_judge(model, features, rows.schema), T.StructType([*rows.schema.fields, *added]))
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull() & ~F.isnan(f)
    filled = rows.withColumn("__whole", whole).withColumns({f"__f{i}": F.when(F.col("__whole"), F.col(f)).otherwise(0.0) for i, f in enumerate(features)})
    vec = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="features").transform(filled)
    out = model.transform(vec).withColumn("__p", vector_to_array("probability"))
    known = lambda c: F.when(F.col("__whole"), c)
    probs = [known(F.col("__p")[i]).alias(f"p{i}") for i in range(model.numClasses)]
    return out.select(*rows.columns, *probs, known(F.col("prediction").cast("int")).alias("prediction"))


def importances(model: Forest | RandomForestClassificationModel, features: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """``(feature, importance)`` in falling order."""
    spark = rows.sparkSession
    return spark.createDataFrame([(f, float(model.featureImportances[i])) for i, f in enumerate(features)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

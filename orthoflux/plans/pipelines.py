"""The end-to-end runs: terrain model from classified pixels, and watershed crowns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indices as X
from ..grid import GridMeta
from ..operators.components import group_filter, label_components
from ..operators.interp import InterpolationConfig, interpolate
from ..operators.joins import raster_at_points, stamp_markers
from ..operators.masks import by_confidence, usable, valid_alpha
from ..operators.ml import FEATURES7, FEATURES14, fit_forest, importances, pixel_features, predict, training_features
from ..operators.sampling import split
from ..operators.segment import swap_if_inverted, watershed
from ..operators.stats import accuracy, classification_report
from ..operators.stencil import opened
from ..runlog import RunLog
from ..scratch import materialize


@dataclass(frozen=True)
class TerrainConfig:
    """Options of ``terrain_run``; confidence below (or above) which a pixel is taken as ground."""

    buffer_m: float = 0.85
    trees: int = 250
    depth: int = 25
    all_features: bool = True
    holdout: float = 0.2  # share of the training rows that is kept for the report
    confidence: float = 0.00005
    direction: str = "below"
    reach_px: float = 1.5
    min_group_px: float = 50  # dissolved area in pixels
    open_probability: bool = False
    terrain: InterpolationConfig = field(default_factory=lambda: InterpolationConfig(method="idw", resolution=0.5, idw_k_neighbors=24, idw_smooth_sigma=1.5))


def terrain_run(pixels: DataFrame, points: DataFrame, grid: GridMeta, cfg: TerrainConfig, surface: DataFrame | None = None, surface_grid: GridMeta | None = None, log: RunLog | None = None) -> dict[str, DataFrame]:
    """features -> forest -> probabilities -> confident points -> group filter -> height -> terrain.

    The surface model is met by world coordinate (its grid may differ); tables are
    written at the forest and at the probabilities, the rest is one lazy plan.  A share
    of the training pixels is held out by hash of their id (all rows of a pixel together),
    for ``report`` and ``accuracy``; ``importances`` ranks the features.  ``log`` is told
    rows and times of the steps that write.
    """
    log = log or RunLog()
    names = FEATURES14 if cfg.all_features else FEATURES7
    with log.step("features") as step:
        feats = step.wrote(materialize(pixel_features(pixels, abs(grid.a), cfg.all_features), "features"))
    with log.step("training rows") as step:
        rows = step.wrote(materialize(training_features(points, feats, grid, cfg.buffer_m), "training-rows"))
    with log.step("forest") as step:
        parted = split(rows, "id", cfg.holdout)
        model = fit_forest(parted.where("split = 'train'"), names, trees=cfg.trees, depth=cfg.depth)
    judged = predict(model, parted.where("split = 'test'"), names).select("label", "prediction")
    with log.step("probability") as step:
        found = predict(model, feats, names).select("prow", "pcol", "a", "id", F.col("p0").alias("p_soil"), F.col("p1").alias("p_tree"))
        prob = step.wrote(materialize(found, "probability"))
    if cfg.open_probability:
        prob = opened(prob, "p_soil", "p_soil_open").drop("p_soil").withColumnRenamed("p_soil_open", "p_soil")
    dim = prob.sparkSession.createDataFrame([("soil", cfg.confidence)], "class string, confidence double")
    picked = by_confidence(prob, dim, {"soil": "p_soil"}, valid_alpha(), cfg.direction).select("prow", "pcol", "id", "p")
    grouped = group_filter(picked, cfg.min_group_px, cfg.reach_px)
    x, y = grid.pixel_to_world(F.col("prow"), F.col("pcol"))
    located = grouped.select(F.col("id").alias("pid"), x.alias("x"), y.alias("y"), "p")
    if surface is None:
        surface, surface_grid = pixels.select("prow", "pcol", F.col("mds").alias("z")), grid
    with log.step("heights") as step:
        found = raster_at_points(located, surface, surface_grid).where(usable("z")).select("pid", "x", "y", "z", "p")
        heights = step.wrote(materialize(found, "heights"))
    return {
        "probability": prob,
        "points": heights,
        "terrain": interpolate(heights, cfg.terrain),
        "report": classification_report(judged, "label", "prediction"),
        "accuracy": accuracy(judged.where("prediction IS NOT NULL"), "label", "prediction"),
        "importances": importances(model, names, rows),
    }


def crowns_run(prob: DataFrame, tree_points: DataFrame, soil_points: DataFrame, grid: GridMeta) -> dict[str, DataFrame]:
    """Probabilities -> orientation check -> markers -> watershed -> polygons' areas.

    Tree markers keep their id, soil markers come after all tree ids; areas are in
    square units, converted once.
    """
    top = tree_points.agg(F.max("pid")).first()[0] or 0
    right = swap_if_inverted(prob, tree_points, grid)
    marked = stamp_markers(right, tree_points.select(F.col("pid").alias("m"), "x", "y").unionByName(soil_points.select((F.col("pid") + top + 1).alias("m"), "x", "y")), grid, "m")
    cost = X.cost_two_class(F.col("p_tree"), F.col("p_soil"))
    labels = watershed(marked.select("prow", "pcol", cost.alias("cost"), "marker", ((F.col("p_tree") > 0.3) | (F.col("p_soil") > 0.3)).alias("mask")))
    ids = labels.where("label > 0").withColumn("id", F.col("prow") * grid.width + F.col("pcol"))
    parts = label_components(ids.select("prow", "pcol", "id", "label"), "id", eight=False, value="label")
    area = X.px_to_m2(F.count(F.lit(1)), abs(grid.a))
    polygons = parts.groupBy("label", "component").agg(area.alias("area_m2")).where("area_m2 >= 5").withColumn("class", F.when(F.col("label") <= top, "tree").otherwise("soil"))
    return {"labels": labels, "polygons": polygons, "areas": polygons.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("area_m2").alias("total_m2"), X.m2_to_ha(F.sum("area_m2")).alias("total_ha"))}

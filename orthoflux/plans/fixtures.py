"""Rasters, points and polygons derived from the test tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grid import GridMeta

WIDTH = 125


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense raster of 125 columns, four 8-bit bands and a surface model."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.floor(k / 125).cast("long").alias("prow"), (k % 125).alias("pcol"), (F.col("o_custkey") % 256).cast("int").alias("r"), (F.floor("o_totalprice") % 256).cast("int").alias("g"),
        ((k * 7919) % 256).cast("int").alias("b"), F.when(F.col("o_orderstatus") == "P", 0).otherwise(255).alias("a"), (F.col("o_totalprice") / 1000.0).alias("mds"), k.alias("id"),
    )


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in about 200 x 206 units."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("pid"), ((k * 37) % 997 / 5.0).alias("x"), ((k * 61) % 1031 / 5.0).alias("y"), F.col("c_acctbal").alias("z"), F.col("c_mktsegment").alias("seg"))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training points with a class: two market segments are forest."""
    forest = F.col("seg").isin("BUILDING", "MACHINERY")
    return pts(spark, sf_dir).withColumns({"class": F.when(forest, "forest").otherwise("soil"), "label": F.when(forest, 1).otherwise(0)})


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px with two probabilities that sum to one."""
    p = (F.col("id") * 37) % 1001 / 1000.0
    return px(spark, sf_dir).withColumn("p_tree", p).withColumn("p_soil", F.lit(1.0) - F.col("p_tree"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("forest", 1, None, None), ("soil", 0, 0.25, "soil")], "class string, label int, confidence double, las_suffix string")


def poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of side 1 + pid % 40 around the points; every third has a square hole of half the side."""
    s = (F.lit(1.0) + F.col("pid") % 40).alias("side")

    def square(x, y, side):
        h = side / 2.0
        corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
        return F.array(corner(-h, -h), corner(h, -h), corner(h, h), corner(-h, h), corner(-h, -h))

    base = pts(spark, sf_dir).select(F.col("pid").alias("gid"), "x", "y", s)
    outer, hole = square(F.col("x"), F.col("y"), F.col("side")), square(F.col("x"), F.col("y"), F.col("side") / 2.0)
    return base.select("gid", "x", "y", "side", F.when(F.col("gid") % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer)).alias("rings"))


def meta(rows: int) -> GridMeta:
    """The raster's grid: pixels of 2 units, north-west corner at (0, 2 * rows)."""
    return GridMeta(2.0, 0.0, -2.0, 2.0 * rows, WIDTH, rows)


def rows_of(spark: SparkSession, sf_dir: str) -> int:
    """Raster rows: a count over one column's statistics."""
    return table(spark, sf_dir, "orders").count() // WIDTH


CTE = {
    "px": """px AS (SELECT CAST(floor(o_orderkey / 125e0) AS BIGINT) AS prow, o_orderkey % 125 AS pcol, CAST(o_custkey % 256 AS INTEGER) AS r,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS g, CAST((o_orderkey * 7919) % 256 AS INTEGER) AS b,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 255 END AS a, o_totalprice / 1000e0 AS mds, o_orderkey AS id FROM orders)""",
    "pts": "pts AS (SELECT c_custkey AS pid, ((c_custkey * 37) % 997) / 5e0 AS x, ((c_custkey * 61) % 1031) / 5e0 AS y, c_acctbal AS z, c_mktsegment AS seg FROM customer)",
    "train": "train AS (SELECT *, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'forest' ELSE 'soil' END AS class, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS label FROM pts)",
    "prob": "prob AS (SELECT *, ((id * 37) % 1001) / 1000e0 AS p_tree, 1e0 - ((id * 37) % 1001) / 1000e0 AS p_soil FROM px)",
    "cls": "cls AS (SELECT * FROM (VALUES ('forest', 1, CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR)), ('soil', 0, 0.25e0, 'soil')) t(class, label, confidence, las_suffix))",
    "grd": "grd AS (SELECT count(*) // 125 AS nrows, 2e0 * (count(*) // 125) AS f FROM orders)",
    "poly": "poly AS (SELECT pid AS gid, x, y, 1e0 + pid % 40 AS side, CASE WHEN pid % 3 = 0 THEN 1 ELSE 0 END AS holes FROM pts)",
    "norm": """norm AS (SELECT *, CASE WHEN r + g + b = 0 THEN 1e0 ELSE CAST(r + g + b AS DOUBLE) END AS s,
  CAST(r AS DOUBLE) / CASE WHEN r + g + b = 0 THEN 1e0 ELSE CAST(r + g + b AS DOUBLE) END AS rn, CAST(g AS DOUBLE) / CASE WHEN r + g + b = 0 THEN 1e0 ELSE CAST(r + g + b AS DOUBLE) END AS gn,
  CAST(b AS DOUBLE) / CASE WHEN r + g + b = 0 THEN 1e0 ELSE CAST(r + g + b AS DOUBLE) END AS bn FROM px)""",
}
NEEDS = {"train": ["pts"], "prob": ["px"], "poly": ["pts"], "norm": ["px"]}


def sql(body: str, *ctes: str) -> str:
    """A query over the named fixtures; ``ctes`` may also hold further CTE texts."""
    order: list[str] = []

    def add(name):
        for n in NEEDS.get(name, ()):
            add(n)
        text = CTE.get(name, name)
        if text not in order:
            order.append(text)

    for c in ctes:
        add(c)
    return f"WITH {', '.join(order)} {body}" if order else body

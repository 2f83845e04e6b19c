"""The streamed look-up gives what the batch look-up gives."""

from orthoflux.operators.joins import raster_at_points
from orthoflux.plans import fixtures as fx
from orthoflux.streaming.heights import start


def test_heights(spark, sf_dir, tmp_path):
    pts = fx.pts(spark, sf_dir).select("pid", "x", "y")
    pts.repartition(3).write.parquet(f"{tmp_path}/in")
    grid, surface = fx.meta(fx.rows_of(spark, sf_dir)), fx.px(spark, sf_dir).withColumnRenamed("mds", "z")
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = start(stream, surface, grid, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("pid", "z").collect())
    assert got == sorted(tuple(r) for r in raster_at_points(pts, surface.select("prow", "pcol", "z"), grid).select("pid", "z").collect())

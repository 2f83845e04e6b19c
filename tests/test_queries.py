"""Every registered query with SQL gives what DuckDB gives; the others run and keep their invariants."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from orthoflux.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).fetch_df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=False, atol=2e-6, rtol=1e-9)


def surface(df):
    p = df.toPandas().dropna()
    return p, np.sqrt(np.mean((p.value - 100 * np.sin(p.x / 200) * np.cos(p.y / 200)) ** 2))


@pytest.mark.parametrize(("name", "cells", "rmse"), [("i4_kriging", 400, 6), ("i5_kriging_universal", 400, 6), ("i7_rbf", 400, 3), ("i8_linear", 340, 3), ("i10_spline", 400, 3)])
def test_surface(spark, sf_dir, name, cells, rmse):
    p, e = surface(QUERIES[name](spark, sf_dir))
    assert len(p) >= cells and e < rmse


@pytest.mark.parametrize("name", ["i4_kriging_points", "i5_kriging_universal_points", "i7_rbf_points", "i8_linear_points", "i10_spline_points"])
def test_methods_read_the_table(spark, sf_dir, duck, tmp_path, name):
    """Ten times the heights of the table give ten times the values (linear in z), and every cell is one of the grid."""
    duck.execute(f"COPY (SELECT * REPLACE (c_acctbal * 10 AS c_acctbal) FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    a, b = (QUERIES[name](spark, str(d)).toPandas().sort_values(["prow", "pcol"]) for d in (sf_dir, tmp_path))
    assert len(a) == 420 and a.value.notna().sum() > 350  # linear: cells within the hull of 150 points
    assert np.allclose(10 * a.value, b.value, rtol=1e-4, atol=1e-2, equal_nan=True)


def test_forest(spark, sf_dir):
    p = QUERIES["l1_l2_l3_forest"](spark, sf_dir).toPandas()
    assert np.allclose(p.p0 + p.p1, 1) and (p.label == p.prediction).mean() > 0.95
    i = QUERIES["l4_o1_importances"](spark, sf_dir).toPandas()
    assert i.importance.is_monotonic_decreasing and abs(i.importance.sum() - 1) < 1e-6


@pytest.mark.parametrize(("name", "n_features"), [("l1_l2_l3_forest", 7), ("l4_o1_importances", 14), ("pipeline_a_terrain", 14)])
def test_forests_have_the_size_of_the_operator(spark, sf_dir, monkeypatch, name, n_features):
    from orthoflux.operators import ml

    class Asked(Exception):
        pass

    def fit(self, rows):
        raise Asked(self.getNumTrees(), self.getMaxDepth(), len(rows.select("features").first()[0]))

    monkeypatch.setattr(ml.RandomForestClassifier, "fit", fit)
    with pytest.raises(Asked) as asked:
        QUERIES[name](spark, sf_dir)
    assert asked.value.args == (250, 25, n_features)


def test_watersheds_cover(spark, sf_dir):
    a = QUERIES["g11_watershed_image"](spark, sf_dir).toPandas()
    b = QUERIES["g11_watershed"](spark, sf_dir).toPandas()
    assert (a.label > 0).all() and (b.label > 0).all()
    both = a.merge(b, on=["prow", "pcol"])
    assert len(both) == len(a) and (both.label_x == both.label_y).mean() > 0.8


def test_polygons_keep_area(spark, sf_dir):
    from pyspark.sql import functions as F

    from orthoflux.operators.geom import polygon_area
    from orthoflux.operators.vectorize import polygons
    from orthoflux.plans import fixtures as fx

    bits = fx.px(spark, sf_dir).where("r < 120").select("id", "prow", "pcol")
    got = polygons(bits, fx.meta(12), tile=32).select("area", polygon_area(F.col("rings")).alias("ring_area")).toPandas()
    assert np.allclose(got.area, got.ring_area)

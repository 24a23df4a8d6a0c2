"""Queries on tables whose sizes are not those of the given ones, held against their SQL."""

import pytest
from pyspark.sql import functions as F

from isohyet.operators.model import VerticalModel
from isohyet.plans.queries import ORACLE_SQL, QUERIES
from tests.compare import rows, tables
from tests.test_cube import DAYS, META, dataset, writer


def agrees(spark, folder, name):
    ours, theirs = QUERIES[name](spark, str(folder)).toPandas(), tables(str(folder)).sql(ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs) and len(ours)


def raster_rows(spark, sf_dir, folder, n):
    """A table of the first n rows of the raster."""
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id") < n)
    data.toPandas().to_parquet(f"{folder}/embeddings.parquet", index=False)


@pytest.mark.parametrize("name", ["zarr_exported", "sink_refusals", "cube_written", "cube_created"])
def test_slices_of_unequal_rows(spark, sf_dir, tmp_path, name):
    raster_rows(spark, sf_dir, tmp_path, 23)
    agrees(spark, tmp_path, name)


def test_cells_outside_the_grid(spark, tmp_path):
    cube, data = writer(tmp_path / "c"), dataset(spark, DAYS[:1])
    cube.write(data, META)
    for y, x in ((META.ny, 0), (0, META.nx), (-1, 0), (None, 0)):
        with pytest.raises(ValueError, match="2 cells are outside"):
            cube.write(data.filter("y_idx = 0 AND x_idx = 0").withColumns({"y_idx": F.lit(y).cast("int"), "x_idx": F.lit(x).cast("int")}), META)
    assert cube.read(spark).count() == 2 * META.nx * META.ny


def test_equal_elevations_in_many_parts(spark):
    """Averages of equal values that are merged from parts need not be equal; the slope is 0 all the same."""
    data = spark.range(0, 300_000, 1, 97).selectExpr("'a' AS param", "500.1D + 0.2D AS elevation", "CAST(hash(id) % 1000 AS DOUBLE) AS y")
    fit = VerticalModel().fit(data, ("param",))
    slope = fit.first().slope
    assert slope == 0.0 and "var_pop" not in fit._jdf.queryExecution().analyzed().toString()

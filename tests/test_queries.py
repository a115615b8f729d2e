"""Every registered query of the inventory against its DuckDB twin, and plan checks."""

import duckdb
import pytest

from verdantia.plans import catalog
from verdantia.sources.binding import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(str([same(r[c]) for c in cols]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    rel = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == sorted(str([same(r[names.index(c)]) for c in cols]) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["jn_polygon_cells", "jn_point_in_polygon", "jn_ward_assign", "jn_area_weighted_alloc", "jn_distance_pairs", "agg_study_area", "set_cells_minus", "agg_zonal_fraction"])
def test_no_nested_loops(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

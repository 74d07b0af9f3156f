"""Registered queries agree with their SQL at the smallest size; those without SQL hold their invariants."""

import pytest

from facetflow.plans import registry
from tests.conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.SQL[name]).fetchdf())


def test_planes(spark):
    rows = registry.QUERIES["best_fit_plane"](spark, DATA).toPandas()
    assert ((rows.nx**2 + rows.ny**2 + rows.nz**2 - 1).abs() < 1e-9).all()
    assert (rows.rms_error >= rows.rms).all()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["range_join_edge_triangle", "box_self_join", "polygon_crossings"])
def test_range_joins_are_equi_joins(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_components_of_all_rows(spark, duck):
    """Every part and supplier is there, in the component that union-find gives."""
    edges = duck.execute("SELECT DISTINCT l_partkey * 2, l_suppkey * 2 + 1 FROM lineitem").fetchall()
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = registry.QUERIES["graph_components"](spark, DATA).collect()
    assert {r.node: r.component for r in got} == {n: root(n) for n in parent}


def test_all_points_are_triangulated(spark, duck):
    rows = registry.QUERIES["triangulate"](spark, DATA).toPandas()
    assert rows.points.sum() == duck.execute("SELECT count(*) FROM embeddings").fetchone()[0]


def test_unions_of_all_pairs_are_closed(spark, duck):
    rows = registry.QUERIES["bool_union_geometry"](spark, DATA).toPandas()
    assert len(rows) == duck.execute("SELECT (max(vec_id) + 1) // 2 FROM embeddings").fetchone()[0]
    assert (rows.num_hole_edges == 0).all() and rows.two_manifold.all()
    assert (rows.euler == 2).all() and (rows.num_bodies == 1).all()

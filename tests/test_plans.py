"""Shapes of physical plans: no nested loops, pruned scans, pushed filters, partial aggregation."""

import pytest

from wayfold.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module", autouse=True)
def whole_texts(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


SPATIAL = ["dwithin_pairs", "spatial_flag_join", "opposite_pair", "match_cascade", "same_name_near", "end_degree", "facility_counts", "closest_pair"]


@pytest.mark.parametrize("name", [*SPATIAL, "turn_census", "turn_angle_moves", "link_max_angle", "name_inclusion", "treatment_control", "fuzzy_exists", "evidence_search", "slot_demand_overload"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize(
    ("name", "columns", "others"),
    [
        ("composition_share", ["l_returnflag", "l_linestatus"], ["l_comment", "l_tax", "l_orderkey"]),
        ("crosstab_margins", ["o_orderstatus", "o_totalprice"], ["o_custkey", "o_orderdate"]),
        ("markup_profile", ["html", "url"], []),
    ],
)
def test_scans_are_pruned(spark, name, columns, others):
    schema = plan(QUERIES[name](spark, SF)).rpartition("ReadSchema: ")[2]
    assert all(c in schema for c in columns) and not any(c in schema for c in others)


@pytest.mark.parametrize(("name", "pushed"), [("subgraph_boundary", "GreaterThan(l_quantity,40.0)"), ("resumed_scan", "LessThan(l_shipdate")])
def test_filters_are_pushed(spark, name, pushed):
    assert pushed in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["crosstab_margins", "funnel_total", "spec_sweep", "banned_terms", "grouped_flags"])
def test_aggregation_starts_before_the_shuffle(spark, name):
    assert "partial_" in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["width_profile", "turn_census", "crosstab_margins", "spec_sweep", "dwithin_pairs", "capacity_ratio"])
def test_no_python_in_the_hot_path(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_scenarios_hold_every_order(spark):
    from wayfold.plans import networks

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert networks._scenarios(spark, sf)[0].count() == orders.count()
    assert networks.slot_resolution(spark, sf).select("id").distinct().count() == orders.select("o_orderkey").distinct().count()

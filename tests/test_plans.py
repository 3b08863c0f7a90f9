"""What the physical plans must and must not contain."""

import pytest

from haulframe.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_pairing(spark, name):
    text = plan(spark, name)
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_export_scan_stays_in_the_jvm(spark, tmp_path):
    from haulframe.sources import exports

    (tmp_path / "a.csv").write_text("one\ntwo\nId_Prise;Poids (g)\n1;2\n")
    text = exports.read_export(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "InArrow"):
        assert node not in text


@pytest.mark.parametrize("name", ["active_species", "curve", "length_weight_points"])
def test_active_keys_are_combined_before_the_shuffle(spark, name):
    """Without broadcasts the side that is only asked for its keys is aggregated below its exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = text[text.index("LeftSemi"):].splitlines()
    exchanges = [i for i, line in enumerate(semi) if "Exchange hashpartitioning" in line]
    assert any("HashAggregate" in semi[i + 1] or "HashAggregate" in semi[i + 2] for i in exchanges[:3])


def test_one_pass_where_one_is_enough(spark):
    assert "Expand" not in plan(spark, "kpi_summary")
    scans = lambda name: plan(spark, name).count("lineitem.parquet")
    assert scans("distinct_lists") == 1
    assert scans("top_n_join_labels") <= 2


@pytest.mark.parametrize("name", ["exact_quantile", "boxplot_summary", "size_histogram", "cpue_summary"])
def test_building_a_query_runs_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", "")
    QUERIES[name](spark, SF)
    assert not tracker.getJobIdsForGroup(f"build-{name}")
    spark.sparkContext.setJobGroup("tests", "")


@pytest.mark.parametrize("name,column", [
    ("min_date_filter", "GreaterThanOrEqual(o_orderdate"), ("year_filter", "GreaterThanOrEqual(l_shipdate"),
])
def test_filters_reach_the_scan(spark, name, column):
    assert column in plan(spark, name)


@pytest.mark.parametrize("name,columns", [
    ("total_catch", {"l_linenumber", "l_quantity"}),
    ("zone_pressure", {"l_linenumber", "l_quantity"}),
    ("monthly_evolution", {"l_linenumber", "l_quantity", "l_shipdate"}),
])
def test_scans_read_only_needed_columns(spark, name, columns):
    schema = plan(spark, name).split("ReadSchema: struct<")[1].split(">")[0]
    assert {field.split(":")[0] for field in schema.split(",")} == columns


@pytest.mark.parametrize("name", [
    "species_list", "monthly_evolution", "fruitless_outings", "cpue_by_mode", "zone_pressure", "kpi_summary",
])
def test_aggregates_are_combined_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)


def test_reference_tables_are_not_forced_into_memory(spark):
    """Beyond the broadcast threshold the same query joins by shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "line_total")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


@pytest.mark.parametrize("name", ["line_total", "clean_pipeline", "cpue_by_species", "length_weight_points"])
def test_generated_methods_can_be_compiled(spark, name):
    """HotSpot leaves methods above 8000 bytes of bytecode interpreted."""
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        executed = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(executed))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000

"""Shapes of the plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from preciario.operators import ranking as R
from preciario.plans.registry import QUERIES, load_all
from preciario.sources import tables as T

load_all()
#: Queries with joins of every kind, and those with text work.
JOINING = """
    agg_positive stats_counts relative_level compare_chapters semi_comparable_items join_featured
    join_item_region_breakdown cross_item_region missing_pairs anti_orphans union_key_inventory breakdown
    topk_lines_with_other flow_edges bin_equal_width rank_province chunk_ordinal sort_lines unresolved_note
    resolve_unit reject_rows structure_violations supply_listing index_rows dq_coherence dq_golden_diff
    provenance_join sample_first_n_files search_item clean_text clean_cells slugify markup_columns
""".split()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_joins_and_python_over_all_queries(spark, no_broadcast):
    """With every table too large to broadcast, all joins stay equi-joins; only
    Unicode composition leaves the JVM."""
    plans = {name: plan(QUERIES[name](spark, SF)) for name in JOINING}
    assert [n for n, text in plans.items() if re.search("NestedLoop|CartesianProduct", text)] == []
    assert sorted(n for n, text in plans.items() if re.search("EvalPython|InPandas", text)) == ["clean_cells", "clean_text"]


def test_facts_read_only_what_they_sum(spark):
    text = T.facts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("l_quantity|l_tax|l_shipdate|l_linenumber", text)


def test_facts_aggregate_is_a_hash_aggregate(spark):
    text = plan(T.facts(spark, SF))
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_top_k_is_limited_before_the_shuffle(spark):
    text = plan(R.topk_lines(T.lines(spark, SF)))
    final, partial = (m.start() for m in re.finditer("WindowGroupLimit", text))
    assert final < text.index("Exchange hashpartitioning(codigo") < partial
    assert ", Final" in text[final:partial] and ", Partial" in text[partial:]


def test_top_dispersed_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_dispersed"](spark, SF))


def test_building_a_query_runs_no_job(spark):
    """But for the sinks, whose feature is to write, and the footers of the tables, each read once before."""
    from tests.comparing import TABLES

    tracker = spark.sparkContext.statusTracker()
    writing = {n for n in QUERIES if n.startswith(("scan_", "sink_"))} | {"overwrite_stage", "partition_vigencia", "point_lookup", "provenance_join", "explode_lines", "explode_supplies", "docs_by_key"}
    for name in TABLES:
        T.read(spark, SF, name)
    spark.sparkContext.setJobGroup("building", "building")
    try:
        for name in sorted(set(QUERIES) - writing):
            before = len(tracker.getJobIdsForGroup("building"))
            QUERIES[name](spark, SF)
            jobs = len(tracker.getJobIdsForGroup("building")) - before
            assert jobs == 0, (name, jobs)
    finally:
        spark.sparkContext.setJobGroup(None, None)


def test_sheets_are_judged_once(spark):
    """Facts, rejects and the lines' filter share one judgement; rows of the driver's sheets come without generators, but for headers."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES["accepted_tables"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Window [row_number") <= 12 and text.count("Generate ") <= 16


def test_workbooks_take_the_exchange_of_their_sheets(spark):
    """Structure and workbooks share one exchange of the sheets, whose rows are filtered by no name."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES["reject_files"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Generate ") <= 16
    assert re.search(r"ReusedExchange \[archivo#\d+, hoja#\d+\], Exchange hashpartitioning\(archivo", text)


def test_missing_pairs_and_count_build_no_product(spark, no_broadcast):
    assert "Generate" not in plan(QUERIES["inventory_count"](spark, SF))
    assert plan(QUERIES["missing_pairs"](spark, SF)).count("Generate explode(sequence(0, 15") <= 4


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())

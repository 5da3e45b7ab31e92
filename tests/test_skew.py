"""The same queries when one part and one supplier hold a third of all lines,
with tiles small enough that the large groups span many of them."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from preciario.plans.registry import ORACLES, QUERIES, load_all
from preciario.sources import tables as T
from tests.comparing import TABLES, connect, differences

load_all()
SOURCE = "/root/testdata/sf0.001"
NAMES = """
    catalog stats_global compare_chapters relative_level breakdown topk_lines_with_other flow_edges sort_lines
    sink_lineas_parquet section_lines unresolved_note reject_rows supply_listing sort_supply anti_orphans
    missing_pairs dq_coherence chunk_ordinal
""".split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sesgo")
    for name in TABLES:
        if name != "lineitem":
            shutil.copyfile(f"{SOURCE}/{name}.parquet", folder / f"{name}.parquet")
    duckdb.execute(
        f"""COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,
                                   CASE WHEN l_orderkey % 3 <> 1 THEN 4 ELSE l_suppkey END AS l_suppkey)
                 FROM read_parquet('{SOURCE}/lineitem.parquet')
                 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)
           TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle_under_skew(spark, skewed, name, monkeypatch):
    monkeypatch.setattr(T, "ORDERS_PER_TILE", 50)
    assert differences(QUERIES[name](spark, skewed), connect(skewed), ORACLES[name]) == []

"""Headline timings over the driver tables; prints one JSON line.

``build`` is the whole batch: three sorted tables, item and province documents,
catalog and statistics.  The other names are registered queries, each run from
the raw tables to its last row.  ``point_lookup_warm`` is the best of three on
the table that ``build`` wrote.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from preciario.constants import VIGENCIA
from preciario.operators import aggregates as A, extract as X
from preciario.plans.registry import QUERIES, load_all
from preciario.plans.storage import LOOKUP, _provenance
from preciario.session import build_session, scratch_path, size_shuffles
from preciario.sources import schemas, storage as S
from preciario.sources import tables as T
from preciario.sources.layout import SECCIONES_ANCHAS

HEADLINE = [
    "catalog",
    "top_dispersed",
    "item_document",
    "province_summary",
    "stats_counts",
    "stats_global",
    "composition_by_chapter",
    "relative_level",
    "compare_chapters",
    "breakdown",
    "topk_lines_with_other",
    "flow_edges",
    "price_curve",
    "featured_round_robin",
    "chunk_ordinal",
    "missing_pairs",
    "anti_orphans",
    "search_item",
    "clean_text",
    "canonical_unit",
    "markup_columns",
    "markup_sweep",
    "section_lines",
    "unresolved_note",
    "reject_rows",
    "supply_listing",
    "dq_apu_rules",
    "dq_coherence",
    "sink_lineas_parquet",
    "partition_vigencia",
]


def build(spark, sf_dir: str) -> dict[str, str]:
    """Everything the batch publishes, from the raw tables."""
    out = scratch_path(spark, "build")
    for name, rows, schema in (("apus", T.facts(spark, sf_dir), schemas.APUS), ("insumos", T.supplies(spark, sf_dir), schemas.INSUMOS)):
        S.sink_staging(rows, f"{out}/staging-{name}", schema)
    lineas = S.sink_lineas(T.with_order(T.lines(spark, sf_dir)), f"{out}/lineas")
    S.sink_insumos(S.scan_staging(spark, f"{out}/staging-insumos", schemas.INSUMOS), f"{out}/insumos")
    apus = S.sink_apus(S.scan_staging(spark, f"{out}/staging-apus", schemas.APUS), f"{out}/apus")
    facts = spark.read.parquet(apus)
    S.sink_item_docs(A.item_document(facts), _provenance(), f"{out}/items")
    S.sink_province_docs(A.province_summary(facts), A.province_items(facts), _provenance(), f"{out}/provincias")
    S.sink_catalog(A.catalog(facts), f"{out}/catalogo")
    unresolved = X.unresolved_lines(T.cells(spark, sf_dir), SECCIONES_ANCHAS)
    tables = (spark.read.parquet(lineas), spark.read.parquet(f"{out}/insumos"), unresolved)
    document = A.stats_document(facts, *(t.agg(F.count(F.lit(1)).alias("n")).scalar() for t in tables))
    S.sink_stats(document.select(*S.header(_provenance(), F.lit(VIGENCIA)), *document.columns), f"{out}/stats")
    return {"lineas": lineas, "apus": apus}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    size_shuffles(spark, sf_dir)
    load_all()
    names = sys.argv[1:] or HEADLINE
    run(QUERIES["top_dispersed"](spark, sf_dir))  # start the JVM's compilers

    timings: dict[str, float] = {}
    start = time.perf_counter()
    paths = build(spark, sf_dir)
    timings["build"] = time.perf_counter() - start
    best = float("inf")
    table = spark.read.parquet(paths["lineas"])
    for _ in range(3):
        start = time.perf_counter()
        S.point_lookup(table, *LOOKUP).collect()
        best = min(best, time.perf_counter() - start)
    timings["point_lookup_warm"] = best
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        timings[name] = time.perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in timings.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

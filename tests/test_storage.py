"""What the sinks leave on disk, and what the scans do with bad input."""

from __future__ import annotations

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from preciario.operators import aggregates as A
from preciario.plans.registry import QUERIES
from preciario.sources import documents as D
from preciario.sources import schemas
from preciario.sources import storage as S
from preciario.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineas(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lineas") / "t")
    return S.sink_parquet(
        S.to_schema(T.with_order(T.lines(spark, SF)), schemas.LINEAS), path, [S.natural_key(F.col("codigo")), "slug", "orden"], 256
    )


def test_row_groups_and_compression(lineas):
    files = glob.glob(f"{lineas}/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert max(sizes) <= 256 and sum(sizes) == 6000 and len(sizes) > 20
    assert {m.row_group(0).column(0).compression for m in groups} == {"ZSTD"}


def test_order_inside_and_across_files(lineas):
    def key(row):
        return ([int(x) for x in row["codigo"].split(".")], row["slug"], row["orden"])

    rows = [key(r) for f in sorted(glob.glob(f"{lineas}/*.parquet")) for r in pq.read_table(f).to_pylist()]
    assert rows == sorted(rows)


def test_point_lookup_is_pushed_and_pruned(spark, lineas):
    table = spark.read.parquet(lineas)
    found = S.point_lookup(table, "564.35", "nation-3")
    text = plan(found)
    assert "EqualTo(codigo,564.35)" in text and "EqualTo(slug,nation-3)" in text
    assert "departamento" not in text.split("ReadSchema")[1] and len(found.columns) == 16
    assert found.count() == table.where("codigo = '564.35' and slug = 'nation-3'").count() > 0


@pytest.mark.parametrize("codigo, slug", [("../etc", "nation-3"), ("564.35", "Nation 3"), ("", ""), ("999.9", "nation-3")])
def test_point_lookup_of_nothing(spark, lineas, codigo, slug):
    assert S.point_lookup(spark.read.parquet(lineas), codigo, slug).count() == 0


def test_staging_keeps_nulls_and_rejects_garbage(spark, tmp_path):
    path = str(tmp_path / "apus")
    facts = T.facts(spark, SF).limit(3)
    S.sink_staging(facts, path, schemas.APUS)
    row = json.loads(next(line for f in glob.glob(f"{path}/*.json") for line in open(f)))
    assert list(row) == [f.name for f in schemas.APUS] and row["notaFuente"] is None
    assert S.scan_staging(spark, path, schemas.APUS).count() == 3
    (tmp_path / "bad.json").write_text('{"codigo": 3, "costoDirecto": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        S.scan_staging(spark, str(tmp_path / "bad.json"), schemas.APUS).collect()


def test_leading_zero_survives(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"regionCodigo": "0509"}\n')
    assert S.scan_staging(spark, str(tmp_path / "a.json"), schemas.APUS).first().regionCodigo == "0509"


def test_publication_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([("2026-1", 1), ("2025-2", 2)], "vigencia string, v int")
    S.partition_vigencia(rows, path)
    S.partition_vigencia(spark.createDataFrame([("2026-1", 9)], "vigencia string, v int"), path)
    table = spark.read.parquet(path)
    assert sorted((r.vigencia, r.v) for r in table.collect()) == [("2025-2", 2), ("2026-1", 9)]
    assert "PartitionFilters: [isnotnull(vigencia" in plan(table.where("vigencia = '2026-1'"))
    S.overwrite_stage(rows.drop("vigencia").limit(1), path)
    assert spark.read.parquet(path).count() == 1


def test_documents(spark, tmp_path):
    path = str(tmp_path / "items")
    provenance = F.struct(F.lit("f").alias("fuente"), F.lit("2026-1").alias("vigencia"))
    S.sink_item_docs(A.item_document(T.facts(spark, SF)), provenance, path)
    docs = S.scan_docs(spark, path, schemas.DOC_ITEM)
    one = S.item_doc(docs, "564.35")
    assert "PartitionFilters: [isnotnull(grupo" in plan(one)
    doc = one.first()
    assert doc.schemaVersion == "0.1.0" and doc.procedencia.fuente == "f"
    slugs = [r.region.slug for r in doc.regiones]
    assert slugs == sorted(slugs)
    assert S.item_doc(docs, "999.1").count() == 0 and S.item_doc(docs, "../x").count() == 0
    raw = json.loads(next(line for f in glob.glob(f"{path}/grupo=200/*.json") for line in open(f)))
    assert "notaFuente" not in raw and "unidadCruda" not in {k for k, v in raw.items() if v is None}
    (tmp_path / "items" / "grupo=200" / "x.json").write_text("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        S.scan_docs(spark, path, schemas.DOC_ITEM).collect()


def test_province_documents(spark, tmp_path):
    path = str(tmp_path / "provincias")
    provenance = F.struct(F.lit("f").alias("fuente"))
    facts = T.facts(spark, SF)
    S.sink_province_docs(A.province_summary(facts), A.province_items(facts), provenance, path)
    rows = S.province_doc(spark, path, "nation-3").orderBy("posicion").collect()
    codes = [r.elemento.codigo for r in rows]
    assert codes == sorted(codes, key=lambda c: [int(x) for x in c.split(".")]) and len(codes) > 100
    assert [r.posicion for r in rows] == list(range(1, len(rows) + 1)) and len({(r.documento.agregados, r.documento.itemsConDato) for r in rows}) == 1
    files = glob.glob(f"{path}/*")
    assert len(files) == facts.select("slug").distinct().count() and all(f.endswith(".json") for f in files)
    document = json.load(open(f"{path}/nation-3.json"))  # one whole JSON document
    assert [i["codigo"] for i in document["items"]] == codes and document["procedencia"] == {"fuente": "f"}
    for key in ("nation-99", "../x", "Nation-3", ""):
        assert S.province_doc(spark, path, key).count() == 0


def test_streamed_documents_of_any_length(spark, tmp_path):
    """One key with most elements, one without any, awkward texts; written again over itself."""
    path = str(tmp_path / "docs")
    heads = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, n int")
    texts = ["x", None, "two\nlines", 'quote " and ]}', "[", "ñ\u2028"]
    rows = [("a", i, texts[i % 6]) for i in range(1, 5001)] + [("c", 1, "only")]
    elements = spark.createDataFrame(rows, "k string, place long, t string").repartition(7)
    head, element = F.struct("k", "n"), F.struct("t")
    for name in (F.col("k"), None):
        where = f"{path}-{name is None}"
        for _ in range(2):
            D.write_documents(heads, D.fragments(elements, ["k"], "place", element), ["k"], head, "xs", where, name)
        schema = (heads.schema, elements.select("t").schema)
        found = sorted((r.documento.k, r.documento.n, r.posicion, r.elemento.t if r.elemento else None) for r in D.read_documents(spark, where, *schema).collect() if r.posicion)
        assert found == sorted((k, {"a": 1, "c": 3}[k], i, t) for k, i, t in rows)
        assert [r.documento.k for r in D.read_documents(spark, where, *schema).where("posicion IS NULL").collect()] == ["b"]
    assert len(json.load(open(f"{path}-False/a.json"))["xs"]) == 5000
    (tmp_path / "docs-False" / "d.json").write_text('{"k": "d", "xs": [\n{"t": "cut')
    with pytest.raises(Exception, match="unfinished"):
        D.read_documents(spark, f"{path}-False", *schema).collect()


def test_staged_lines_are_compressed(spark, tmp_path):
    """The query's staged lines lie on disk compressed; the rows are those of plain files."""
    found = QUERIES["scan_staging_lineas"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all(f.endswith(".json.gz") for f in found.inputFiles())
    rows = found.orderBy("codigo", "slug", "orden").limit(500)
    for kind in ("none", "gzip"):
        S.sink_staging(rows, str(tmp_path / kind), schemas.LINEAS, compression=kind)
    plain, packed = ([*(tmp_path / kind).glob("part-*")] for kind in ("none", "gzip"))
    assert sum(f.stat().st_size for f in packed) * 5 < sum(f.stat().st_size for f in plain)
    read = [sorted(map(repr, S.scan_staging(spark, str(tmp_path / kind), schemas.LINEAS).collect())) for kind in ("none", "gzip")]
    assert read[0] == read[1] and len(read[0]) == 500


def test_files_of_many_documents_are_compressed(spark, tmp_path):
    """A task's file is compressed and read back whole; a cut one stops the job."""
    import pyarrow as pa

    path = str(tmp_path / "docs")
    heads = spark.createDataFrame([(k,) for k in "abc"], "k string")
    rows = [("a", i, f"text {i}") for i in range(1, 3001)] + [("c", 1, "only")]
    elements = spark.createDataFrame(rows, "k string, place long, t string")
    D.write_documents(heads, D.fragments(elements, ["k"], "place", F.struct("t")), ["k"], F.struct("k"), "xs", path)
    files = glob.glob(f"{path}/*")
    assert files and all(f.endswith(D.PACKED) for f in files)
    schema = (heads.schema, elements.select("t").schema)
    found = D.read_documents(spark, path, *schema).collect()
    assert sorted((r.documento.k, r.posicion, r.elemento.t) for r in found if r.posicion) == rows and len(found) == 3002
    with pa.output_stream(f"{path}/parte-99999{D.PACKED}", compression="zstd") as stream:
        stream.write(b'{"k": "d", "xs": [\n{"t": "cut')
    with pytest.raises(Exception, match="unfinished"):
        D.read_documents(spark, path, *schema).collect()


def test_manifest_of_workbooks(spark, tmp_path):
    for name in ("APU_0509_ANTIOQUIA__VALLE_2026_1.xlsx", "raro.xlsx", "~$temporal.xlsx", "notas.txt"):
        (tmp_path / name).write_text(name)
    manifest = S.file_manifest(S.hashed_files(spark, str(tmp_path)))
    found = {r.filename: (r.codigo, r.departamento, r.provincia, r.bytes) for r in manifest.collect()}
    assert found == {
        "APU_0509_ANTIOQUIA__VALLE_2026_1.xlsx": ("0509", "ANTIOQUIA", "VALLE", 37),
        "raro.xlsx": ("", "", "", 9),
    }
    totals = S.manifest_totals(manifest).first()
    assert (totals.archivos, totals.bytesTotales) == (2, 46)


def test_incomplete_manifest_gives_no_provenance(spark):
    rows = spark.createDataFrame([("2026-1",), ("2025-2",)], "vigencia string")
    manifest = spark.createDataFrame(
        [("2026-1", "f", "u", "2026-01-01", "libre"), ("2025-2", "f", "u", "", "libre")], schemas.MANIFIESTO
    )
    found = {r.vigencia: r.procedencia for r in S.provenance_join(rows, manifest).collect()}
    assert found["2026-1"].licencia == "libre" and found["2025-2"] is None


def test_first_files(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("a", 4)], "archivo string, v int")
    assert sorted(r.v for r in S.sample_first_n_files(rows, 2).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        S.sample_first_n_files(rows, 0)

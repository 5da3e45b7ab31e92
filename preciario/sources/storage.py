"""Staging scans, columnar sinks, document sinks and manifests."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from preciario import constants as C
from preciario.functions.codes import chapter_prefix, natural_key
from preciario.functions.ordering import positions
from preciario.functions.text import trim_all
from preciario.sources import documents as D
from preciario.sources import schemas as S

#: Remark in the head of every document; any wording will do.
NOTA = "Solo costos directos; no incluyen administración, imprevistos ni utilidad."

# ---------------------------------------------------------------- staging


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in declared order and type."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def sink_staging(df: DataFrame, path: str, schema: T.StructType, mode: str = "append", compression: str = "none") -> str:
    """Flat rows as newline-delimited JSON; every key is written, nulls too.  Readers know a compressed file by its ending."""
    to_schema(df, schema).write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).json(path)
    return path


def scan_staging(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Declared schema, and a malformed row stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


# ---------------------------------------------------------------- columnar


def sink_parquet(df: DataFrame, path: str, order: list[str | Column], row_group: int) -> str:
    """Range-partitioned and sorted, zstd, small row groups: min/max statistics
    of the leading key let a point query skip nearly everything.

    A range covers a part of a large item, never all of it by force: the order
    goes down to the single line.  See ``session.size_shuffles`` for the number
    of ranges; adaptive execution merges the small ones.
    """
    keys = {f"_k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(order)}
    spread = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    (
        spread.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", str(row_group))
        .parquet(path)
    )
    return path


# Rows per row group of the three tables.
GRUPO_APUS, GRUPO_LINEAS, GRUPO_INSUMOS = 16_384, 8_192, 16_384


def sink_apus(df: DataFrame, path: str) -> str:
    return sink_parquet(to_schema(df, S.APUS), path, [natural_key(F.col("codigo")), "slug"], GRUPO_APUS)


def sink_lineas(df: DataFrame, path: str) -> str:
    return sink_parquet(to_schema(df, S.LINEAS), path, [natural_key(F.col("codigo")), "slug", "orden"], GRUPO_LINEAS)


def sink_insumos(df: DataFrame, path: str) -> str:
    return sink_parquet(to_schema(df, S.INSUMOS), path, ["codigoInsumo", "slug"], GRUPO_INSUMOS)


def partition_vigencia(df: DataFrame, path: str) -> str:
    """One directory per publication; rewriting one leaves the others alone.

    ``rebalance`` sizes the files and splits a publication that is much larger
    than the rest.
    """
    (
        df.hint("rebalance", "vigencia")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("vigencia")
        .parquet(path)
    )
    return path


def overwrite_stage(df: DataFrame, path: str) -> str:
    """Outputs are rebuilt from empty on each run."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def point_lookup(lineas: DataFrame, codigo: str, slug: str) -> DataFrame:
    """One item in one region: both predicates reach the scan, 16 columns are
    read, and malformed keys never cause one."""
    well_formed = F.lit(codigo).rlike(C.PATRON_CODIGO) & F.lit(slug).rlike(C.PATRON_SLUG)
    return lineas.where((F.col("codigo") == codigo) & (F.col("slug") == slug) & well_formed).select(*S.COLUMNAS_DESGLOSE)


# ---------------------------------------------------------------- provenance

# Fields a provenance record must carry.
CAMPOS_PROCEDENCIA = ("vigencia", "fuente", "fechaDescarga", "licencia")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as JSON rows, one per publication."""
    return spark.read.schema(S.MANIFIESTO).option("mode", "FAILFAST").json(path)


def complete_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest rows that carry every required field."""
    present = F.lit(True)
    for field in CAMPOS_PROCEDENCIA:
        present = present & (trim_all(F.coalesce(F.col(field), F.lit(""))) != "")
    return manifest.where(present)


def provenance_join(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stamp provenance on rows of its publication.

    Rows whose publication has no complete manifest keep a null provenance and
    are caught by the provenance rules.
    """
    stamp = complete_manifest(manifest).select(
        "vigencia", F.struct("fuente", "url", "vigencia", "fechaDescarga", "licencia").alias("procedencia")
    )
    return rows.join(stamp, "vigencia", "left")


def header(procedencia: Column, vigencia: Column, nota: str = NOTA) -> list[Column]:
    """Common head of every published document; ``vigencia`` is that of its rows."""
    return [
        F.lit(C.SCHEMA_VERSION).alias("schemaVersion"),
        vigencia.alias("vigencia"),
        procedencia.alias("procedencia"),
        F.lit("preciario").alias("generadoPor"),
        F.lit(nota).alias("nota"),
    ]


# ---------------------------------------------------------------- documents


def _write_documents(docs: DataFrame, group: Column, path: str) -> str:
    """One JSON row per document, in directories by ``group``.

    A directory per document would mean one tiny file each; a directory per
    chapter or department keeps point reads short and files few.  Rebalancing
    splits a group that is much larger than the rest.
    """
    (
        docs.withColumn("grupo", group)
        .hint("rebalance", "grupo")
        .write.mode("overwrite")
        .option("ignoreNullFields", "true")
        .partitionBy("grupo")
        .json(path)
    )
    return path


def sink_item_docs(documents: DataFrame, procedencia: Column, path: str) -> str:
    body = [f.name for f in S.DOC_ITEM if f.name not in dict(S.CABECERA)]
    return _write_documents(documents.select(*header(procedencia, F.col("vigencia")), *body), chapter_prefix(F.col("codigo")), path)


def sink_province_docs(summary: DataFrame, items: DataFrame, procedencia: Column, path: str) -> str:
    """One document per province, named by its slug, with all its items in order.

    ``summary`` and ``items`` are those of the province operators; items are streamed, never gathered.
    """
    head = F.struct(*header(procedencia, F.col("vigencia")), _placed(), F.struct("min", "max", "mediana", "promedio").alias("agregados"), "itemsConDato")
    item = F.struct("codigo", "titulo", "unidad", "capitulo", "costoDirecto")
    return D.write_documents(summary, D.fragments(items, ["slug"], "posicion", item), ["slug"], head, "items", path, F.col("slug"))


def _placed() -> Column:
    return F.struct(F.col("regionCodigo").alias("codigo"), F.col("regionCodigoDane").alias("codigoDane"), "departamento", "provincia", "slug").alias("region")


def sink_apu_docs(facts: DataFrame, lines: DataFrame, path: str) -> str:
    """A document per item and region with its lines in order of ``orden``; many to a file, their lines streamed."""
    head = F.struct("vigencia", _placed(), "codigo", F.struct(*C.COMPONENTES).alias("totales"), "costoDirecto")
    line = F.struct(*(F.col("codigoInsumo" if f.name == "codigo" else f.name).alias(f.name) for f in S.LINEA))
    return D.write_documents(facts, D.fragments(lines, ["codigo", "slug"], "orden", line), ["codigo", "slug"], head, "lineas", path)


def scan_apu_docs(spark: SparkSession, path: str) -> DataFrame:
    return D.read_documents(spark, path, S.DOC_APU, S.LINEA)


def sink_supply_lists(supplies: DataFrame, path: str) -> str:
    """A document per region with all its supplies, those of one code together."""
    # dealt by a hash, so a region with most supplies is not numbered in one task
    tile = F.pmod(F.xxhash64("codigoInsumo"), F.lit(1024))
    placed = positions(supplies, ["slug"], [tile, "codigoInsumo", "componente"], tile, name="posicion")
    head = F.struct("vigencia", F.struct(F.col("regionCodigo").alias("codigo"), "departamento", "provincia", "slug").alias("region"))
    heads = supplies.groupBy("slug").agg(*(F.min(c).alias(c) for c in ("vigencia", "regionCodigo", "departamento", "provincia")))
    item = F.struct(*(F.col("codigoInsumo" if f.name == "codigo" else f.name).alias(f.name) for f in S.INSUMO))
    return D.write_documents(heads, D.fragments(placed, ["slug"], "posicion", item), ["slug"], head, "insumos", path, F.col("slug"))


def scan_supply_lists(spark: SparkSession, path: str) -> DataFrame:
    return D.read_documents(spark, path, S.DOC_INSUMOS, S.INSUMO)


def scan_province_docs(spark: SparkSession, path: str) -> DataFrame:
    """documento, posicion and elemento of every item of the province documents."""
    return D.read_documents(spark, path, *S.province_parts())


def sink_catalog(catalog: DataFrame, path: str) -> str:
    """Catalog items, one JSON row each, files in code order."""
    rows = catalog.select(
        *(f.name for f in S.DOC_CATALOGO_ITEM if f.name not in ("costoDirecto", "provinciasConDato")),
        F.struct("min", "max", "mediana", "promedio").alias("costoDirecto"),
        F.col("conDato").alias("provinciasConDato"),
    )
    rows.orderBy(natural_key(F.col("codigo"))).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return path


def sink_stats(stats: DataFrame, path: str) -> str:
    """The stats row: a single document by construction."""
    stats.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return path


def scan_docs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Published documents; a corrupt one stops the job."""
    keyed = T.StructType([*schema.fields, T.StructField("grupo", T.StringType())])
    return spark.read.schema(keyed).option("mode", "FAILFAST").json(path)


def item_doc(docs: DataFrame, codigo: str) -> DataFrame:
    """One item document: its chapter directory, then its key.  No match, or a
    malformed code, gives no rows."""
    return docs.where(
        (F.col("grupo") == codigo.split(".")[0]) & (F.col("codigo") == codigo) & F.lit(codigo).rlike(C.PATRON_CODIGO)
    )


def province_doc(spark: SparkSession, path: str, slug: str) -> DataFrame:
    """The items of one province document: its file by name.  No file, or a malformed slug, gives no rows."""
    found = bool(re.fullmatch(C.PATRON_SLUG.removesuffix(r"\z"), slug)) and _exists(spark, f"{path}/{slug}.json")
    rows = scan_province_docs(spark, f"{path}/{slug}.json" if found else path)
    return rows if found else rows.where(F.lit(False))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


# ---------------------------------------------------------------- files


def file_manifest(files: DataFrame) -> DataFrame:
    """Inventory of source files (path, bytes, sha256): parts of the name, bytes,
    SHA-256.  Files whose name does not fit stay, with empty parts; temporary
    files of an open workbook go."""
    name = F.element_at(F.split("path", "/"), -1)

    def part(group: int) -> Column:
        return F.regexp_extract(name, C.PATRON_ARCHIVO_MANIFIESTO, group)

    return files.where(~name.startswith("~$")).select(
        name.alias("filename"), part(1).alias("codigo"), part(2).alias("departamento"), part(3).alias("provincia"), "bytes", "sha256"
    )


def hashed_files(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """path, bytes and SHA-256 of the files of a folder.  Each file is read as a
    stream by one task, so its size doesn't matter."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for batch in batches:
            digests = []
            for path in batch.column("path").to_pylist():
                store, name = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                digest = hashlib.sha256()
                with store.open_input_stream(name, compression=None) as stream:
                    while chunk := stream.read(1 << 22):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    return listed.select("path", F.col("length").alias("bytes")).mapInArrow(run, "path string, bytes long, sha256 string")


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("archivos"), F.sum("bytes").alias("bytesTotales"))


def output_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of written files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("bytes"))


def sample_first_n_files(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first n source files by name, for a development run."""
    if n <= 0:
        raise ValueError("the number of files must be positive")
    return rows.join(rows.select("archivo").distinct().orderBy("archivo").limit(n), "archivo", "left_semi")


def list_item_keys(catalog: DataFrame) -> DataFrame:
    return catalog.select("codigo").orderBy(natural_key(F.col("codigo")))


def list_region_keys(facts: DataFrame) -> DataFrame:
    return facts.select("slug").where(F.col("slug").rlike(C.PATRON_SLUG)).distinct().orderBy("slug")

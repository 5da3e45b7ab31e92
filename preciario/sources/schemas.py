"""Declared schemas.  Nothing is inferred: a code like "0509" must stay text."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Column names, order and types of the three flat tables.
APUS = _struct(
    ("vigencia", _S),
    ("archivo", _S),
    ("regionCodigo", _S),
    ("regionCodigoDane", _S),
    ("departamento", _S),
    ("provincia", _S),
    ("slug", _S),
    ("codigo", _S),
    ("capitulo", _S),
    ("capituloNumero", _I),
    ("capituloNombre", _S),
    ("articulo", _S),
    ("clasificacion", _S),
    ("descripcion", _S),
    ("unidad", _S),
    ("unidadCruda", _S),
    ("equipo", _D),
    ("materiales", _D),
    ("transporte", _D),
    ("manoDeObra", _D),
    ("costoDirecto", _D),
    ("notaFuente", _S),
)

LINEAS = _struct(
    ("vigencia", _S),
    ("regionCodigo", _S),
    ("slug", _S),
    ("departamento", _S),
    ("provincia", _S),
    ("codigo", _S),
    ("orden", _I),
    ("componente", _S),
    ("codigoInsumo", _S),
    ("descripcion", _S),
    ("unidad", _S),
    ("unidadCruda", _S),
    ("cantidad", _D),
    ("precioUnitario", _D),
    ("subtotal", _D),
    ("porcentaje", _D),
    ("base", _D),
    ("distancia", _D),
    ("jornal", _D),
    ("factorPrestacional", _D),
)

INSUMOS = _struct(
    ("vigencia", _S),
    ("regionCodigo", _S),
    ("slug", _S),
    ("departamento", _S),
    ("provincia", _S),
    ("codigoInsumo", _S),
    ("componente", _S),
    ("descripcion", _S),
    ("unidad", _S),
    ("unidadCruda", _S),
    ("categoria", _S),
    ("precio", _D),
    ("factorPrestacional", _D),
)

# Columns a breakdown reads.
COLUMNAS_DESGLOSE = (
    "codigo",
    "slug",
    "orden",
    "componente",
    "codigoInsumo",
    "descripcion",
    "unidad",
    "unidadCruda",
    "cantidad",
    "precioUnitario",
    "subtotal",
    "porcentaje",
    "base",
    "distancia",
    "jornal",
    "factorPrestacional",
)

REGION = _struct(("codigo", _S), ("codigoDane", _S), ("departamento", _S), ("provincia", _S), ("slug", _S))
TOTALES = _struct(("equipo", _D), ("materiales", _D), ("transporte", _D), ("manoDeObra", _D))
AGREGADOS = _struct(("min", _D), ("max", _D), ("mediana", _D), ("promedio", _D))
PROCEDENCIA = _struct(
    ("fuente", _S), ("url", _S), ("vigencia", _S), ("fechaDescarga", _S), ("licencia", _S), ("archivo", _S), ("nota", _S)
)
CABECERA = (
    ("schemaVersion", _S),
    ("vigencia", _S),
    ("procedencia", PROCEDENCIA),
    ("generadoPor", _S),
    ("nota", _S),
)

_ITEM = (
    ("codigo", _S),
    ("descripcion", _S),
    ("unidad", _S),
    ("unidadCruda", _S),
    ("capitulo", _S),
    ("capituloNumero", _I),
    ("capituloNombre", _S),
)

DOC_ITEM = _struct(
    *CABECERA,
    *_ITEM,
    ("articulo", _S),
    ("clasificacion", _S),
    ("notaFuente", _S),
    ("agregados", AGREGADOS),
    ("provinciasConDato", _L),
    ("regiones", T.ArrayType(_struct(("region", REGION), ("totales", TOTALES), ("costoDirecto", _D)))),
)

DOC_PROVINCIA = _struct(
    *CABECERA,
    ("region", REGION),
    ("agregados", AGREGADOS),
    ("itemsConDato", _L),
    ("parte", _S),
    (
        "items",
        T.ArrayType(_struct(("codigo", _S), ("titulo", _S), ("unidad", _S), ("capitulo", _S), ("costoDirecto", _D))),
    ),
)



def province_parts() -> tuple[T.StructType, T.StructType]:
    """Schemas of a province document without its items, and of an item."""
    fixed = [f for f in DOC_PROVINCIA.fields if f.name not in ("parte", "items")]
    return T.StructType(fixed), DOC_PROVINCIA["items"].dataType.elementType


LINEA = _struct(
    ("componente", _S), ("codigo", _S), ("descripcion", _S), ("unidad", _S), ("unidadCruda", _S), ("cantidad", _D), ("precioUnitario", _D), ("subtotal", _D),
    ("porcentaje", _D), ("base", _D), ("distancia", _D), ("jornal", _D), ("factorPrestacional", _D),
)
DOC_APU = _struct(("vigencia", _S), ("region", REGION), ("codigo", _S), ("totales", TOTALES), ("costoDirecto", _D))
INSUMO = _struct(
    ("codigo", _S), ("componente", _S), ("descripcion", _S), ("unidad", _S), ("unidadCruda", _S), ("categoria", _S), ("precio", _D), ("factorPrestacional", _D)
)
DOC_INSUMOS = _struct(("vigencia", _S), ("region", REGION))

DOC_CATALOGO_ITEM = _struct(
    *_ITEM, ("clasificacion", _S), ("costoDirecto", AGREGADOS), ("provinciasConDato", _L)
)

_PROVINCIA = _struct(("slug", _S), ("departamento", _S), ("provincia", _S), ("medianaCostoDirecto", _D))
DOC_STATS = _struct(
    *CABECERA,
    ("conteos", _struct(*((c, _L) for c in ("items", "provincias", "departamentos", "apus", "lineas", "insumos", "lineasSinResolver")))),
    ("costoDirecto", AGREGADOS),
    ("capitulos", T.ArrayType(_struct(("capitulo", _S), ("items", _L)))),
    ("capitulosInvias", T.ArrayType(_struct(("numero", _I), ("nombre", _S), ("items", _L)))),
    ("departamentos", T.ArrayType(_struct(("codigoDane", _S), ("nombre", _S), ("provincias", _L)))),
    ("notables", _struct(("provinciaMasCara", _PROVINCIA), ("provinciaMasBarata", _PROVINCIA))),
)

MANIFIESTO = _struct(
    ("vigencia", _S), ("fuente", _S), ("url", _S), ("fechaDescarga", _S), ("licencia", _S)
)

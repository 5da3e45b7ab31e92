"""Where things sit on the printed form."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Columns in which sheets have cells.
COLUMNAS = (*"ABCDEFGHIJKLMN", "CL")

# Row from which the wide variant of the form counts its lines.
WIDE_FIRST_ROW = 1001
_NO_LIMIT = 9_223_372_036_854_775_807


@dataclass(frozen=True)
class Seccion:
    componente: str
    banner_row: int
    texto_banner: str
    first_row: int
    last_row: int
    subtotal_row: int
    #: field -> column letter
    columns: dict[str, str]


@dataclass(frozen=True)
class Listado:
    hoja: str
    componente: str
    first_row: int
    columns: dict[str, str]
    default_unit: str | None = None


# The four sections of an item sheet.
SECCIONES = (
    Seccion("equipo", 35, "I. EQUIPO", 38, 51, 53,
            {"codigo": "B", "descripcion": "C", "cantidad": "L", "precioUnitario": "K", "subtotal": "N"}),
    Seccion("materiales", 55, "II. MATERIALES", 58, 73, 74,
            {"codigo": "B", "descripcion": "C", "unidad": "J", "cantidad": "K", "precioUnitario": "L", "subtotal": "N"}),
    Seccion("transporte", 76, "III. TRANSPORTES", 79, 83, 84,
            {"codigo": "B", "descripcion": "C", "unidad": "I", "cantidad": "J", "distancia": "K", "precioUnitario": "M",
             "subtotal": "N"}),
    Seccion("manoDeObra", 86, "IV. MANO DE OBRA", 89, 98, 99,
            {"codigo": "B", "descripcion": "C", "jornal": "I", "factorPrestacional": "J", "precioUnitario": "K",
             "cantidad": "L", "subtotal": "N"}),
)

#: The same form with line rows from 1001 on and no upper limit on the last
#: section, for tables whose sheets are longer than the paper.
SECCIONES_ANCHAS = tuple(
    replace(s, first_row=lo, last_row=hi)
    for s, (lo, hi) in zip(SECCIONES, ((1001, 1002), (1003, 1004), (1005, 1006), (1007, _NO_LIMIT)))
)

# Single cells of an item sheet, as field -> (row, column).
CELDAS_ITEM = {
    "codigo": (33, "B"),
    "descripcion": (33, "C"),
    "unidad": (33, "L"),
    "costoDirecto": (101, "N"),
}
ETIQUETA_COSTO = (101, "B")
CELDAS_AIU = ((109, "N"), (111, "N"))

# The minor-tools row.
FILA_HERRAMIENTA = 52
HERRAMIENTA = {
    "codigo": "B",
    "descripcion": "C",
    "tipo": "J",
    "base": "K",
    "porcentaje": "L",
    "subtotal": "N",
}

# The index sheet.
HOJA_INDICE = "ÍNDICE"
INDICE_PRIMERA_FILA = 5
INDICE_COLUMNAS = {
    "consecutivo": "A",
    "capitulo": "B",
    "articulo": "C",
    "clasificacion": "D",
    "codigo": "E",
    "descripcion": "F",
    "unidad": "G",
    "equipo": "H",
    "materiales": "I",
    "transporte": "J",
    "manoDeObra": "K",
    "costoDirecto": "L",
}

# The cover sheet, as field -> (row, column).
HOJA_PORTADA = "PORTADA"
PORTADA = {
    "departamento": (24, "D"),
    "provincia1": (24, "F"),
    "provincia2": (24, "CL"),
    "factorHorario": (24, "G"),
    "altitud": (27, "D"),
    "factorAltitud": (27, "E"),
    "temperatura": (27, "F"),
    "factorManoDeObra": (27, "G"),
}

# The four supply listings.
LISTADOS = (
    Listado("EQUIPO", "equipo", 6,
            {"codigo": "C", "unidad": "D", "descripcion": "E", "categoria": "F", "precio": "G"}),
    Listado("MATERIALES", "materiales", 7,
            {"codigo": "C", "unidad": "D", "descripcion": "E", "precio": "F", "categoria": "G"}),
    Listado("TRANSPORTE", "transporte", 7,
            {"codigo": "C", "unidad": "D", "descripcion": "E", "precio": "F"}),
    Listado("MANO DE OBRA", "manoDeObra", 12,
            {"codigo": "C", "descripcion": "D", "precio": "E", "factorPrestacional": "G"}, "mes"),
)

# The salary block of the labour listing.
HOJA_SALARIOS = "MANO DE OBRA"
SALARIOS_FILAS = (4, 7)
SALARIOS_COLUMNAS = {"concepto": "D", "unidad": "B", "valor": "G"}

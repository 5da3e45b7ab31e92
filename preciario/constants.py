"""Fixed values of the unit-cost data model.

Every value here is part of the published format, so results only agree when
these are equal to it.  They are facts, not choices.
"""

from __future__ import annotations

SCHEMA_VERSION = "0.1.0"
VIGENCIA = "2026-1"


# The four cost components in the order of the printed form.
COMPONENTES = ("equipo", "materiales", "transporte", "manoDeObra")

# Two-digit department codes and their names.
DEPARTAMENTOS = {
    "05": "Antioquia",
    "08": "Atlántico",
    "11": "Bogotá D.C.",
    "13": "Bolívar",
    "15": "Boyacá",
    "17": "Caldas",
    "18": "Caquetá",
    "19": "Cauca",
    "20": "Cesar",
    "23": "Córdoba",
    "25": "Cundinamarca",
    "27": "Chocó",
    "41": "Huila",
    "44": "La Guajira",
    "47": "Magdalena",
    "50": "Meta",
    "52": "Nariño",
    "54": "Norte de Santander",
    "63": "Quindío",
    "66": "Risaralda",
    "68": "Santander",
    "70": "Sucre",
    "73": "Tolima",
    "76": "Valle del Cauca",
    "81": "Arauca",
    "85": "Casanare",
    "86": "Putumayo",
    "88": "Archipiélago de San Andrés, Providencia y Santa Catalina",
    "91": "Amazonas",
    "94": "Guainía",
    "95": "Guaviare",
    "97": "Vaupés",
    "99": "Vichada",
}

# Canonical unit for each known spelling.
UNIDADES = {
    "ha": "ha",
    "m2": "m2",
    "m": "m",
    "kg": "kg",
    "Kg": "kg",
    "u": "u",
    "m3": "m3",
    "m³": "m3",
    "L": "L",
    "tf-m": "tf-m",
    "kg-km": "kg-km",
    "m3 - E": "m3-km",
    "m3 - Km": "m3-km",
    "m3 - km": "m3-km",
    "m3-km": "m3-km",
    "h": "h",
    "%": "%",
    "Km": "km",
    "km": "km",
    "mes": "mes",
    "día": "día",
    "jornal": "jornal",
}

# Spellings of cubic-metre-kilometre matched by pattern.
PATRON_M3_KM = r"(?i)^m\s*3\s*-\s*(km|e)$"
UNIDAD_M3_KM = "m3-km"
UNIDAD_EQUIPO = "h"
UNIDAD_MANO_DE_OBRA = "jornal"

# Words kept in lower case inside a name.
CONECTORES = ("de", "del", "la", "las", "los", "el", "y", "e")

# Patterns of the identifiers.
PATRON_CODIGO = r"^\d{3}(\.\d+)*\z"
PATRON_CAPITULO = r"^\d{3}\z"
PATRON_SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*\z"
PATRON_REGION = r"^\d{4}\z"
PATRON_DANE = r"^\d{2}\z"
PATRON_VIGENCIA = r"^\d{4}-[12]\z"
PATRON_FECHA = r"^\d{4}-\d{2}-\d{2}\z"
PATRON_HOJA_ITEM = r"^\d+(,\d+)*\z"
PATRON_ARCHIVO = r"(?i)^APU_(\d{4})_(.+?)__(.+?)_(\d{4})_([12])\.xlsx\z"
PATRON_ARCHIVO_MANIFIESTO = r"^APU_(\d{4})_(.+?)__(.+?)_(\d{4})_(\d)\.xlsx\z"

# Workbook structure.
HOJAS_ESPERADAS = 544
ITEMS_ESPERADOS = 526
HOJAS_DE_APOYO = (
    "PORTADA",
    "ÍNDICE",
    "MENÚ",
    "APU´S",
    "INSUMO_EQUIPO",
    "INSUMO MATERIALES",
    "INSUMO_TRANSPORTE",
    "INSUMO_MANO DE OBRA",
    "IMAGENES_PROVINCIAS",
    "CLASIFICACIÓN_APU",
    "HOJA DE CALCULOS ",
    "LISTADO DE PROVINCIAS",
    "MATERIALES",
    "EQUIPO",
    "MANO DE OBRA",
    "TRANSPORTE",
    "APU BASE",
    "CONSIDERACIONES ",
)

ETIQUETA_SUBTOTAL = "SUBTOTAL $"
ETIQUETA_COSTO_DIRECTO = "TOTAL COSTO DIRECTO $"
CODIGO_HERRAMIENTA_MENOR = "HERMENINV"

# Tolerances for sums, in currency units.
TOLERANCIA = 1.0
TOLERANCIA_ESTRICTA = 0.011

# Featured list.
CAPITULO_DESTACADO = "630"
N_DESTACADOS = 30

# Upper bounds of the relative-level scale (right-closed).
TRAMOS_NIVEL = (0.9, 0.97, 1.03, 1.1, 1.5)
N_TRAMOS_MAPA = 6

# Key inventory.
URLS_POR_PARTE = 40_000
INDICES = (("", 1.0), ("/items", 0.9), ("/provincias", 0.9), ("/aiu", 0.6))

# Markup.
IVA_GENERAL = 0.19
PORCENTAJE_MAXIMO = 100.0

# The published sentence about unresolved lines.
NOTA_INICIO = "El libro fuente de {fuente} deja "
NOTA_LINEA = " línea"
NOTA_ANTES = " sin resolver —"
NOTA_DESPUES = (
    "—: el código de insumo no existe en el listado regional, así que la fila viene sin "
    "descripción ni precio y no suma al costo directo. Se omite del desglose en vez de "
    "publicarla en cero."
)

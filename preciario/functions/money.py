"""Number columns: rounding, amounts, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from preciario.constants import PORCENTAJE_MAXIMO

#: Money is summed in whole ten-thousandths: integers carry no noise that depends
#: on the order of rows, and converting a double to one is a floor, not a parse.
UNIDADES_POR_PESO = 10_000


def round_money(value: Column) -> Column:
    """Two decimals, half up on the binary value, never minus zero."""
    return F.floor(value * 100 + 0.5) / 100


def exact_units(value: Column, por_peso: int = UNIDADES_POR_PESO) -> Column:
    """Money as a decimal count of ten-thousandths, wide enough never to overflow."""
    return F.floor(value * por_peso + 0.5).cast("decimal(20,0)")


def from_units(units: Column, por_peso: int = UNIDADES_POR_PESO) -> Column:
    return units.cast("double") / por_peso


def sum_money(value: Column, por_peso: int = UNIDADES_POR_PESO) -> Column:
    """Sum that does not depend on the order of the rows; result is a double.

    Addends are rounded to whole ``1 / por_peso``: four decimals, more than costs
    have; prices that are published unrounded take a larger number.
    """
    return from_units(F.sum(exact_units(value, por_peso)), por_peso)


def mean_ratio(ratio: Column) -> Column:
    """Mean of a unitless ratio to twelve decimals, independent of row order."""
    scaled = F.floor(ratio * 1e12 + 0.5).cast("decimal(20,0)")
    return F.sum(scaled).cast("double") / F.count(ratio) / 1e12


def line_amount(componente: Column, cantidad: Column, precio: Column, distancia: Column) -> Column:
    """Amount of a line by the rule of its component; labour divides."""
    return (
        F.when(componente == "transporte", cantidad * distancia * precio)
        .when((componente == "manoDeObra") & (cantidad != 0), precio / cantidad)
        .when(componente == "manoDeObra", F.lit(0.0))
        .otherwise(cantidad * precio)
    )


def clamp_percent(raw: Column) -> Column:
    """Leading number of a text, cut to [0, 100]; junk, infinite and <= 0 give 0."""
    prefix = F.regexp_extract(F.trim(raw.cast("string")), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    number = F.nullif(prefix, F.lit("")).try_cast("double")
    usable = number.isNotNull() & (number > 0) & (number < float("inf"))
    return F.when(usable, F.least(number, F.lit(PORCENTAJE_MAXIMO))).otherwise(F.lit(0.0))

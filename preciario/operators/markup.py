"""Markup scenarios over facts: administration, contingency, profit, VAT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from preciario.constants import IVA_GENERAL


def scenarios(*rows: tuple[str, float, float, float, str]) -> Column:
    """Literal scenarios (name, administration, contingency, profit, VAT base)
    as an array, to be exploded next to each fact."""
    return F.array(
        *(
            F.struct(
                F.lit(name).alias("escenario"),
                F.lit(float(a)).alias("pctAdministracion"),
                F.lit(float(i)).alias("pctImprevistos"),
                F.lit(float(u)).alias("pctUtilidad"),
                F.lit(base).alias("baseIva"),
            )
            for name, a, i, u, base in rows
        )
    )


def with_scenarios(facts: DataFrame, table: Column) -> DataFrame:
    return facts.withColumn("_e", F.explode(table)).select("*", "_e.*").drop("_e")


def markup_columns(df: DataFrame, costo: str = "costoDirecto", tarifa: float = IVA_GENERAL) -> DataFrame:
    """Each percentage applies to the direct cost, not in cascade; VAT falls on
    the profit only."""
    cost = F.col(costo)
    out = df.withColumns(
        {
            "administracion": cost * (F.col("pctAdministracion") / 100),
            "imprevistos": cost * (F.col("pctImprevistos") / 100),
            "utilidad": cost * (F.col("pctUtilidad") / 100),
        }
    ).withColumn("totalAiu", F.col("administracion") + F.col("imprevistos") + F.col("utilidad"))
    iva = F.when(F.col("baseIva") == "utilidad", F.col("utilidad") * tarifa).otherwise(F.lit(0.0))
    return out.withColumns({"subtotal": cost + F.col("totalAiu"), "iva": iva}).withColumns(
        {
            "total": F.col("subtotal") + F.col("iva"),
            "fraccionAiu": F.when(cost > 0, F.col("totalAiu") / cost).otherwise(F.lit(0.0)),
        }
    )


def markup_pct_total(df: DataFrame) -> DataFrame:
    total = F.col("pctAdministracion") + F.col("pctImprevistos") + F.col("pctUtilidad")
    return df.withColumns({"porcentajeTotal": total, "esCero": total == 0})


def markup_sweep(df: DataFrame, costo: str = "costoDirecto", hasta: int = 40, paso: int = 2) -> DataFrame:
    """Cost under every total markup from 0 to ``hasta`` in steps of ``paso``."""
    return df.withColumn("porcentaje", F.explode(F.sequence(F.lit(0), F.lit(hasta), F.lit(paso)))).withColumn(
        "total", F.col(costo) * (1 + F.col("porcentaje") / 100)
    )

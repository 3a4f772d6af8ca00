"""Writing the payroll out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quinhao.functions.money import half_even
from quinhao.session import stored


def payroll_export(payroll: DataFrame, path: str) -> None:
    """Parquet under ``path/parquet`` and CSV with two decimals under ``path/csv``, by period.

    The periods of ``payroll`` are replaced, others stay. The payroll is worked out once, into a
    table that is removed afterwards. The rebalance hint lets the engine merge small files and
    split large months.
    """

    def write(df: DataFrame):
        parts = df.hint("rebalance", F.col("period")).write.partitionBy("period")
        return parts.mode("overwrite").option("partitionOverwriteMode", "dynamic")

    with stored(payroll, "payroll") as rows:
        write(rows).parquet(f"{path}/parquet")
        text = [
            half_even(F.col(f.name)).cast("decimal(18,2)").alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f.name)
            for f in rows.schema.fields
        ]
        write(rows.select(*text)).csv(f"{path}/csv", header=True)

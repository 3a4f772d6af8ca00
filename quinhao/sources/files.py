"""Tables stored as files, one folder or file per table."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quinhao.schemas import INPUT_SCHEMAS, OPTIONAL, SCHEMAS, Inputs, Tables, conform

# Text files are read as text and cast to the fixed types; CSV names its columns in a header.
TEXT_OPTIONS: dict[str, dict[str, str]] = {
    "csv": {"header": "true"},
    "json": {"primitivesAsString": "true"},
}


def load_tables(
    spark: SparkSession, root: str, fmt: str = "parquet", suffix: str = "", **options: str
) -> Tables:
    """The eleven tables, read from ``root/<table><suffix>`` and cast to their fixed schemas.

    A table that lacks a column is an error. JSON leaves null fields out unless it is written
    with ``ignoreNullFields=false``, so a column that is null in every row counts as absent.
    """
    return Tables(_reader(spark, SCHEMAS, root, fmt, suffix, options))


def load_inputs(
    spark: SparkSession, root: str, fmt: str = "parquet", suffix: str = "", **options: str
) -> Inputs:
    """The allowance selections and the attitude and overtime entries, with their period if any."""
    return Inputs(_reader(spark, INPUT_SCHEMAS, root, fmt, suffix, options))


def _reader(
    spark: SparkSession,
    schemas: Mapping[str, StructType],
    root: str,
    fmt: str,
    suffix: str,
    options: Mapping[str, str],
) -> Callable[[str], DataFrame]:
    chosen = TEXT_OPTIONS.get(fmt, {}) | dict(options)

    def load(name: str) -> DataFrame:
        found = spark.read.format(fmt).options(**chosen).load(f"{root}/{name}{suffix}")
        if not found.columns:  # text without any row names no columns
            return spark.createDataFrame([], schemas[name])
        return conform(found, schemas[name], name, OPTIONAL.get(name))

    return load

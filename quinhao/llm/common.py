"""What the operators of this subpackage share: columns, batches and stored tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quinhao import session

__all__ = [
    "by_batch", "documents", "materialize", "mix", "scratch", "ship", "table", "utf8_rows",
]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as they may not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quinhao-")) / "quinhao.zip"  # Spark copies it
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


_scratch: list[list[str]] = []  # paths stored in each open ``scratch`` block


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are removed at its end, unless they are to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            session.remove(spark, path)


# Lets the engine delete a query's shuffle files when it is done, not when the driver collects
# the plan as garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; its shuffle files go at once."""
    spark = df.sparkSession
    path = session.fresh_path(spark, name)
    if _scratch and not keep:
        _scratch[-1].append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def by_batch(
    df: DataFrame,
    build: Callable[[], Callable[..., Iterable[Sequence]]],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply a function of a batch's columns, each a Python list, that returns new columns.

    ``build`` runs once per task and returns that function, so that vocabularies and memos are
    loaded on the executors and never travel with the plan.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = [_arrow_type(f.dataType) for f in schema.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = build()
        for batch in batches:
            if batch.num_rows:
                columns = apply(*[c.to_pylist() for c in batch.columns])
                arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind.simpleString()]


def utf8_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of an Arrow string column, without copying; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    for k in range(len(column)):
        yield data[offsets[k] : offsets[k + 1]]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values so that any bits of them may serve as a hash."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def text_or_empty(column: str = "text") -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def arrow_schema(ddl: str):
    """The Arrow schema of a flat DDL string; element types of arrays are simple too."""
    import pyarrow as pa

    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = []
    for field in ddl.split(","):
        name, kind = field.split()
        fields.append((name, pa.list_(simple[kind[6:-1]]) if kind.startswith("array<") else simple[kind]))
    return pa.schema(fields)


def record_batch(columns: dict, ddl: str):
    """Columns (lists or Arrow arrays) as a record batch of the schema."""
    import pyarrow as pa

    schema = arrow_schema(ddl)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in ((n, columns[n]) for n in schema.names)], schema=schema)


def sliced(batches, rows: int = 500):
    """Record batches of at most ``rows`` rows, so that Python objects are made of few rows at a time.

    At the end of a task Arrow's unused memory goes back, since workers live on.
    """
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def by_bytes(texts, most: int):
    """Slices of an Arrow array of strings of at most ``most`` bytes each, or of one string."""
    import numpy as np
    import pyarrow.compute as pc

    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at)
        yield texts.slice(at, n)
        at += n


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Python workers at most ``rows`` rows at a time: rows of texts are large.

    Both sides of the exchange hold whole batches, so this bounds their memory.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def filtered(docs: DataFrame, column: str, keeper: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text (null: empty) is kept.

    ``keeper()`` is called once in each task and gives a function from texts to
    decisions.
    """
    import pyarrow as pa

    at = docs.columns.index(column)

    def run(batches: Iterator) -> Iterator:
        keep = keeper()
        for batch in sliced(batches):
            yield batch.filter(pa.array(keep([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

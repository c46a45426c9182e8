"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafield.session import materialize

__all__ = ["append_columns", "apart", "lower_ascii", "materialize", "slices", "table", "tokenizer_path", "without"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; it is the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def lower_ascii(column):
    return F.translate(column, _UPPER, _LOWER)


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns that have none of the names in any case, as Spark compares them."""
    new = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in new]


def apart(df: DataFrame, columns: list[str], work: Callable[..., DataFrame]) -> DataFrame:
    """work(df, *columns) while df's columns have reserved names, then under their own names again.

    What `work` adds can't clash with a column of the caller's, and only the caller's columns come back. Of a name that
    is there in several cases the one that is spelt like it in `columns` is meant, else the first one.
    """
    names = df.columns
    held = [f"__caller{i}" for i in range(len(names))]
    at = [names.index(c) if c in names else [n.lower() for n in names].index(c.lower()) for c in columns]
    out = work(df.toDF(*held), *[held[i] for i in at])
    return out.select(*[F.col(h).alias(n) for h, n in zip(held, names, strict=True)])


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable[[], Callable[..., list[pa.Array]]]) -> DataFrame:
    """df with further columns, computed from Arrow batches of `inputs`.

    make() runs once in each task and returns a function from the input arrays to one array for each field. Columns
    of df that have the name of a new field, in any case, are replaced.
    """
    kept = without(df.columns, [f.name for f in fields])
    carried = {c: f"__in{i}" for i, c in enumerate(inputs) if c not in kept}
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(a) for c, a in carried.items()])
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])
    places = [len(kept) + list(carried).index(c) if c in carried else kept.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                out = [part.column(i) for i in range(len(kept))]
                out += work(*[part.column(i) for i in places])
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about most_bytes at most, one row at least."""
    n = batch.num_rows
    step = max(1, int(n * most_bytes / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)

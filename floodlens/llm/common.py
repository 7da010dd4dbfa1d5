"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table, cut to ``cols`` (all columns when none are given)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow string column; null reads as empty."""
    return [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return to the system what this worker's Arrow pool and allocator hold but no
    longer use: workers live on through the stages of a job, and a stage's peak
    would otherwise stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(fn, rows: int = 1_000):
    """Lift ``RecordBatch -> dict of arrays`` into a ``mapInArrow`` function, which gets at most ``rows`` rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, rows)))
        give_back()
    return run


def any_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let the first table of an operator have columns of any name.

    Names that begin with ``_`` belong to the operators' own columns, and names with
    a dot or a backtick mean something else in an expression: such columns go through
    the operator under plain names and get their own back in the result.  Column
    names among the arguments follow; column expressions are evaluated before."""
    first = next(iter(inspect.signature(operator).parameters))

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        df = args[0] if args else kwargs[first]
        odd = [c for c in df.columns if c.startswith("_") or "." in c or "`" in c]
        if not odd:
            return operator(*args, **kwargs)
        taken = {c.lower() for c in df.columns}
        free = (n for n in (f"carried_{k}" for k in range(len(df.columns) * 2 + len(args) + len(kwargs) + 1)) if n not in taken)
        plain = dict(zip(odd, free))
        made: list[str] = []

        def follow(value):
            nonlocal df
            if isinstance(value, str):
                return plain.get(value, value)
            if isinstance(value, list):
                return [follow(v) for v in value]
            if isinstance(value, Column):
                made.append(next(free))
                df = df.withColumn(made[-1], value)
                return F.col(made[-1])
            return value
        rest = [follow(v) for v in args[1:]]
        named = {n: follow(v) for n, v in kwargs.items() if n != first}
        out = operator(df.toDF(*[plain.get(c, c) for c in df.columns]), *rest, **named).drop(*made)
        own = {new: old for old, new in plain.items()}
        return out.toDF(*[own.get(c, c) for c in out.columns])
    return run

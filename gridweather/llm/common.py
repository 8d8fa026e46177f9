"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridweather import session

# White space between words, as the contracts name it.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a step into the shared folder and read it back: later steps neither repeat it nor depend on an executor's disk."""
    path = session.new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def held(operator: str, make):
    """What an operator keeps in a Python worker from one batch or task to the next, made anew where it is not there.

    Workers are used again by later stages, so the state of any other operator is let go first: a worker never holds two.
    """
    if operator not in _held:
        nothing_held()
        _held[operator] = make()
    return _held[operator]


def nothing_held() -> None:
    """Let go of what other operators have left in this worker, back to the system; for operators that keep nothing themselves."""
    if _held:
        _held.clear()
        gc.collect()
        handed_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def handed_back() -> None:
    """Give the memory that a batch or task has freed back to the system: Arrow's, and the C library's where it can.

    A worker is kept for later tasks, and while it waits what it has freed still counts as its executor's.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_rows(docs: DataFrame) -> DataFrame:
    """Just id and text, so that other columns of the input cannot clash with names used here."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """Columns ``keep`` and ``made``, the latter worked out once per row however often they are used after.

    The optimizer copies an expression into every later use of it, filters and lambdas included; it does not copy through a
    generator.
    """
    one = F.struct(*[column.alias(name) for name, column in made.items()])
    return df.select(*keep, F.explode(F.array(one)).alias("_once")).select(*keep, *[F.col(f"_once.{name}").alias(name) for name in made])

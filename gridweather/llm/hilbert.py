"""Shards along a Hilbert curve: files that can be left out by several metadata columns at once.

Each column's values are put into cells: numbers between quantiles over all rows, strings between quantiles over their distinct
values (in byte order; with few enough values each has a cell of its own), null in a cell before all others. The cells are a
point of a grid, and the grid's Hilbert curve visits neighbours one after the other, so that a run of the order is a compact box
in every column. The order is cut into runs of equal row counts. Sorting by one column after the other prunes by the first alone.

Null text has no bytes, and so its size is 8 and its CRC that of no bytes. NaN counts as null. Ties on the curve follow the
text's CRC, the id and the row: equal texts of one place lie side by side, repeated rows are rows of their own with places of
their own. No rows give no shards; fewer rows than shards leave the last shards empty. Other columns are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gridweather.llm.common import written
from gridweather.operators.numbered import numbered

#: Bytes of a string that are looked at for the prefix that all values share, and behind it for the order.
SHARED, CODED = 64, 6
#: Bytes that every row takes beside its text.
OVERHEAD = 8


@dataclass(frozen=True)
class Curve:
    """``columns`` with ``2**bits`` cells each, at most 62 bits together."""

    columns: tuple[str, ...] = ("source", "lang", "n_chars")
    bits: int = 6

    def __post_init__(self):
        if not self.columns or self.bits < 1 or len(self.columns) * self.bits > 62:
            raise ValueError("a curve needs one to 62 bits over all its columns")


def curve_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points given by one array of cells per dimension.

    Skilling's transformation ("Programming the Hilbert curve", 2004): undo the excess rotations from the top bit down, then the
    Gray code, and read the bits of all dimensions in turn.
    """
    x = [np.asarray(c, np.int64).copy() for c in cells]
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (np.int64(1) << bit) - 1
        for i in range(n):
            turn = (x[i] >> bit & 1).astype(bool)
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] >> bit & 1, flip ^ ((np.int64(1) << bit) - 1), flip)
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] ^ flip) >> bit & 1
    return index


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")))


def _is_text(docs: DataFrame, name: str) -> bool:
    return isinstance(docs.schema[name].dataType, (T.StringType, T.BinaryType))


def _number(docs: DataFrame, name: str) -> Column:
    """A column that is not text as a double in the same order."""
    kind = docs.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(docs[name].cast("timestamp")).cast("double")
    x = (F.unix_date(docs[name]) if isinstance(kind, T.DateType) else docs[name]).cast("double")
    return F.when(~F.isnan(x), x)


def shared_digits(docs: DataFrame, names: list[str]) -> dict[str, int]:
    """How many leading hex digits all values of each string column share: those of the least and the greatest one."""
    if not names:
        return {}
    head = {n: F.hex(F.substring(docs[n].cast("binary"), 1, SHARED)) for n in names}
    ends = docs.agg(*[f(h).alias(f"{f.__name__}_{i}") for i, h in enumerate(head.values()) for f in (F.min, F.max)]).first()
    return {n: len(commonprefix([ends[2 * i], ends[2 * i + 1]])) // 2 * 2 if ends[2 * i] is not None else 0 for i, n in enumerate(names)}


def codes(docs: DataFrame, curve: Curve) -> dict[str, Column]:
    """A double per column in the order of its values: of strings the bytes behind the prefix that all share."""
    shared = shared_digits(docs, [n for n in curve.columns if _is_text(docs, n)])
    out = {}
    for name in curve.columns:
        if name in shared:
            digits = F.hex(F.substring(docs[name].cast("binary"), 1 + shared[name] // 2, CODED))
            out[name] = F.conv(F.rpad(digits, 2 * CODED, "0"), 16, 10).cast("double")
        else:
            out[name] = _number(docs, name)
    return out


def cuts(keys: DataFrame, curve: Curve, distinct: set[int]) -> list[list[float]]:
    """Ascending lower ends of the cells of each dimension ``d0``, ``d1``, ...: at most ``2**bits - 2`` numbers each."""
    inner = 2**curve.bits - 2
    probes = F.array(*[F.lit((i + 1) / (inner + 1)) for i in range(inner)])
    out = []
    for i in range(len(curve.columns)):
        values = keys.select(F.col(f"d{i}").alias("x")).where("x is not null")
        values = values.distinct() if i in distinct else values
        found = values.agg(F.percentile_approx("x", probes, F.lit(100 * (inner + 1))).alias("c")).first()["c"] if inner else None
        out.append(sorted(set(found or [])))
    return out


def on_curve(points: list[str], edges: list[list[float]], bits: int) -> Column:
    """Place on the curve from the columns ``points``."""

    @F.arrow_udf("bigint")
    def of(*columns: pa.Array) -> pa.Array:
        cells = []
        for column, edge in zip(columns, edges):
            x = column.to_numpy(zero_copy_only=False).astype(float)
            here = np.searchsorted(np.array(edge), x, side="right") + 1
            # Few cells are spread over the whole axis, so that each column has its say in the curve's leading bits.
            cells.append(np.where(np.isnan(x), 0, here) * 2**bits // (len(edge) + 2))
        return pa.array(curve_index(cells, bits), pa.int64())

    return of(*[F.col(p) for p in points])


def ordered(docs: DataFrame, curve: Curve = Curve()) -> DataFrame:
    """doc_id, size, text_crc32, curve (place on it), the curve's columns as ``d0``, ``d1``, ... and ``at``, from 0 on in order, of ``n``.

    The texts are read once; what is sorted are these narrow rows.
    """
    coded = codes(docs, curve)
    points = [f"d{i}" for i in range(len(curve.columns))]
    text = docs["text"].cast("string")
    keys = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), size_of(text).alias("size"), crc_of(text).alias("text_crc32"),
        *[c.alias(p) for p, c in zip(points, coded.values())], *[docs[n].alias(f"v{i}") for i, n in enumerate(curve.columns)],
        F.monotonically_increasing_id().alias("row"),
    )
    keys = written(docs.sparkSession, keys, "hilbert-keys")
    edges = cuts(keys, curve, {i for i, n in enumerate(curve.columns) if _is_text(docs, n)})
    placed = keys.withColumn("curve", on_curve(points, edges, curve.bits)).drop(*points)
    placed = placed.withColumnsRenamed({f"v{i}": p for i, p in enumerate(points)})
    return numbered(placed, [], ["curve", "text_crc32", "doc_id", "row"], "at", "n").drop("row")


def run_of(at: Column, n: Column, shards: int) -> dict[str, Column]:
    """Shard and place in it of the row at place ``at`` of ``n``: runs whose row counts differ by one at most."""
    size, more = F.floor(n / shards), n % shards
    long = at < more * (size + 1)
    rest = at - more * (size + 1)
    each = F.greatest(size, F.lit(1))
    return {
        "shard": F.when(long, F.floor(at / (size + 1))).otherwise(more + F.floor(rest / each)).cast("int"),
        "slot": F.when(long, at % (size + 1)).otherwise(rest % each).cast("bigint"),
    }


def shards(docs: DataFrame, count: int, curve: Curve = Curve()) -> DataFrame:
    """doc_id, size, text_crc32, curve, ``d0``, ``d1``, ..., shard (0 to ``count`` - 1) and slot (from 0 on) of every row."""
    if count < 1:
        raise ValueError("at least one shard is needed")
    rows = ordered(docs, curve)
    return rows.withColumns(run_of(F.col("at"), F.col("n"), count)).drop("at", "n")


def boxes(sharded: DataFrame, curve: Curve = Curve()) -> DataFrame:
    """Per shard its rows, bytes, and least and greatest value and nulls of each column: what a reader prunes by."""
    ends = []
    for i, name in enumerate(curve.columns):
        ends += [F.min(f"d{i}").alias(f"min_{name}"), F.max(f"d{i}").alias(f"max_{name}"), F.count_if(F.col(f"d{i}").isNull()).alias(f"nulls_{name}")]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ends)


def may_hold(box: DataFrame, **wanted: object) -> DataFrame:
    """The shards whose box can hold a row with these values; a pair is a range with both ends."""
    for name, value in wanted.items():
        low, high = value if isinstance(value, tuple) else (value, value)
        box = box.where((F.col(f"min_{name}") <= F.lit(high)) & (F.col(f"max_{name}") >= F.lit(low)))
    return box

"""Quality rules: compression bands over whole documents and fixed chunks, beside plain counts.

zstandard shrinks repetitive text far more than prose and random text hardly at all. How far prose shrinks depends on its
length, so every band of lengths has its own limits. Chunks of a fixed size find documents whose average looks right but of
which most is repetition or noise.

Null text counts as no words. Empty and one-word texts have no chunks and no ratio of their own to fail; the plain rule on
the number of words rejects them. Repeated rows get equal verdicts, each row by itself; other columns are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import doc_rows, nothing_held


@dataclass(frozen=True)
class Bands:
    """``limits``: (bytes below which it holds, lowest ratio, highest ratio) in ascending order, the last for all longer texts.

    They are the lowest and highest ratios of the documents of sf0.1 that are labelled good and pass the plain counts, and of
    their chunks, plus 0.10 above, and below less 0.12 or half the way to base64 lines of that length where that is nearer. The
    first and the last band, with 3 and 19 of these, are wider by hand.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (128, 1.05, 1.4),
        (192, 1.12, 1.54),
        (256, 1.18, 1.67),
        (384, 1.27, 1.76),
        (512, 1.34, 1.94),
        (768, 1.39, 2.0),
        (1_024, 1.49, 2.07),
        (1_536, 1.6, 2.14),
        (2_048, 1.72, 2.25),
        (3_072, 1.8, 2.26),
        (4_096, 1.9, 2.32),
        (8_192, 1.95, 2.44),
        (16_384, 2.09, 2.51),
        (float("inf"), 2.0, 3.0),
    )
    level: int = 3
    chunk: int = 4_096
    #: A document fails when more than this share of its bytes lies in chunks outside their band.
    bad_share: float = 0.5
    #: A text fails that has this many symbols or fewer, all about as frequent (entropy over that of even use): hex digits, which
    #: shrink like prose in short texts. Good documents stay below 0.91.
    symbols: int = 22
    even: float = 0.96

    def outside(self, size: int, ratio: float) -> bool:
        low, high = next((a, b) for most, a, b in self.limits if size < most)
        return not low <= ratio <= high


# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SCHEMA = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,"
    "ratio:double,bad_bytes:bigint,kept:boolean>"
)
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by windows of eight that occur twice or more, all occurrences included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    if len(np.unique(mixed)) == n:  # equal windows have equal codes, so none repeats
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:  # ids of pairs, of four words, of eight
        _, ids = np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)
        step *= 2
    twice = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def few_symbols(raw: bytes, bands: Bands) -> bool:
    """Whether the bytes beside blanks are few and evenly used."""
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counts[list(BLANKS.encode())] = 0
    used = counts[counts > 0]
    if not 2 <= len(used) <= bands.symbols:
        return False
    p = used / used.sum()
    return -(p * np.log2(p)).sum() >= bands.even * np.log2(len(used))


def measured(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
    bad = 0
    if len(raw) > bands.chunk:
        view = memoryview(raw)
        for at in range(0, len(raw), bands.chunk):
            part = view[at : at + bands.chunk]
            if bands.outside(len(part), len(part) / len(press.compress(part))):
                bad += len(part)
    kept = not failed and not bands.outside(len(raw), ratio) and bad <= bands.bad_share * len(raw) and not few_symbols(raw, bands)
    chars = len(text) - sum(map(text.count, BLANKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeats, failed, ratio, bad, kept


def measures(text: Column, bands: Bands = Bands()) -> Column:
    """Struct of counts, ratio, bytes in bad chunks and the verdict ``kept`` for one text column."""

    @F.arrow_udf(SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        nothing_held()
        press = zstandard.ZstdCompressor(level=bands.level)
        rows = [measured(t.as_py(), bands, press) for t in texts]
        names = [part.split(":")[0] for part in SCHEMA[7:-1].split(",")]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return of(text)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """doc_id with counts, ratio and verdict of every document."""
    return doc_rows(docs).select("doc_id", measures(F.col("text"), bands).alias("m")).select("doc_id", "m.*")


def accepted(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows that pass, with all their columns as they were."""
    return docs.where(measures(docs["text"].cast("string"), bands)["kept"])

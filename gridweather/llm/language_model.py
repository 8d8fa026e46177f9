"""Interpolated modified Kneser-Ney model of word pairs, counted in Spark, looked up in memory-mapped arrays.

Map tasks count the word pairs of their documents and hand on sorted, packed arrays by bucket; one task per bucket merges them
and writes sorted hash arrays into the shared folder. Scoring tasks map those files and search them, so a worker holds only the
pages it touches. The number of buckets follows the number of tokens, so a bucket stays of one size at any scale.

A pair's probability is its discounted count over its context's, plus the context's freed mass times the probability of the
word by the number of different contexts it ends, itself discounted against a uniform share for unknown words. The three
discounts of each order come from the counts of counts.

Null text counts as empty: its end alone is scored. Repeated rows are counted and scored each by itself. With nothing to learn
from, every token has probability one.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from gridweather import session
from gridweather.llm.common import doc_rows, written

#: Word codes have 48 bits; these two stand for the end of a text and for what is before it.
CODE, END, BEGIN = (1 << 48) - 1, 0, 1
SPREAD = 0x9E3779B97F4A7C15
#: Tokens whose pairs make up one bucket, and tokens counted or scored at once.
BUCKET_TOKENS, AT_ONCE = 2_000_000, 1_000_000
#: Word codes a worker keeps before it starts afresh; bounds memory, changes no result.
KEEP = 300_000


@dataclass(frozen=True)
class Model:
    """``folder`` holds pair, context and word arrays by bucket; numbers are of the training tokens."""

    folder: str
    buckets: int
    tokens: int
    vocabulary: int
    pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]


_codes: dict[bytes, int] = {}


def codes(text: str | None) -> list[int]:
    """Codes of the words, then of the end; only A-Z change case and only ASCII blanks split."""
    out = []
    get = _codes.get
    for w in (text or "").encode("utf-8", "surrogatepass").lower().split():
        code = get(w)
        if code is None:
            if len(_codes) >= KEEP:
                _codes.clear()
            code = _codes[w] = max(2, xxhash.xxh64_intdigest(w) & CODE)
        out.append(code)
    out.append(END)
    return out


def sequences(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, and where each text begins."""
    words, starts = [], []
    for t in texts:
        starts.append(len(words))
        words += codes(t)
    words = np.array(words, np.uint64)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts] = BEGIN
    return before, words, np.array(starts, np.int64)


def portions(texts):
    """Lists of texts with about ``AT_ONCE`` tokens; a text is never cut."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) // 5 + 1 if t else 1
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def place(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code * np.uint64(SPREAD)) >> np.uint64(40)) % np.uint64(buckets)


def pair_key(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    mixed = (before ^ np.uint64(0xA5A5A5A5)) * np.uint64(SPREAD)
    mixed = ((mixed ^ (mixed >> np.uint64(31))) + words) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the key columns in order, and their sums."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers, the first ascending, as differences, byte planes and zstandard."""
    first = np.diff(columns[0], prepend=np.uint64(0))
    planes = np.stack([first, *columns[1:]]).astype("<u8").view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return np.uint64(len(columns)).tobytes() + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.uint64)[0])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8)
    columns = np.ascontiguousarray(raw.reshape(n, 8, -1).transpose(0, 2, 1)).reshape(n, -1).view("<u8")
    return [np.cumsum(columns[0].reshape(-1), dtype=np.uint64), *[c.reshape(-1) for c in columns[1:]]]


def split(columns: list[np.ndarray], buckets: int):
    """(bucket, packed columns) by the place of the first column."""
    at = place(columns[0], buckets)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), pack([c[order[edges[b] : edges[b + 1]]] for c in columns])


def shared_path(spark, name: str) -> str:
    """New folder that driver and executors reach as files; a mapped file needs a mounted path."""
    path = urlparse(session.new_folder(spark, name))
    if path.scheme not in ("", "file"):
        raise ValueError(f"the language model maps files: spark.checkpoint.dir must be a mounted path, not {path.scheme}://")
    os.makedirs(path.path, exist_ok=True)
    return path.path


def save(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Each column as a file; written aside and moved, so a task that runs twice leaves the same whole files."""
    for column, values in columns.items():
        aside = f"{folder}/.{name}.{column}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(aside, "wb") as f:
            np.save(f, values)
        os.replace(aside, f"{folder}/{name}.{column}.npy")


def load(folder: str, name: str, column: str) -> np.ndarray:
    path = f"{folder}/{name}.{column}.npy"
    if not os.path.exists(path):
        return np.empty(0, np.uint64)
    return np.load(path, mmap_mode="r")


def discounts(counts: list[int]) -> tuple[float, float, float]:
    """From how many counts are 1, 2, 3, 4; plain steps where the corpus is too small to tell."""
    n1, n2, n3, n4 = counts
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = []
    for k, low, high in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        d = k - (k + 1) * y * high / low if low and high else k * 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return tuple(out)


def discount_of(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)]


def fit(docs: DataFrame) -> Model:
    """Count pairs, words and contexts of all documents; what comes back to the driver is a row of numbers per bucket."""
    spark = docs.sparkSession
    rows = doc_rows(docs).select("text")
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(4, ((size["chars"] or 0) // 5 + size["n"]) // BUCKET_TOKENS + 1)
    folder = shared_path(spark, "language-model")

    def count(batches):
        held: list[np.ndarray] = []

        def hand_on():
            keys, sums = summed(*[[np.concatenate(c) for c in zip(*[h[i] for h in held])] for i in (0, 1)])
            held.clear()
            for bucket, blob in split([*keys, *sums], buckets):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "blob": pa.array([blob], pa.binary())})

        waiting = 0
        for batch in batches:
            for part in portions([t.as_py() for t in batch.column("text")]):
                before, words, _ = sequences(part)
                held.append(summed([before, words], [np.ones(len(words), np.uint64)]))
                waiting += len(held[-1][0][0])
                if waiting > 4 * AT_ONCE:
                    yield from hand_on()
                    waiting = 0
        if held:
            yield from hand_on()

    def merge(key, group):
        blobs = group.column("blob").to_pylist()
        bucket = key[0].as_py()
        columns = [np.concatenate(c) for c in zip(*map(unpack, blobs))]
        (before, words), (n,) = summed(columns[:2], [columns[2]])
        keys = pair_key(before, words)
        order = np.argsort(keys)
        save(folder, f"pairs-{bucket}", {"key": keys[order], "n": n[order].astype(np.uint32)})
        contexts = [n] + [(n == k).astype(np.uint64) for k in (1, 2)] + [(n >= 3).astype(np.uint64)]
        (context,), sums = summed([before], contexts)
        save(folder, f"contexts-{bucket}", {"key": context, **{name: s.astype(np.uint64) for name, s in zip(("n", "n1", "n2", "n3"), sums)}})
        (ends,), (types, total) = summed([words], [np.ones(len(words), np.uint64), n])
        stats = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        out = [(b, blob) for b, blob in split([ends, types, total], buckets)]
        return pa.Table.from_pydict(
            {"bucket": pa.array([b for b, _ in out] + [-1], pa.int64()), "blob": pa.array([x for _, x in out] + [None], pa.binary()), "stats": pa.array([None] * len(out) + [[*stats, len(n), int(n.sum())]], pa.list_(pa.int64()))}
        )

    def words_of(key, group):
        blobs = group.column("blob").to_pylist()
        columns = [np.concatenate(c) for c in zip(*map(unpack, blobs))]
        (code,), (types, total) = summed(columns[:1], columns[1:])
        save(folder, f"words-{key[0].as_py()}", {"key": code, "types": types.astype(np.uint32), "n": total})
        return pa.Table.from_pydict({"stats": pa.array([[*[int((types == k).sum()) for k in (1, 2, 3, 4)], len(code)]], pa.list_(pa.int64()))})

    counted = rows.mapInArrow(count, "bucket bigint, blob binary")
    merged = written(spark, counted.groupBy("bucket").applyInArrow(merge, "bucket bigint, blob binary, stats array<bigint>"), "model-words")
    ended = merged.where("bucket >= 0").select("bucket", "blob").groupBy("bucket").applyInArrow(words_of, "stats array<bigint>")
    total = lambda df, n: [int(x or 0) for x in df.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()]
    *of_words, vocabulary = total(ended, 5)
    *of_pairs, pairs, tokens = total(merged.where("bucket < 0"), 6)
    return Model(folder, int(buckets), tokens, vocabulary, pairs, discounts(of_pairs), discounts(of_words))


class Lookup:
    """The model's arrays as one worker maps them."""

    def __init__(self, model: Model):
        self.model = model
        self.maps: dict[tuple[str, str], np.ndarray] = {}

    def column(self, name: str, column: str) -> np.ndarray:
        if (name, column) not in self.maps:
            self.maps[name, column] = load(self.model.folder, name, column)
        return self.maps[name, column]

    def find(self, table: str, at: np.ndarray, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """Values of ``columns`` for keys in ascending order within their bucket, 0 where absent."""
        out = [np.zeros(len(keys), np.float64) for _ in columns]
        edges = np.searchsorted(at, np.arange(self.model.buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(edges)):
            part = slice(edges[b], edges[b + 1])
            held = self.column(f"{table}-{b}", "key")
            if not len(held):
                continue
            spot = np.minimum(np.searchsorted(held, keys[part]), len(held) - 1)
            hit = held[spot] == keys[part]
            for values, column in zip(out, columns):
                values[part][hit] = self.column(f"{table}-{b}", column)[spot[hit]]
        return out

    def by_bucket(self, table: str, codes: np.ndarray, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        at = place(codes, self.model.buckets)
        order = np.lexsort((keys, at))
        found = self.find(table, at[order], keys[order], columns)
        out = []
        for values in found:
            back = np.empty_like(values)
            back[order] = values
            out.append(back)
        return out

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and model log10 probability of each text."""
        m = self.model
        before, words, starts = sequences(texts)
        (context, word), (times,) = summed([before, words], [np.ones(len(words), np.uint64)])
        single, where = np.unique(word, return_inverse=True)
        types, count = self.by_bucket("words", single, single, ("types", "n"))
        uniform = 1.0 / (m.vocabulary + 1)
        if m.pairs:
            freed = self.word_mass()
            lower = np.maximum(types - discount_of(types, m.word_discounts), 0) / m.pairs + freed * uniform
        else:
            lower = np.full(len(single), uniform)
        some, back = np.unique(context, return_inverse=True)
        n, n1, n2, n3 = self.by_bucket("contexts", some, some, ("n", "n1", "n2", "n3"))
        d1, d2, d3 = m.discounts
        left = np.divide(d1 * n1 + d2 * n2 + d3 * n3, n, out=np.ones_like(n), where=n > 0)
        (c,) = self.by_bucket("pairs", context, pair_key(context, word), ("n",))
        high = np.divide(np.maximum(c - discount_of(c, m.discounts), 0), n[back], out=np.zeros_like(c), where=n[back] > 0)
        p = np.log10(high + left[back] * lower[where])
        base = np.log10((count + 1) / (m.tokens + m.vocabulary + 1))
        # Back from distinct pairs to the tokens of each text.
        order = np.lexsort((words, before))
        spot = np.empty(len(words), np.int64)
        spot[order] = np.repeat(np.arange(len(times)), times.astype(np.int64))
        known = (count > 0).astype(np.int64)[where]
        sums = [np.add.reduceat(x[spot], starts) for x in (known, base[where], p)]
        return np.diff(np.append(starts, len(words))), *sums

    def word_mass(self) -> float:
        """Mass freed by the discounts of the lower order; its counts of counts are summed once per worker."""
        if not hasattr(self, "_mass"):
            total = 0.0
            for b in range(self.model.buckets):
                types = self.column(f"words-{b}", "types")
                total += float(discount_of(np.asarray(types), self.model.word_discounts).sum()) if len(types) else 0.0
            self._mass = total / self.model.pairs
        return self._mass


_lookups: dict[str, Lookup] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) for every row."""

    def work(batches):
        if model.folder not in _lookups:
            _lookups.clear()
            _lookups[model.folder] = Lookup(model)
        lookup = _lookups[model.folder]
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for part in portions([t.as_py() for t in batch.column("text")]):
                n, known, base, p = lookup.scores(part)
                columns = [ids.slice(at, len(part)), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(part), model.tokens), pa.int64()), pa.array(base), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                at += len(part)

    return doc_rows(docs).mapInArrow(work, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

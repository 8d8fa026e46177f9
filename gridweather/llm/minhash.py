"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct word shingles. One permutation scatters the shingles over a universe of 2^32 places; a
second one, shifted circularly by 0, 1, 2, ... places, gives every coordinate of the signature: two permutations in all,
whatever the length. Bands of coordinates propose pairs, and a pair is linked only if its full sets are similar enough.

Equal sets meet first, as one class, so copies are never paired. Within a bucket every class is compared with the bucket's
most connected class, which grows in line with the bucket. Linked classes join a component. Only buckets that still hold
several components go on: there, the classes outside the main component are compared with all others, block by block. So no
proposed link between different texts is lost, and none is looked for that could not change a component.

Null and empty texts have no shingles and link with nothing. Rows that repeat a doc_id are one document, linked to whatever any
of them is. A null doc_id has no component and is kept. Ties between equal sets go to the smallest doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import doc_rows, handed_back, nothing_held, written

# Multipliers of the mixing steps; any odd numbers with well spread bits do.
SPREAD, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0x85EBCA6B, 0xC2B2AE35
#: Word codes a task keeps before it starts afresh; bounds memory, changes no result.
KEEP = 200_000
#: Shingles handled at once, so that the working arrays stay in the processor's cache.
CHUNK = 1 << 15
#: Sets in a block, and shingles that a comparison of two blocks lays out at once.
BLOCK, COLUMNS = 256, 8_192


@dataclass(frozen=True)
class Similarity:
    """Words in a shingle, least similarity in percent, and bands of rows.

    A pair with similarity s is proposed with probability 1 - (1 - s^rows)^bands: at 0.85 it is missed once in 10^8, at 0.8
    once in 10^5.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6


def word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    out = np.empty(len(words), np.uint64)
    get = known.get
    for i, w in enumerate(words):
        code = get(w)
        if code is None:
            if len(known) >= KEEP:
                known.clear()
            code = known[w] = xxhash.xxh64_intdigest(w)
        out[i] = code
    return out


def shingles(text: str | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    if not words:
        return np.empty(0, np.uint64)
    codes = word_codes(words, known)
    size = min(size, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        mixed = (mixed ^ codes[j : j + len(mixed)]) * np.uint64(SPREAD)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def band_codes(sets: list[np.ndarray], how: Similarity) -> np.ndarray:
    """(sets, bands) codes; no set may be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    # The first permutation: an odd multiplier permutes 64 bits, of which the upper half is the place.
    places = ((flat * np.uint64(SPREAD)) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), how.bands), np.uint64)
    work, shifted = np.empty_like(places), np.empty_like(places)
    for k in range(how.bands * how.rows):
        # The second permutation, shifted by k places.
        np.subtract(places, np.uint32(k), out=work)
        np.right_shift(work, 16, out=shifted)
        np.bitwise_xor(work, shifted, out=work)
        np.multiply(work, np.uint32(MIX_A), out=work)
        np.right_shift(work, 13, out=shifted)
        np.bitwise_xor(work, shifted, out=work)
        np.multiply(work, np.uint32(MIX_B), out=work)
        np.right_shift(work, 16, out=shifted)
        np.bitwise_xor(work, shifted, out=work)
        least = np.minimum.reduceat(work, starts)
        band = k // how.rows
        column = (out[:, band] ^ (least.astype(np.uint64) + np.uint64(band << 32))) * np.uint64(SPREAD)
        out[:, band] = column ^ (column >> np.uint64(31))
    return out


def signatures(rows: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, n, digest (null without shingles), bands."""

    def work(batches):
        nothing_held()
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(t.as_py(), how.shingle, known) for t in batch.column("text")]
            bands: list[list[int] | None] = [None] * len(sets)
            group: list[int] = []
            size = 0
            for i, s in enumerate(sets):
                if len(s):
                    group.append(i)
                    size += len(s)
                if group and (size >= CHUNK or i == len(sets) - 1):
                    for j, row in zip(group, band_codes([sets[j] for j in group], how).view(np.int64)):
                        bands[j] = row
                    group, size = [], 0
            digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n", "digest", "bands"],
            )
        known.clear()
        handed_back()

    return rows.mapInArrow(work, "doc_id bigint, n bigint, digest binary, bands array<bigint>")


def full_sets(rows: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, n, shingles."""

    def work(batches):
        nothing_held()
        known: dict[bytes, int] = {}
        for batch in batches:
            # Long texts make long sets: hand them on in small parts.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), how.shingle, known).view(np.int64) for t in part.column("text")]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), lists], ["doc_id", "n", "shingles"])
        known.clear()
        handed_back()

    return rows.mapInArrow(work, "doc_id bigint, n bigint, shingles array<bigint>")


def alike(n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return (100 * F.least(n_a, n_b)) >= (percent * F.greatest(n_a, n_b))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a, b).

    Ids take the smallest label around them, then the label of their label, until nothing changes; every round is written.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(spark, both.distinct(), "links")
    labels = written(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_near").alias("_near"))
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "_near").alias("_next"))
        jump = labels.select(F.col("id").alias("_next"), F.col("component").alias("_far"))
        moved = written(spark, nearer.join(jump, "_next").select("id", F.col("component").alias("_was"), F.least("_next", "_far").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where("component != _was").isEmpty():
            return labels


def left_over(members: DataFrame, found: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) within buckets between components, other than to the bucket's head.

    Classes outside their head's component meet all classes of the head's buckets in blocks: a task compares two blocks of about
    ``BLOCK`` sets and returns only links, so neither a bucket nor its pairs ever lie in one task.
    """
    spark = members.sparkSession
    of_rep, of_head = found.select(F.col("id").alias("rep"), "component"), found.select(F.col("id").alias("head"), F.col("component").alias("main"))
    placed = members.join(of_rep, "rep", "left").join(of_head, "head", "left")
    placed = placed.select("head", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("main", "head").alias("main"))
    placed = placed.where("rep != head").select("head", "rep", "component", (F.col("component") != F.col("main")).alias("apart")).distinct()
    placed = written(spark, placed, "placed")
    blocks = placed.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_of_all"), F.ceil(F.sum(F.col("apart").cast("int")) / BLOCK).alias("_of_apart")).where("_of_apart > 0")
    placed = placed.join(written(spark, blocks, "blocks"), "head")

    def side(rows: DataFrame, first: bool) -> DataFrame:
        """Rows of one side, each in its own block and repeated for every block of the other side."""
        own, other = ("_of_apart", "_of_all") if first else ("_of_all", "_of_apart")
        mine = F.pmod(F.xxhash64("rep", F.lit(first)), F.col(own)).alias("x" if first else "y")
        theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias("y" if first else "x")
        return rows.select("head", "rep", "component", F.lit(first).alias("first"), mine, theirs).select("head", "x", "y", "rep", "component", "first")

    rows = side(placed.where("apart"), True).union(side(placed, False))
    rows = rows.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    percent = how.percent

    def compare(key, group):
        first = np.array(group.column("first").to_pylist(), bool)
        ids, parts = np.array(group.column("rep").to_pylist(), np.int64), np.array(group.column("component").to_pylist(), np.int64)
        held = group.column("shingles").combine_chunks()
        sizes = np.diff(np.asarray(held.offsets))
        values, owner = np.asarray(held.values), np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(values, kind="stable")
        owner = owner[order]
        number = np.cumsum(np.concatenate([[0], np.diff(values[order]) != 0]))
        u, m = np.flatnonzero(first), np.flatnonzero(~first)
        row = np.empty(len(ids), np.int64)
        row[u], row[m] = np.arange(len(u)), np.arange(len(m))
        common = np.zeros((len(u), len(m)), np.float32)
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
            at = slice(*np.searchsorted(number, [low, low + COLUMNS]))
            have = [np.zeros((len(x), COLUMNS), np.float32) for x in (u, m)]
            for matrix, mine in zip(have, (first[owner[at]], ~first[owner[at]])):
                matrix[row[owner[at][mine]], number[at][mine] - low] = 1
            common += have[0] @ have[1].T
        common = common.astype(np.int64)
        union = sizes[u][:, None] + sizes[m][None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (parts[u][:, None] != parts[m][None, :]))
        return pa.Table.from_pydict({"a": pa.array(ids[u[i]], pa.int64()), "b": pa.array(ids[m[j]], pa.int64())})

    return rows.groupBy("head", "x", "y").applyInArrow(compare, "a bigint, b bigint").distinct()


def same_id(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) from every id of several rows to the classes of its texts, so that its rows share a component."""
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    texts = named.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    return texts.join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")


def near_duplicates(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    rows = doc_rows(docs)
    marks = written(spark, signatures(rows, how), "signatures")
    named = marks.where("digest is not null and doc_id is not null")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(spark, classes, "classes")
    places = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    shared = written(spark, places.join(sizes, "bucket"), "shared-buckets")
    # The class that meets most others in its buckets is the likeliest origin of a group of edited copies.
    met = shared.groupBy("rep").agg(F.sum("_size").alias("met"))
    shared = written(spark, shared.join(met, "rep").select("bucket", "rep", "n", "met"), "members")
    heads = shared.groupBy("bucket").agg(F.min(F.struct((-F.col("met")).alias("less"), "rep", "n")).alias("head"))
    members = shared.join(heads, "bucket").select("bucket", "rep", "n", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n"))
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(spark, full_sets(rows.where("doc_id is not null").join(needed, "doc_id", "left_semi"), how), "sets")
    pairs = members.where(F.col("rep") != F.col("head")).where(alike(F.col("n"), F.col("head_n"), how.percent))
    links = written(spark, linked(pairs.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), sets, how.percent), "links-first")
    links = links.union(written(spark, same_id(named, classes), "links-ids"))
    found = components(links)
    more = written(spark, left_over(members, found, sets, how), "links-rest")
    if not more.isEmpty():
        found = components(links.union(more))
    of_class = classes.select("digest", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep")
    of_class = written(spark, of_class.select("digest", "component").union(_unlinked(classes, found)), "class-components")
    of_text = marks.where("digest is not null").select("doc_id", "n", "digest").join(of_class, "digest", "left")
    # A row without shingles belongs where other rows of its id do.
    of_empty = marks.where("digest is null").join(found, F.col("doc_id") == F.col("id"), "left")
    out = of_text.select("doc_id", "n", "component").union(of_empty.select("doc_id", "n", "component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unlinked(classes: DataFrame, found: DataFrame) -> DataFrame:
    return classes.join(found.select(F.col("id").alias("rep")), "rep", "left_anti").select("digest", F.col("rep").alias("component"))


def deduplicated(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """Rows of the documents that stay, one of each group, with all their columns; rows without an id stay."""
    dropped = near_duplicates(docs, how).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")

"""Exact k nearest neighbours without comparing every pair.

Training rows are sorted into regions. Vectors of few numbers go to the boxes of a tree, cut at the medians of a sample, so a
box has some thousands of rows however many there are: a query looks into its own box first and then into those that its k-th
distance reaches, found by walking down the tree. Longer vectors go to the nearest of a few pivots, cut into rings by distance
from it; a query takes the radius that is sure to hold k rows and by the triangle inequality skips every region that lies
wholly beyond it. Queries meet regions block by block. Blocks have bounded rows on both sides, so a crowded region or a popular
place becomes more blocks, not a larger one. Only k rows per query and block leave a task. A vector with a null or NaN has no
distance: it is nobody's neighbour and has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gridweather import session
from gridweather.functions.hashing import h

DISTANCE_FLOOR = 1e-6
BLOCK_ROWS = 20_000
MOST_PIVOTS = 256
MOST_RINGS = 64
LOOK_CELLS = 1_000_000
#: Up to so many numbers a vector goes to a box; of longer ones, a ball reaches into nearly every box.
BOX_DIMS = 12
BOX_ROWS = 4_096
#: Sample that cuts the boxes: so many rows a box, and at most so many in all, which come to the driver.
SAMPLE_A_BOX = 16
MOST_SAMPLE = 400_000
#: Pairs of rows that a task of the meeting is to compare.
TASK_PAIRS = 200_000_000


def _pivot_distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * vectors @ pivots.T
    return np.sqrt(np.maximum(d2, 0.0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _assign(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``_cell`` and the distance ``_r`` from it."""
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                d = _pivot_distances(_stack(part[vec]), pivots)
                cell = d.argmin(1)
                yield part.assign(_cell=cell.astype("int32"), _r=d[np.arange(len(part)), cell])

    return df.mapInPandas(run, schema)


def _regions(assigned: DataFrame, block_rows: int):
    """Rings per cell. Only numbers about regions come back: at most pivots x rings rows."""
    per_cell = assigned.groupBy("_cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_r", [i / MOST_RINGS for i in range(1, MOST_RINGS)], 1000).alias("cuts")
    )
    edges: dict[int, list[float]] = {}
    for row in per_cell.collect():
        rings = min(MOST_RINGS, ceil(row["n"] / block_rows))
        picks = sorted({row["cuts"][min(len(row["cuts"]) - 1, round(i * MOST_RINGS / rings) - 1)] for i in range(1, rings)})
        edges[row["_cell"]] = picks
    by_cell = F.create_map(*[x for c, e in edges.items() for x in (F.lit(c), F.array(*[F.lit(v) for v in e]).cast("array<double>"))])
    ring = F.size(F.filter(F.element_at(by_cell, F.col("_cell")), lambda v: v < F.col("_r")))
    ringed = assigned.withColumn("_region", F.col("_cell") * (MOST_RINGS + 1) + ring)
    stats = ringed.groupBy("_region").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("near"), F.max("_r").alias("far")).collect()
    return ringed, stats


def _rings(train: DataFrame, path: str, rows: int, dims: int, k: int, block_rows: int, seed: int):
    count = min(MOST_PIVOTS, max(1, int(sqrt(rows) / 2)))
    chosen = train.select("train_id", "vec").orderBy(h(seed, F.col("train_id")), "train_id").limit(count).collect()
    pivots = np.array([row["vec"] for row in chosen], dtype=np.float64)
    _assign(train, "vec", pivots).write.parquet(path)
    ringed, stats = _regions(train.sparkSession.read.parquet(path), block_rows)
    return ringed.drop("_cell", "_r"), _RegionFacts(pivots, stats, k)


def _boxes(train: DataFrame, path: str, rows: int, dims: int, k: int, block_rows: int, seed: int):
    """Every row in its box. A sample by the hash of the id places the cuts; counts and bounds of the boxes are of all rows."""
    boxes = ceil(rows / min(BOX_ROWS, block_rows))
    some = F.lit(True)
    if (wanted := min(MOST_SAMPLE, boxes * SAMPLE_A_BOX)) < rows:
        some = h(seed, F.col("train_id")) % 1_000_000 < ceil(1_000_000 * wanted / rows)
    sample = train.where(some).select(F.col("vec").cast("array<double>").alias("vec")).limit(2 * MOST_SAMPLE) if boxes > 1 else None
    drawn = np.empty((0, dims)) if sample is None else np.array(sample.toArrow()["vec"].combine_chunks().flatten()).reshape(-1, dims)
    tree = _BoxFacts(drawn, boxes, k)
    schema = T.StructType([*train.schema.fields, T.StructField("_region", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(_region=tree.box(_stack(part["vec"])).astype("int32"))

    train.mapInPandas(run, schema).write.parquet(path)
    placed = train.sparkSession.read.parquet(path)
    ends = [f(F.col("vec")[i].cast("double")) for f in (F.min, F.max) for i in range(dims)]
    tree.measure(placed.groupBy("_region").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).collect(), dims)
    return placed, tree


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vec: str = "vec",
    train_id: str = "train_id",
    query_id: str = "query_id",
    carry: list[str] = (),
    block_rows: int = BLOCK_ROWS,
    seed: int = 1,
) -> DataFrame:
    """Rows (query_id, train_id, sq_distance, rank, *carry): the k nearest training rows of each query, ties by id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = train.sparkSession
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    train = train.select(F.col(train_id).alias("train_id"), F.col(vec).alias("vec"), *carry)
    queries = queries.select(F.col(query_id).alias("query_id"), F.col(vec).alias("vec")).where(whole)
    rows, dims = train.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if k > rows:
        raise ValueError(f"k={k} exceeds the training set size ({rows})")
    train = train.where(whole)
    folder = session.new_folder(spark, "neighbours")
    # The assignment is the index of the search; it is written once and scanned by every later step.
    index = _boxes if dims <= BOX_DIMS else _rings
    ringed, facts = index(train, f"{folder}/train", rows, dims, k, block_rows, seed)
    qtype, vtype = (queries.schema[c].dataType.simpleString() for c in ("query_id", "vec"))
    visit_schema = f"query_id {qtype}, vec {vtype}, reach double, _regions array<int>"
    meeting = _Meeting(train, ringed, facts, k, list(carry), qtype, block_rows, seed)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                reach, first, _ = facts.look(_stack(part["vec"]))
                yield pd.DataFrame({"query_id": part["query_id"], "vec": part["vec"], "reach": reach, "_regions": first})

    # First the regions around the query: their k-th distance is a far better bound than the regions' radii.
    near = meeting.run(queries.mapInPandas(home, visit_schema))
    near.write.parquet(f"{folder}/near")
    near = spark.read.parquet(f"{folder}/near")
    bound = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.sqrt(F.max("sq_distance")).alias("_kth"))
    bounded = queries.join(bound, "query_id").select("query_id", "vec", F.when(F.col("_n") >= k, F.col("_kth")).alias("_kth"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                reach, _, others = facts.look(_stack(part["vec"]), part["_kth"].to_numpy(dtype=np.float64))
                yield pd.DataFrame({"query_id": part["query_id"], "vec": part["vec"], "reach": reach, "_regions": others})

    far = meeting.run(bounded.mapInPandas(rest, visit_schema))
    return _first_k(near.unionByName(far), k)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("sq_distance", "train_id")
    return found.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class _RegionFacts:
    """Row counts and radii of all regions, and what they say about a query."""

    def __init__(self, pivots: np.ndarray, stats: list, k: int):
        self.pivots, self.k = pivots, k
        self.region = np.array([row["_region"] for row in stats])
        self.size = np.array([row["n"] for row in stats])
        self.near, self.far = (np.array([row[c] for row in stats]) for c in ("near", "far"))
        self.cell = self.region // (MOST_RINGS + 1)

    def look(self, vectors: np.ndarray, kth: np.ndarray | None = None):
        """Distance sure to hold k rows, the regions that give it, and the other regions that reach within it.

        Queries go in slices, so that a table of queries by regions has a fixed size whatever the number of regions.
        """
        step = max(1, LOOK_CELLS // max(1, len(self.region)))
        slices = [slice(i, i + step) for i in range(0, len(vectors), step)]
        reach, first, others = zip(*[self._look(vectors[at], None if kth is None else kth[at]) for at in slices])
        return np.concatenate(reach), list(chain.from_iterable(first)), list(chain.from_iterable(others))

    def _look(self, vectors: np.ndarray, kth: np.ndarray | None):
        d = _pivot_distances(vectors, self.pivots)[:, self.cell]
        upper = d + self.far[None, :]
        order = np.argsort(upper, axis=1, kind="stable")
        last = (np.cumsum(self.size[order], axis=1) >= self.k).argmax(1)
        reach = np.take_along_axis(upper, order, 1)[np.arange(len(d)), last]
        first = [self.region[o[: n + 1]].tolist() for o, n in zip(order, last)]
        if kth is not None:
            reach = np.fmin(reach, kth)
        slack = 1e-7 * (1.0 + d.max(1) + self.far.max())
        lower = np.maximum(np.maximum(d - self.far[None, :], self.near[None, :] - d), 0.0)
        wanted = lower <= (reach + slack)[:, None]
        for i, (o, n) in enumerate(zip(order, last)):
            wanted[i, o[: n + 1]] = False
        return reach + slack, first, [self.region[w].tolist() for w in wanted]


class _BoxFacts:
    """A tree of cuts; its leaves are boxes numbered from left to right, so the boxes below a node are a run of numbers."""

    def __init__(self, sample: np.ndarray, boxes: int, k: int):
        self.k = k
        axis, cut, left, right, low, high = ([] for _ in range(6))

        def grow(rows: np.ndarray, boxes: int) -> int:
            node = len(axis)
            for column in (axis, cut, left, right, low, high):
                column.append(0)
            spread = rows.max(0) - rows.min(0) if len(rows) > 1 and boxes > 1 else np.zeros(1)
            if spread.max() <= 0:
                axis[node], low[node], self.boxes = -1, self.boxes, self.boxes + 1
                high[node] = self.boxes
                return node
            at = int(spread.argmax())
            values = np.sort(rows[:, at])
            # The middle value, or the next lower one where all values above the middle are the same.
            edge = values[(len(values) - 1) // 2]
            edge = edge if edge < values[-1] else values[np.searchsorted(values, edge) - 1]
            below = rows[:, at] <= edge
            axis[node], cut[node] = at, float(edge)
            share = min(boxes - 1, max(1, round(boxes * below.mean())))
            left[node] = grow(rows[below], share)
            right[node] = grow(rows[~below], boxes - share)
            low[node], high[node] = low[left[node]], high[right[node]]
            return node

        self.boxes = 0
        grow(sample, boxes)
        self.axis, self.left, self.right, self.low, self.high = (np.array(x) for x in (axis, left, right, low, high))
        self.cut = np.array(cut, dtype=np.float64)

    def measure(self, stats: list, dims: int) -> None:
        """Rows and bounds of every node, from those of the boxes; an empty one has none and is never reached."""
        size, bounds = np.zeros(self.boxes, np.int64), np.full((2, self.boxes, dims), np.inf)
        bounds[1] = -np.inf
        for row in stats:
            size[row["_region"]] = row["n"]
            bounds[:, row["_region"]] = np.reshape(row["ends"], (2, dims))
        self.region, self.size = np.arange(self.boxes), size
        self.rows = np.concatenate([[0], np.cumsum(size)])[self.high] - np.concatenate([[0], np.cumsum(size)])[self.low]
        self.least, self.most = np.empty((len(self.axis), dims)), np.empty((len(self.axis), dims))
        for node in range(len(self.axis) - 1, -1, -1):  # children come after their node
            if self.axis[node] < 0:
                self.least[node], self.most[node] = bounds[:, self.low[node]]
            else:
                both = [self.left[node], self.right[node]]
                self.least[node], self.most[node] = self.least[both].min(0), self.most[both].max(0)
        self.scale = float(max(np.abs(bounds[np.isfinite(bounds)]).max(initial=0.0), 0.0))

    def _descend(self, vectors: np.ndarray, least: int) -> np.ndarray:
        """The lowest node of at least so many rows on the way to each vector's box."""
        node = np.zeros(len(vectors), np.int64)
        moving = np.flatnonzero(self.axis[node] >= 0)
        while len(moving):
            at = node[moving]
            below = np.where(vectors[moving, self.axis[at]] <= self.cut[at], self.left[at], self.right[at])
            fits = np.ones(len(below), bool) if least == 0 else self.rows[below] >= least
            moving, below = moving[fits], below[fits]
            node[moving] = below
            moving = moving[self.axis[below] >= 0]
        return node

    def box(self, vectors: np.ndarray) -> np.ndarray:
        return self.low[self._descend(vectors, 0)]

    def look(self, vectors: np.ndarray, kth: np.ndarray | None = None):
        """Distance that bounds the search, the boxes of the nearest node with k rows, and the other boxes within that distance."""
        home = self._descend(vectors, self.k)
        low, high = self.low[home], self.high[home]
        if kth is None:
            return np.full(len(vectors), np.inf), [self._filled(a, b) for a, b in zip(low, high)], [[] for _ in home]
        kth = np.where(np.isnan(kth), np.inf, kth)
        reach = kth + 1e-7 * (1.0 + self.scale + np.abs(vectors).max(1))
        who, node, asked, found = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), [], []
        while len(who):
            away = np.maximum(np.maximum(self.least[node] - vectors[who], vectors[who] - self.most[node]), 0.0)
            # What lies wholly at home has been searched.
            wanted = (self.rows[node] > 0) & ~((self.low[node] >= low[who]) & (self.high[node] <= high[who]))
            wanted &= np.sqrt((away**2).sum(1)) <= reach[who]
            who, node = who[wanted], node[wanted]
            leaf = self.axis[node] < 0
            asked.append(who[leaf]), found.append(self.low[node[leaf]])
            who, node = np.repeat(who[~leaf], 2), np.stack([self.left[node[~leaf]], self.right[node[~leaf]]], 1).ravel()
        asked, found = np.concatenate(asked), np.concatenate(found)
        order = np.argsort(asked, kind="stable")
        ends = np.searchsorted(asked[order], np.arange(1, len(vectors)))
        return reach, [], [x.tolist() for x in np.split(found[order], ends)]

    def _filled(self, low: int, high: int) -> list[int]:
        return (low + np.flatnonzero(self.size[low:high])).tolist()


class _Meeting:
    """Compares queries with the rows of the regions they visit, in blocks of bounded size on both sides."""

    def __init__(self, train, ringed, facts, k, carry, qtype, block_rows, seed):
        self.ringed, self.facts, self.k, self.carry, self.block_rows, self.seed = ringed, facts, k, carry, block_rows, seed
        ttype = train.schema["train_id"].dataType.simpleString()
        extra = "".join(f", {c} {train.schema[c].dataType.simpleString()}" for c in carry)
        self.schema = f"query_id {qtype}, train_id {ttype}, sq_distance double{extra}"

    def run(self, visits: DataFrame) -> DataFrame:
        spark, path = visits.sparkSession, session.new_folder(visits.sparkSession, "visits")
        # Read by the count of callers and by the meeting; the regions are worked out once.
        visits.write.parquet(path)
        visits = spark.read.schema(visits.schema).parquet(path)
        visiting = visits.withColumn("_region", F.explode("_regions")).drop("_regions")
        callers = {row["_region"]: row["n"] for row in visiting.groupBy("_region").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes = dict(zip(self.facts.region.tolist(), self.facts.size.tolist()))
        slices = [(g, ceil(sizes[g] / self.block_rows), ceil(n / self.block_rows)) for g, n in callers.items()]
        if not slices:
            return _first_k(spark.createDataFrame([], self.schema), self.k)
        # One row per region, so it is small beside the rows it meets.
        parts = spark.createDataFrame(slices, "_region int, _t_parts int, _q_parts int")
        keys = ["_region", "_ts", "_qs"]
        # A fixed number of partitions: the blocks are small in bytes but not in work, so they must not be merged.
        blocks, pairs = sum(a * b for _, a, b in slices), sum(sizes[g] * n for g, n in callers.items())
        tasks = min(20_000, blocks, max(4 * spark.sparkContext.defaultParallelism, ceil(pairs / TASK_PAIRS)))
        left = self._sliced(visiting, parts, "query_id", "_qs", "_ts", "_q_parts", "_t_parts").repartition(tasks, *keys)
        right = self._sliced(self.ringed, parts, "train_id", "_ts", "_qs", "_t_parts", "_q_parts").repartition(tasks, *keys)
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(self.k, self.carry), self.schema)
        return _first_k(met, self.k)

    def _sliced(self, df: DataFrame, parts: DataFrame, ident: str, own: str, other: str, own_parts: str, other_parts: str) -> DataFrame:
        wide = df.join(F.broadcast(parts), "_region").withColumn(own, (h(self.seed, F.col(ident)) % F.col(own_parts)).cast("int"))
        return wide.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))).drop("_t_parts", "_q_parts")


def _meet(k: int, carry: list[str]):
    def meet(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "train_id", "sq_distance", *carry]
        if not len(asking) or not len(rows):
            return pd.DataFrame(columns=columns)
        rows = rows.sort_values("train_id", ignore_index=True)
        points, places = _stack(rows["vec"]), _stack(asking["vec"])
        reach = asking["reach"].to_numpy(dtype=np.float64)
        norms = (points**2).sum(1)
        who, what, how_far = [], [], []
        step = max(1, 4_000_000 // len(points))
        for start in range(0, len(places), step):
            q = places[start : start + step]
            own = (q**2).sum(1)
            # A cheap form of the distance picks candidates with a safe margin; the exact form decides.
            rough = norms[None, :] + own[:, None] - 2.0 * q @ points.T
            margin = 1e-9 * (1.0 + norms.max() + own)
            edge = reach[start : start + step] ** 2
            if len(points) > k:
                crowded = (rough <= edge[:, None]).sum(1) > 2 * k
                edge[crowded] = np.minimum(edge[crowded], np.partition(rough[crowded], k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(rough <= (edge + margin)[:, None])
            diff = points[j] - q[i]
            exact = np.einsum("ij,ij->i", diff, diff)
            order = np.lexsort((j, exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            who.append(i[keep] + start), what.append(j[keep]), how_far.append(exact[keep])
        who, what = np.concatenate(who), np.concatenate(what)
        out = rows.iloc[what][["train_id", *carry]].reset_index(drop=True)
        out.insert(0, "query_id", asking["query_id"].to_numpy()[who])
        out.insert(2, "sq_distance", np.concatenate(how_far))
        return out[columns]

    return meet


def inverse_distance_mean(neighbours: DataFrame, targets: list[str]) -> DataFrame:
    """Per query the mean of each target, weighted by inverse distance, and the mean distance."""
    d = F.sqrt("sq_distance")
    weight = F.lit(1.0) / F.greatest(d, F.lit(DISTANCE_FLOOR))
    rows = neighbours.withColumns({"_d": d, "_w": weight})
    means = [(F.sum(F.col("_w") * F.col(t)) / F.sum("_w")).alias(t) for t in targets]
    return rows.groupBy("query_id").agg(*means, F.avg("_d").alias("mean_distance"))

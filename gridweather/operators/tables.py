"""Table operations: pages, upserts, deletes, routing, key checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather.operators.attach import attach
from gridweather.functions.scalars import key_digest

PAGE_DEFAULT, PAGE_MOST = 10, 20


def page(df: DataFrame, newest: str, ident: str, number: int = 1, size: int = PAGE_DEFAULT) -> DataFrame:
    """One page, newest first, with the total rows and pages. Numbers that make no sense are refused.

    A page past the end is one row of nulls beside the totals.
    """
    if not isinstance(number, int) or isinstance(number, bool) or number < 1:
        raise ValueError("page must be a whole number from 1")
    if not isinstance(size, int) or isinstance(size, bool) or not 1 <= size <= PAGE_MOST:
        raise ValueError(f"limit must be a whole number from 1 to {PAGE_MOST}")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(F.desc(newest), F.desc(ident)).offset((number - 1) * size).limit(size)
    # At most ``PAGE_MOST`` rows are folded, so that the totals stay where there are none.
    held = rows.select(F.struct(F.col(newest).alias("_at"), F.col(ident).alias("_id"), F.struct(*df.columns).alias("_row")).alias("_r"))
    held = held.agg(F.sort_array(F.collect_list("_r"), asc=False).alias("_page"))
    out = attach(held, total).select(F.explode_outer("_page").alias("_p"), "total").select("_p._row.*", "total")
    return out.withColumn("total_pages", F.ceil(F.col("total") / size))


def top_per_group(df: DataFrame, keys: list[str], by: Column, tie: str, k: int) -> DataFrame:
    """The k largest per key; all but k rows per task and key are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(by.desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def largest_groups(df: DataFrame, key: str, least: int, most: int) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    return sizes.orderBy(F.desc("rows"), key).limit(most)


def newest_first(df: DataFrame, at: str, ident: str) -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(ident))


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def upsert(base: DataFrame, updates: DataFrame, ident: str, at: str) -> DataFrame:
    """Row per id with the newest time; of equal times the update. One aggregate, so a much-updated id stays cheap."""
    both = base.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rest = [c for c in base.columns if c != ident]
    picked = both.groupBy(ident).agg(F.max_by(F.struct(*rest), F.struct(at, "_new")).alias("_r"))
    return picked.select(ident, "_r.*").select(*base.columns)


def remove(df: DataFrame, gone: DataFrame, ident: str) -> DataFrame:
    return df.join(gone.select(ident).distinct(), ident, "left_anti")


def cascade_delete(results: DataFrame, inputs: DataFrame, gone: DataFrame, result_id: str, link: str, input_id: str):
    """Results without the given ones, and inputs without those the removed results point to."""
    removed = results.join(gone.select(result_id).distinct(), result_id, "left_semi")
    linked = removed.select(F.col(link).alias(input_id)).distinct()
    return remove(results, gone, result_id), inputs.join(linked, input_id, "left_anti")


def route(requests: DataFrame, providers: DataFrame, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Answers from the provider each request names (blanks and case aside), and the requests no provider can answer."""
    named = requests.withColumn("provider", F.lower(F.trim(source)))
    known = providers.select("provider").distinct()
    reason = F.concat(F.lit("unsupported source: "), F.coalesce("provider", F.lit("none")))
    rejects = named.join(known, "provider", "left_anti").withColumn("reason", reason)
    held = providers.select("provider", key).distinct()
    absent = named.join(known, "provider", "left_semi").join(held, ["provider", key], "left_anti")
    rejects = rejects.unionByName(absent.withColumn("reason", F.concat(F.lit("no data from source: "), "provider")))
    return named.join(providers, ["provider", key]), rejects


def key_check(asked: DataFrame, stored: DataFrame, ident: str, key: str, digest: str) -> DataFrame:
    """Status per request: 401 without a key, 404 without a row, 403 for the wrong key, 200 else."""
    own = stored.select(ident, F.col(digest).alias("_stored"), F.lit(True).alias("_there"))
    joined = asked.join(own, ident, "left")
    blank = F.coalesce(F.trim(key), F.lit("")) == ""
    status = (
        F.when(blank, 401).when(F.col("_there").isNull(), 404).when(F.coalesce(key_digest(key) == F.col("_stored"), F.lit(False)), 200).otherwise(403)
    )
    return joined.withColumn("status", status).drop("_stored", "_there")

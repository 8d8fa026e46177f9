"""Filter interaction audit: what each filter removes in every order in which the filters can be applied.

Every document gets a mask with a bit per filter that it fails. Masks are counted into cells per part of the corpus; whatever the
order of filters, its counts are sums over these few cells. A recursive CTE then extends prefixes of filters by each letter not
used yet, carries the bits applied so far, joins the cells of the part, and each level of the recursion emits the metrics of that
step. All orders that begin alike share the row of their prefix.

Null text is empty, and empty and null texts are equal texts. Part of a null value is the empty string. A text is a copy if a
smaller id has the same one anywhere in the table; rows without an id are neither copies nor have any. Repeated rows each count.
Several labels of one document are one, with each mark that any of them has; rows without an id have none. No documents give no
rows. Other columns are never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import written

# The filters' letters in order, and the characters that D looks for.
LETTERS = "ABCDE"
SYMBOLS = "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << LETTERS.index("E")


@dataclass(frozen=True)
class Limits:
    words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 3


def _mask(text: str, limits: Limits) -> int:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII blanks
    n = len(words)
    fails = (
        n < limits.words,
        100 * len(set(words)) < limits.distinct_percent * n,
        100 * sum(map(text.count, UPPER)) > limits.upper_percent * len(text),
        any(map(text.__contains__, SYMBOLS)),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def own_mask(text: Column, limits: Limits = Limits()) -> Column:
    """Bits of the filters that look at one text alone: A, B, C and D."""

    @F.arrow_udf("int")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array((_mask(t.as_py() or "", limits) for t in texts), pa.int32(), size=len(texts))

    return of(text)


def masked(docs: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """doc_id, part, mask and n: equal rows as one, with how many they are.

    The copies of a text meet only as partial minima of ids per digest. Who has the least id is found by joining digest and id
    together, so that a text with millions of copies is not one key of that join.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"),
        own_mask(text, limits).alias("own"), F.sha2(text, 256).alias("digest"),
    )
    rows = written(docs.sparkSession, rows, "audit-masks")
    rows = rows.groupBy("doc_id", "digest", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    met = rows.join(first, ["digest", "doc_id"], "left")
    return met.select("doc_id", "part", F.col("own").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"), "n")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """One row per part with its cells: mask, documents, good ones and toxic ones; at most 32 cells, as there are masks."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = masked(docs, part, limits).join(marks, "doc_id", "left")
    marked = lambda mark: F.sum(F.when(F.col(mark), F.col("n")).otherwise(0)).alias(mark)
    counted = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def _sum(field: str, when: str) -> str:
    return f"aggregate(filter(c.cells, x -> {when}), 0L, (s, x) -> s + x.{field})"


_HAS, _UNTOUCHED = "(x.mask & l.bit) <> 0", "(x.mask & w.applied) = 0"
WALK = f"""
with recursive walk(part, prefix, applied, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) as (
  select part, cast('' as string), 0, 0, cast('' as string), 0L, 0L, 0L, 0L, 0L, 0L from {{cells}}
  union all
  select w.part, concat(w.prefix, l.letter), w.applied | l.bit, w.step + 1, l.letter,
    {_sum("n", "(x.mask & (w.applied | l.bit)) = 0")},
    {_sum("n", f"{_HAS} and {_UNTOUCHED}")},
    {_sum("n", f"{_HAS} and not {_UNTOUCHED}")},
    {_sum("n", "x.mask = l.bit")},
    {_sum("good", f"{_HAS} and {_UNTOUCHED}")},
    {_sum("toxic", f"{_HAS} and {_UNTOUCHED}")}
  from walk w join {{cells}} c on w.part = c.part
  lateral view inline({{letters}}) l as letter, bit
  where instr(w.prefix, l.letter) = 0)
select * from walk where step > 0"""
METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def prefixes(packed: DataFrame) -> DataFrame:
    """part, prefix, applied, step, filter and the metrics of that step, for every prefix of every order of the filters."""
    spark = packed.sparkSession
    # The recursion makes 325 rows a part; its row limit guards against endless ones, which unused letters rule out.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    listed = "array(" + ", ".join(f"named_struct('letter', '{a}', 'bit', {1 << i})" for i, a in enumerate(LETTERS)) + ")"
    return spark.sql(WALK.format(cells="{cells}", letters=listed), cells=packed)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """part, filter_order, step, filter, the metrics of the step, and ``shapley``: what its filter removes, summed over all orders."""
    packed = written(docs.sparkSession, cells(docs, labels, part, limits), "audit-cells")
    steps = written(docs.sparkSession, prefixes(packed), "audit-prefixes")
    last = len(LETTERS)
    orders = steps.where(F.col("step") == last).select("part", F.col("prefix").alias("filter_order"))
    steps = steps.withColumnRenamed("filter", "letter")
    begun = orders.select("part", "filter_order", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(last)), lambda k: F.substring("filter_order", F.lit(1), k))).alias("_i", "prefix"))
    rows = begun.join(steps, ["part", "prefix"])
    # Of a filter, each prefix that ends with it stands for all orders that begin so.
    share = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(share, ["part", "letter"]).select("part", "filter_order", "step", "letter", *METRICS, "shapley")


def sql() -> str:
    """DuckDB twin over ``documents`` and ``labels``: each order and step by itself, from the documents."""
    return rf"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
m as (
  select d.doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[{SYMBOLS}]') as d,
    coalesce(doc_id > min(doc_id) over (partition by text), false) as e from d),
g as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
f as (
  select part, case when a then 1 else 0 end + case when b then 2 else 0 end + case when c then 4 else 0 end + case when d then 8 else 0 end + case when e then 16 else 0 end as mask,
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, count(*) as n
  from m left join g using (doc_id) group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as bit),
o as (select '' as word union all select word || letter from o, l where position(letter in word) = 0),
s as (
  select word as filter_order, step, substr(word, step, 1) as letter,
    list_sum(list_transform(string_split(substr(word, 1, step - 1), ''), lambda x: case x when 'A' then 1 when 'B' then 2 when 'C' then 4 when 'D' then 8 when 'E' then 16 else 0 end)) as before
  from o, (select unnest([1, 2, 3, 4, 5]) as step) where length(word) = 5),
t as (
  select p.part, s.filter_order, s.step, s.letter, l.bit, cast(coalesce(s.before, 0) as bigint) as before
  from (select distinct part from f) p, s join l using (letter)),
r as (
  select t.part, filter_order, step, letter,
    sum(case when mask & (before | bit) = 0 then n else 0 end) as kept,
    sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end) as removed,
    sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end) as redundant,
    sum(case when mask = bit then n else 0 end) as unique_fails,
    sum(case when mask & bit <> 0 and mask & before = 0 then n * good else 0 end) as good_lost,
    sum(case when mask & bit <> 0 and mask & before = 0 then n * toxic else 0 end) as toxic_lost
  from t join f on t.part = f.part group by t.part, filter_order, step, letter)
select part, filter_order, cast(step as integer) as step, letter, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, letter) as bigint) as shapley
from r"""

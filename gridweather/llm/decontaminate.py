"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question re-asked with other values keeps its template. Template
windows of documents and benchmark items are joined by hash; what the placeholders stood for is then compared along each
alignment: one value of the item must always stand for the same value in the document. Names are capitalised words within a
sentence; units are known only right after a number.

A template of few literal words fits too much: such windows, and items shorter than a window, are joined by the hash of their very
words, values included. Null and empty texts have no windows. Repeated rows of one document count as one; a passage that a
document repeats counts once. Equal benchmark items are all reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import doc_rows, once, written

NAME, NUMBER, UNIT = "\x02", "\x03", "\x04"
# Units known after a number.
UNITS = (
    "km|kilometers|kilometres|m|meters|metres|cm|centimeters|mm|mi|miles|ft|feet|foot|in|inches|yd|yards|kg|kilograms|g|grams|mg|lb|lbs|pounds|oz|ounces|"
    "l|liters|litres|ml|gallons|cups|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|usd|eur|dollars|euros|cents|percent|degrees|mph|kmh|kb|mb|gb"
)
# Patterns mean the same in Java and in RE2. A name follows another word of its sentence; two passes find neighbouring names,
# since a match takes the last character before it.
NAMES = (rf"([^.!?:\n\"')\]\s][ \t]+)(\p{{Lu}}\p{{Ll}}+)", rf"$1{NAME}$2")
JOINED = (r"([0-9])[.,:/]([0-9])", r"$1_$2")
GLUED = (r"([0-9])(\p{L})", r"$1 $2"), (r"(\p{L})([0-9])", r"$1 $2")
NUMBERS = (r"([0-9][0-9_]*)", rf"{NUMBER}$1")
MEASURES = (rf"({NUMBER}[0-9_]+[ \n]+)({UNITS})([^\p{{L}}]|$)", rf"$1{UNIT}$2$3")
PUNCTUATION = (rf"[^\p{{L}}\p{{N}}\s_{NAME}{NUMBER}{UNIT}]+", "")
WITH_DIGITS = (JOINED, JOINED, *GLUED, NUMBERS)
#: Benchmark windows up to this many are sent to every task; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 500_000
#: Slots of the table that says whether any benchmark window has a hash; at least ``SPARSE`` slots a window up to the bound.
SPARSE, MOST_SLOTS = 16, 1 << 18


def marked(text: Column) -> Column:
    """Text in lower case without punctuation; placeholders are marked in front of what they stand for."""
    out = F.coalesce(text, F.lit(""))
    for pattern, by in (NAMES, NAMES):
        out = F.regexp_replace(out, pattern, by)
    digits = out
    for pattern, by in WITH_DIGITS:
        digits = F.regexp_replace(digits, pattern, by)
    digits = F.regexp_replace(F.lower(digits), *MEASURES)
    return F.regexp_replace(F.when(text.rlike("[0-9]"), digits).otherwise(F.lower(out)), *PUNCTUATION)


def templates(rows: DataFrame, key: str) -> DataFrame:
    """key, words (marked) and template (a placeholder is its mark alone)."""
    base = once(rows, key, m=marked(F.col("text")))
    blank = F.col("m")
    for white in "\n\r\t\x0b\x0c":
        blank = F.replace(blank, F.lit(white), F.lit(" "))
    base = once(base, key, words=F.array_remove(F.split(blank, " "), ""))
    template = F.transform("words", lambda w: F.when(w < "\x05", F.substring(w, 1, 1)).otherwise(w))
    return once(base, key, words=F.col("words"), template=template)


def places(size: int) -> Column:
    """Where windows of ``size`` words begin, from 0; none in shorter texts."""
    return F.when(F.size("template") >= size, F.sequence(F.lit(0), F.size("template") - size))


def placeholder(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def maybe_known(h: Column, hashes: list[int]) -> Column:
    """False only where no benchmark window has the hash: a byte for each value of its low bits, as one constant."""
    slots = 1 << 10
    while slots < min(MOST_SLOTS, SPARSE * len(hashes)):
        slots *= 2
    present = bytearray(slots)
    for known in hashes:
        present[known & (slots - 1)] = 1
    return F.substring(F.lit(bytes(present)), (h.bitwiseAND(slots - 1) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")


def benchmark_windows(benchmark: DataFrame, window: int, literals: int) -> DataFrame:
    """item_id, ipos, exact, h, n (words), iwords, itemplate: a row per window; an item shorter than a window is one itself.

    ``exact`` windows have fewer than ``literals`` words besides placeholders, or are such an item; ``h`` is over their words, that
    of others over the template.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    starts = F.coalesce(places(window), F.when(F.size("template") > 0, F.array(F.lit(0))))
    cut = templates(items, "item_id").select("item_id", (F.size("words") < window).alias("short"), "words", "template", F.explode(starts).alias("ipos"))
    cut = cut.select("item_id", "ipos", "short", F.slice("words", F.col("ipos") + 1, window).alias("iwords"), F.slice("template", F.col("ipos") + 1, window).alias("itemplate"))
    exact = F.col("short") | (F.size(F.filter("itemplate", lambda w: ~placeholder(w))) < literals)
    cut = cut.select("item_id", "ipos", exact.alias("exact"), F.size("iwords").alias("n"), "iwords", "itemplate")
    h = F.when(F.col("exact"), F.xxhash64("iwords")).otherwise(F.xxhash64("itemplate"))
    return cut.withColumn("h", h).dropDuplicates(["item_id", "ipos"])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 5, share: float = 0.5, run: int = 24, short: int = 5) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, longest_run, changed.

    A pair is reported when consistent alignments cover at least ``share`` of the item's windows, or of those with ``literals``
    or more words besides placeholders, or ``run`` consecutive windows of an item of any length. Items shorter than a window are
    found word for word anywhere in a text; those of fewer than ``short`` words only where they are the whole text. ``changed``:
    some number, name or unit differs from the item's.
    """
    cut = written(docs.sparkSession, benchmark_windows(benchmark, window, literals), "benchmark-windows")
    totals = cut.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"), F.count_if(~F.col("exact")).alias("item_literal"))
    # One row per length of window that is looked for word for word: at most ``window`` of them.
    sizes = sorted(r["n"] for r in cut.where("exact").select("n").distinct().collect())
    known = None
    if cut.count() <= BROADCAST_WINDOWS:
        # The benchmark's hashes, bounded as checked, mark the few places of a document worth a row of their own.
        known = [(r["exact"], r["h"]) for r in cut.select("exact", "h").distinct().collect()]
        cut, totals = F.broadcast(cut), F.broadcast(totals)

    def worth(size: int, exact: bool) -> Column:
        """Places of a text that may hold a window of the benchmark."""
        at, source = places(size), "words" if exact else "template"
        if known is not None:
            hashes = [h for e, h in known if e == exact]
            at = F.filter(at, lambda i: maybe_known(F.xxhash64(F.slice(source, i + 1, size)), hashes))
        if exact and size < short:
            at = F.when(F.size("words") == size, at)
        if exact and size == window:
            at = F.when(F.exists("words", placeholder), at)
        return F.coalesce(F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("n"), F.lit(exact).alias("exact"))), F.array().cast("array<struct<pos:int,n:int,exact:boolean>>"))

    every = [worth(window, False), *[worth(size, True) for size in sizes]]
    at = F.concat(*every) if len(every) > 1 else every[0]
    rows = once(templates(doc_rows(docs), "doc_id"), "doc_id", words=F.col("words"), template=F.col("template"), at=at)

    def of_place(x: Column) -> Column:
        words, template = F.slice("words", x["pos"] + 1, x["n"]), F.slice("template", x["pos"] + 1, x["n"])
        return F.struct(x["pos"].alias("pos"), x["exact"].alias("exact"), F.when(x["exact"], F.xxhash64(words)).otherwise(F.xxhash64(template)).alias("h"), words.alias("words"), template.alias("template"))

    # A window goes on with its own words alone: a shuffle must not carry the whole text once per place.
    rows = rows.select("doc_id", F.explode(F.transform("at", of_place)).alias("w")).select("doc_id", "w.*")
    met = rows.join(cut, ["h", "exact"]).where(F.when(F.col("exact"), F.col("words") == F.col("iwords")).otherwise(F.col("template") == F.col("itemplate")))
    slots = F.filter(F.arrays_zip(F.col("iwords").alias("a"), F.col("words").alias("b")), lambda x: placeholder(x["a"]))
    met = met.select("doc_id", "item_id", "ipos", "exact", (F.col("pos") - F.col("ipos")).alias("shift"), slots.alias("slots"))
    # An alignment has at most as many windows as its item, so its sets are bounded by the item's length.
    along = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_set(F.struct("ipos", "exact")).alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs"))
    along = along.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))))
    along = along.withColumns({"changed": F.exists("pairs", lambda x: x["a"] != x["b"]), "longest": longest_run(F.sort_array(F.col("at.ipos")))})
    # Alignments of one document and item are brought down to bits of the item's length before they meet.
    covered = along.select("doc_id", "item_id", "changed", "longest", F.explode("at").alias("place"))
    found = covered.groupBy("doc_id", "item_id", "place").agg(F.min("changed").alias("changed"), F.max("longest").alias("longest"))
    found = found.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(~F.col("place.exact")).alias("n_literal"), F.max("longest").cast("bigint").alias("longest_run"), F.max("changed").alias("changed")
    )
    enough = (F.col("n_windows") >= share * F.col("item_windows")) | (F.col("n_literal") >= share * F.greatest("item_literal", F.lit(1))) | (F.col("longest_run") >= run)
    return found.join(totals, "item_id").where(enough).select("doc_id", "item_id", "n_windows", "item_windows", "longest_run", "changed")


def longest_run(places: Column) -> Column:
    """Length of the longest run of consecutive numbers in an ascending array."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when(x == acc["last"] + 1, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(acc["best"], n).alias("best"))

    return F.aggregate(places, start, step, lambda acc: acc["best"])


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of documents that hold no benchmark item, with all their columns; rows without an id stay."""
    ids = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_contaminated")).where("_contaminated is not null").distinct()
    return docs.join(ids, docs["doc_id"] == ids["_contaminated"], "left_anti")


def sql(window: int = 8, literals: int = 5, share: float = 0.5, run: int = 24, short: int = 5) -> str:
    """DuckDB twin over ``documents`` and ``benchmark``."""

    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def replaced(x: str, steps) -> str:
        for pattern, by in steps:
            for i in (1, 2, 3):
                by = by.replace(f"${i}", f"\\{i}")
            x = f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"
        return x

    names = replaced("coalesce(text, '')", (NAMES, NAMES))
    digits = replaced("lower(" + replaced(names, WITH_DIGITS) + ")", [MEASURES])
    m = replaced(f"case when regexp_matches(text, '[0-9]') then {digits} else lower({names}) end", [PUNCTUATION])
    words = f"list_filter(string_split_regex({m}, '[ \\n\\r\\t\\x0b\\x0c]'), lambda w: w <> '')"
    kinds = ", ".join(q(k) for k in (NAME, NUMBER, UNIT))

    def marked_words(table: str, key: str) -> str:
        return f"""
  select {key}, words, list_transform(words, lambda w: case when substring(w, 1, 1) in ({kinds}) then substring(w, 1, 1) else w end) as template
  from (select {key}, {words} as words from {table})"""

    literal = f"len(list_filter(template, lambda w: w not in ({kinds})))"
    return f"""
with item_words as ({marked_words("benchmark", "item_id")}), doc_words as ({marked_words("documents", "doc_id")}),
items as (
  select distinct item_id, pos, words, template, short or {literal} < {literals} as exact, len(words) as n
  from (select item_id, i as pos, len(words) < {window} as short, list_slice(words, i + 1, i + {window}) as words, list_slice(template, i + 1, i + {window}) as template
        from (select *, unnest(range(0, case when len(words) between 1 and {window - 1} then 1 else len(words) - {window - 1} end)) as i from item_words where item_id is not null))),
totals as (select item_id, count(*) as item_windows, count(*) filter (where not exact) as item_literal from items group by item_id),
sizes as (select distinct n from items where exact),
by_template as (
  select doc_id, i as pos, list_slice(words, i + 1, i + {window}) as words, list_slice(template, i + 1, i + {window}) as template
  from (select *, unnest(range(0, len(words) - {window - 1})) as i from doc_words)),
by_words as (
  select doc_id, i as pos, list_slice(words, i + 1, i + n) as words
  from (select *, unnest(range(0, len(words) - n + 1)) as i from doc_words join sizes on len(words) >= n and (n >= {short} or len(words) = n))),
met as (
  select d.doc_id, b.item_id, b.exact, b.pos as ipos, d.pos - b.pos as shift, b.words as iwords, d.words
  from by_template d join items b on d.template = b.template where not b.exact
  union all
  select d.doc_id, b.item_id, b.exact, b.pos, d.pos - b.pos, b.words, d.words from by_words d join items b on d.words = b.words where b.exact),
slots as (
  select distinct doc_id, item_id, shift, unnest(list_filter(list_zip(iwords, words), lambda x: substring(x[1], 1, 1) in ({kinds}))) as s from met),
bad as (select distinct doc_id, item_id, shift from slots group by doc_id, item_id, shift, s[1] having count(*) > 1),
differs as (select doc_id, item_id, shift, bool_or(s[1] <> s[2]) as changed from slots group by doc_id, item_id, shift),
aligned as (
  select m.*, coalesce(changed, false) as changed, ipos - row_number() over (partition by doc_id, item_id, shift order by ipos) as stretch
  from (select distinct doc_id, item_id, shift, ipos, exact from met) m
  anti join bad using (doc_id, item_id, shift) left join differs using (doc_id, item_id, shift)),
runs as (select doc_id, item_id, max(n) as longest_run from (select doc_id, item_id, count(*) as n from aligned group by doc_id, item_id, shift, stretch) group by doc_id, item_id),
places as (select doc_id, item_id, ipos, exact, min(changed) as changed from aligned group by doc_id, item_id, ipos, exact),
pairs as (select doc_id, item_id, count(*) as n_windows, count(*) filter (where not exact) as n_literal, bool_or(changed) as changed from places group by doc_id, item_id)
select doc_id, item_id, n_windows, item_windows, longest_run, changed from pairs join totals using (item_id) join runs using (doc_id, item_id)
where n_windows >= {share} * item_windows or n_literal >= {share} * greatest(item_literal, 1) or longest_run >= {run}"""

"""Secret scan: fixed patterns, and a battery of randomness tests on everything that looks encoded.

Stretches of encoding characters, cut at '=' into names and values, and the parts of each between '/', '-' and '_' beside the
whole, are given an encoding by their characters (hex, base32, base64), and their symbols are tested
for being drawn evenly and independently: chi-squared uniformity over the alphabet, the number of runs above and below the
middle, and the correlation of neighbours. The three are combined into one p-value of randomness. Over all candidates of the
corpus a step-up rule that controls false discoveries decides, for each encoding and length band by itself, which stretches are
not random; the others are secrets. Bands too short to tell random from written text are never taken.

Null and empty texts hold nothing. Repeated rows are judged alike. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridweather.llm.common import doc_rows, once, written

# The base patterns.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
RANDOM = "random"
# Alphabets in the order of their codes.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@dataclass(frozen=True)
class Battery:
    """``shortest``: characters from which an encoding's tests have the power to tell text apart. ``bands``: lower edges of the
    length bands. ``discoveries``: share of false ones allowed among stretches called not random. ``grid``: steps of -log10 p."""

    shortest: tuple[tuple[str, int], ...] = (("hex", 24), ("base32", 24), ("base64", 24))
    bands: tuple[int, ...] = (24, 32, 48, 64, 128, 256)
    discoveries: float = 0.05
    grid: float = 0.05


# Whole stretches with a digit. Looking ahead only from a stretch's first character keeps long stretches without one linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}"
# Whole stretches without a digit, of small and capital letters.
LETTERS = r"(?<![A-Za-z0-9+/_=-])(?=[A-Z+/_=-]*[a-z])(?=[a-z+/_=-]*[A-Z])[A-Za-z+/_=-]{24,}+(?![0-9])"
# What stands between the '=' of a stretch, with padding at its end; and what stands between the other marks that join words.
SEGMENT = r"[^=]+(?:=+$)?"
PART = r"[A-Za-z0-9+]+=*"


#: Matches that are walked together.
PORTION = 512


def spans(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as (start, end, match) in code points.

    Matches and the gaps between them are read by the same pattern; the sum of what lies before is a match's start.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), F.length)
    pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["match"])
        here = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"))
        ok = x["match"].isNotNull() if keep is None else x["match"].isNotNull() & keep(x["match"])
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(ok, F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    # An array that grows is copied at each match: so short portions are walked, and moved by the lengths of those before.
    portions = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / PORTION).cast("int")), lambda k: F.aggregate(F.slice(p, k * PORTION + 1, PORTION), start, step))

    def moved(walked: Column) -> Column:
        offsets = F.transform(walked, lambda x, i: F.aggregate(F.slice(walked, F.lit(1), i), F.lit(0), lambda a, y: a + y["at"]))
        shift = lambda s, by: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["match"].alias("match"))
        each = lambda zipped: F.transform(zipped["w"]["out"], lambda s: shift(s, zipped["o"]))
        return F.flatten(F.transform(F.arrays_zip(walked.alias("w"), offsets.alias("o")), each))

    return F.when(text.rlike(pattern), bound(bound(pairs, portions), moved)).otherwise(none)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base(text: Column) -> dict[str, Column]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    return {"assign": spans(text, ASSIGN, value), "access": spans(text, ACCESS, lambda m: F.length(m) >= 20), "hex": spans(text, HEX)}


def encoding(token: Column) -> Column:
    """Encoding whose characters the whole stretch has, with the mixture an encoded value shows; null for none."""
    digits = token.rlike("[0-9]")
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$") & digits & token.rlike("[a-fA-F]"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$") & token.rlike("[2-7]") & token.rlike("[A-Z]"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/_-]+=*$") & token.rlike("[a-z]") & token.rlike("[A-Z]"), "base64")
    )


def codes(token: Column, kind: str) -> Column:
    """Codes of the symbols, padding left out and the URL form of base64 read as the other."""
    plain = F.translate(F.lower(token) if kind == "hex" else F.translate(token, "-_", "+/"), "=", "")
    return F.transform(F.split(plain, "(?!$)(?<=.)"), lambda c: F.instr(F.lit(ALPHABETS[kind]), c) - 1)


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution by a rational fit, good to seven digits."""

    def tail(x):
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        upper = F.exp(-x * x / 2) * 0.3989422804014327 * bound(1 / (1 + 0.2316419 * F.abs(x)), poly)
        return bound(upper, lambda u: F.when(x >= 0, u).otherwise(1 - u))

    return bound(z, tail)


def p_random(symbols: Column, size: int) -> Column:
    """p-value of randomness: three times the smallest of the three tests' p-values.

    What a test measures is bound to a name before it is used: an expression written out at each use would grow beyond what can
    be compiled.
    """

    def neighbours(values):
        part = lambda at: F.slice(values, F.lit(at), F.size(values) - 1)
        return F.arrays_zip(part(1).alias("a"), part(2).alias("b"))

    def measured(s):
        n = F.size(s).cast("double")
        counts = F.transform(F.array_distinct(s), lambda x: F.size(F.filter(s, lambda y: y == x)).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        # Above and below the middle of the alphabet.
        ups = F.size(F.filter(s, lambda x: x >= size // 2)).cast("double")
        turns = F.size(F.filter(neighbours(s), lambda x: (x["a"] >= size // 2) != (x["b"] >= size // 2)))
        mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
        return F.struct(s.alias("s"), n.alias("n"), squares.alias("squares"), ups.alias("ups"), (n - ups).alias("downs"), turns.alias("turns"), mean.alias("mean"))

    def tested(m):
        n, mean, df = m["n"], m["mean"], float(size - 1)
        # chi-squared by the cube-root normal approximation
        chi = m["squares"] * size / n - n
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5
        # runs above and below
        expected = 2 * m["ups"] * m["downs"] / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = bound(F.struct(expected.alias("e"), spread.alias("v")), lambda x: F.when(x["v"] > 0, F.abs(m["turns"] + 1 - x["e"]) / F.sqrt(x["v"])).otherwise(F.lit(40.0)))
        # correlation of neighbours
        cross = F.aggregate(neighbours(m["s"]), F.lit(0.0), lambda acc, x: acc + (x["a"] - mean) * (x["b"] - mean))
        around = F.aggregate(m["s"], F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        z_serial = bound(around, lambda v: F.when(v > 0, F.abs(cross / v) * F.sqrt(n)).otherwise(F.lit(40.0)))
        return F.least(F.lit(1.0), 3 * F.least(normal_tail(z_chi), 2 * normal_tail(z_runs), 2 * normal_tail(z_serial)))

    return F.when(symbols.isNotNull(), bound(bound(symbols, measured), tested))


def candidates(rows: DataFrame, how: Battery) -> DataFrame:
    """doc_id, start, end, encoding, band and -log10 p of everything that may be encoded, with ``segment``, the place where its
    segment begins, and whether it is the ``whole`` of it.

    A stretch is cut at every '=' that is not padding. Each segment is a candidate, and so are its parts between '/', '-' and '_'.
    """
    least = min(size for _, size in how.shortest)
    long = lambda m: F.length(m) >= least
    stretches = F.concat(spans(F.col("text"), CANDIDATE), spans(F.col("text"), LETTERS))
    found = rows.select("doc_id", F.explode(stretches).alias("s")).select("doc_id", "s.*")
    found = found.select("doc_id", "start", F.explode(spans(F.col("match"), SEGMENT, long)).alias("s"))
    found = once(found, "doc_id", segment=F.col("start") + F.col("s.start"), token=F.col("s.match"))
    parts = F.filter(spans(F.col("token"), PART, long), lambda x: x["match"] != F.col("token"))
    both = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.length("token").alias("end"), F.col("token").alias("match"))), parts)
    found = found.select("doc_id", "segment", F.col("token").alias("of"), F.explode(both).alias("s"))
    keys = "doc_id", "segment", "whole", "start", "end"
    found = found.select("doc_id", "segment", (F.col("s.match") == F.col("of")).alias("whole"), (F.col("segment") + F.col("s.start")).alias("start"), (F.col("segment") + F.col("s.end")).alias("end"), F.col("s.match").alias("match"))
    found = once(found, *keys, token=F.col("match"), encoding=encoding(F.col("match"))).where("encoding is not null")
    made = F.lit(None).cast("array<int>")
    for kind in ALPHABETS:
        made = F.when(F.col("encoding") == kind, codes(F.col("token"), kind)).otherwise(made)
    found = once(found, *keys, "encoding", symbols=made)
    p = F.lit(None).cast("double")
    for kind, alphabet in ALPHABETS.items():
        p = F.when(F.col("encoding") == kind, p_random(F.col("symbols"), len(alphabet))).otherwise(p)
    band, enough = F.lit(0), F.lit(False)
    for edge in how.bands:
        band = F.when(F.size("symbols") >= edge, F.lit(edge)).otherwise(band)
    for kind, least in how.shortest:
        enough = enough | ((F.col("encoding") == kind) & (F.size("symbols") >= least))
    found = found.where(enough).select(*keys, "encoding", band.alias("band"), F.least(F.lit(40.0), -F.log10(F.greatest(p, F.lit(1e-40)))).alias("strength"))
    return found.withColumn("step", F.floor(F.col("strength") / how.grid))


def secrets_by_battery(found: DataFrame, how: Battery) -> DataFrame:
    """Stretches that the step-up rule does not call non-random.

    p-values are rounded up to the grid, so that counts per step, a bounded table, take the place of a sort of all of them.
    """
    steps = found.groupBy("encoding", "band", "step").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("encoding", "band").orderBy(F.desc("step"))
    whole = Window.partitionBy("encoding", "band")
    ranked = steps.select("encoding", "band", "step", F.sum("n").over(along).alias("rank"), F.sum("n").over(whole).alias("m"))
    passing = F.pow(F.lit(10.0), -F.col("step") * how.grid) <= how.discoveries * F.col("rank") / F.col("m")
    cut = ranked.where(passing).groupBy("encoding", "band").agg(F.min("step").alias("cut"))
    # At most three encodings by as many bands.
    return found.join(F.broadcast(cut), ["encoding", "band"], "left").where("cut is null or step < cut").drop("cut")


def covered(span: Column) -> Column:
    """Whether a span lies in one of the base kinds."""
    out = F.lit(False)
    for kind in KINDS:
        out = out | _within(span, F.col(kind))
    return out


def _within(span: Column, spans: Column) -> Column:
    """Spans in order and apart: only the last that begins at or before another can hold it, which is found by halving."""

    def half(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] <= span["start"]
        more = acc["high"] - acc["low"] > 1
        return F.struct(F.when(more & before, middle).otherwise(acc["low"]).alias("low"), F.when(more & ~before, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int") + 1)
    last = F.aggregate(steps, F.struct(F.lit(-1).alias("low"), F.size(spans).alias("high")), half, lambda acc: acc["low"])
    return F.coalesce(F.get(spans, last)["end"] >= span["end"], F.lit(False))


def scan(docs: DataFrame, how: Battery = Battery()) -> DataFrame:
    """doc_id, one array of (start, end, match) per base kind, and ``random``: (start, end) of the battery's secrets."""
    rows = doc_rows(docs)
    text = once(rows, "doc_id", text=F.coalesce("text", F.lit("")))
    table = text.select("doc_id", *[column.alias(kind) for kind, column in base(F.col("text")).items()])
    found = written(docs.sparkSession, candidates(text, how), "secret-candidates")
    # A part goes without saying where its whole segment is a secret.
    extra = secrets_by_battery(found, how).groupBy("doc_id", "segment").agg(F.max("whole").alias("all"), F.collect_set(F.struct("start", "end", "whole")).alias("s"))
    extra = extra.select("doc_id", F.explode(F.filter("s", lambda x: x["whole"] == F.col("all"))).alias("s")).select("doc_id", "s.start", "s.end")
    extra = extra.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("random"))
    out = table.join(extra, "doc_id", "left")
    fresh = F.filter(F.coalesce("random", F.array().cast("array<struct<start:int,end:int>>")), lambda s: ~covered(s))
    return out.select("doc_id", "assign", "access", "hex", fresh.alias("random"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind as given, comma-joined."""

    def tagged(order: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    ordered = F.array_sort(F.concat(*[tagged(i, kind) for i, kind in enumerate(kinds)]))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

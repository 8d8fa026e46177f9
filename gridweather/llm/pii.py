"""Personal data: plain patterns, and words that give the protected values away.

The patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. The values found are protected entities.
Removing them is not enough where a word stands almost only beside one of them, so the corpus is asked how strongly words reveal
entities: the share of a word's documents that hold the entity, anywhere, an estimate of P(entity | word), and the gain in
bits over P(entity). Words over the thresholds are generalised to a placeholder, or removed where they all but name the entity,
wherever they stand in the corpus. Copies of one passage are one piece of evidence: a pair needs several different surroundings.

Null and empty texts hold nothing. Repeated rows of one document count once in the estimates, and each row gets its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import doc_rows, free_name, handed_back, nothing_held, once, written

# Kinds and character sets of the base rules, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")
TERM = "term"
SPAN = "array<struct<kind:string,start:int,end:int>>"
NEAR = "array<struct<entity:string,around:bigint,term:string>>"
CODED = "array<struct<name:string,around:bigint>>"
SPOTS = "array<struct<start:int,end:int,remove:boolean>>"
#: Words up to this many are sent to every task that counts or marks them; beyond, they are joined.
BROADCAST_TERMS = 50_000
#: Entities of one document that meet its words in one block.
BLOCK = 256


@dataclass(frozen=True)
class Disclosure:
    """``near``: characters on each side of a place that make its surroundings. A word is generalised from ``share``
    and ``bits`` on, given ``surroundings`` different ones, and removed from ``remove`` on."""

    near: int = 60
    share: float = 0.5
    remove: float = 0.9
    bits: float = 3.0
    surroundings: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each '@' with what stands before it, back to the address before, and a domain behind.

    A pattern that begins with the local part would try every place of a long run; this looks at each character a few times.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        name = text[last:at]
        start = last + len(name.rstrip(LOCAL))
        # The next search never reaches back over this sign, which no local part holds.
        last = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", last)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Runs of four numbers joined by dots: in a longer chain one after the other, as a search from the left takes them."""
    out = []
    for m in CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            # A part's value is tested on its digits: leading zeros are allowed, very long parts fail.
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in addresses(text)]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def around(text: str, start: int, end: int, near: int) -> int:
    """Code of what stands on both sides of a place."""
    sides = text[max(0, start - near) : start] + "\0" + text[end : end + near]
    return int.from_bytes(blake2b(sides.lower().encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def merged_spans(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends with overlapping spans made one, so that a word is looked up by bisection."""
    firsts, lasts = [], []
    for a, b in sorted(spans):
        if lasts and a <= lasts[-1]:
            lasts[-1] = max(lasts[-1], b)
        else:
            firsts.append(a)
            lasts.append(b)
    return firsts, lasts


def words_outside(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """(word, start, end) of all words that touch none of the spans."""
    firsts, lasts = merged_spans(spans)
    out = []
    for m in WORD.finditer(text):
        before = bisect_right(firsts, m.end() - 1) - 1
        if before < 0 or lasts[before] <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def surroundings(text: str, spans: list[tuple[str, int, int]], near: int) -> list[tuple[str, int, str, int, int]]:
    """(entity, code of its surroundings, word, start, end) for whole words near each entity and outside all of them."""
    out = []
    firsts, lasts = merged_spans([(a, b) for _, a, b in spans])
    for _, start, end in spans:
        low, high = max(0, start - near), min(len(text), end + near)
        code = around(text, start, end, near)
        entity = text[start:end].lower()
        for m in WORD.finditer(text, low, high):
            cut = m.start() == low > 0 and text[low - 1].isalnum() or m.end() == high < len(text) and text[high].isalnum()
            before = bisect_right(firsts, m.end() - 1) - 1
            if not cut and (before < 0 or lasts[before] <= m.start()):
                out.append((entity, code, m[0].lower(), m.start(), m.end()))
    return out


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _structs(rows: list[list[tuple]], kinds: list[tuple[str, pa.DataType]]) -> pa.Array:
    flat = [x for row in rows for x in row]
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    parts = [pa.array([x[i] for x in flat], kind) for i, (_, kind) in enumerate(kinds)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, [n for n, _ in kinds]))


SPAN_KINDS = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
NEAR_KINDS = [("entity", pa.string()), ("around", pa.int64()), ("term", pa.string())]
CODED_KINDS = [("name", pa.string()), ("around", pa.int64())]
SPOT_KINDS = [("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]


#: Rows whose spans and words are Python objects at one time; what is handed on are Arrow's flat arrays.
ROWS = 128


def in_portions(batch: pa.Array, make: Callable[[list[str]], pa.Array], *more: pa.Array) -> pa.Array:
    """``make`` over a batch of texts, a few rows at a time, so that the objects of a few rows exist together."""
    nothing_held()
    parts = [make([t.as_py() for t in batch[at : at + ROWS]], *[m[at : at + ROWS] for m in more]) for at in range(0, max(1, len(batch)), ROWS)]
    whole = pa.concat_arrays(parts)
    parts.clear()
    handed_back()
    return whole


def found(text: Column, near: int) -> Column:
    """Struct of the base spans, their digest, the words near them, and each entity with a code of its surroundings."""

    @F.arrow_udf(f"struct<base:{SPAN},base_sha256:string,near:{NEAR},entities:{CODED}>")
    def of(texts: pa.Array) -> pa.Array:
        return in_portions(texts, portion)

    def portion(texts: list[str | None]) -> pa.Array:
        spans, words, entities = [], [], []
        for value in texts:
            t = value or ""
            spans.append(base_spans(t))
            words.append(list(dict.fromkeys(x[:3] for x in surroundings(t, spans[-1], near))) if spans[-1] else [])
            codes: dict[str, int] = {}
            for _, start, end in spans[-1]:
                name, code = t[start:end].lower(), around(t, start, end, near)
                codes[name] = min(code, codes.get(name, code))
            entities.append(list(codes.items()))
        digests = pa.array([sha256(listed(s).encode()).hexdigest() for s in spans], pa.string())
        parts = [_structs(spans, SPAN_KINDS), digests, _structs(words, NEAR_KINDS), _structs(entities, CODED_KINDS)]
        return pa.StructArray.from_arrays(parts, ["base", "base_sha256", "near", "entities"])

    return of(text)


def coded_words(text: Column, near: int) -> Column:
    """Different words of a text outside its entities, each with a code of its surroundings: the least of all places."""

    @F.arrow_udf(CODED)
    def of(texts: pa.Array) -> pa.Array:
        return in_portions(texts, portion)

    def portion(texts: list[str | None]) -> pa.Array:
        out = []
        for value in texts:
            t = value or ""
            codes: dict[str, int] = {}
            for word, start, end in words_outside(t, [(a, b) for _, a, b in base_spans(t)]):
                code = around(t, start, end, near)
                codes[word] = min(code, codes.get(word, code))
            out.append(list(codes.items()))
        return _structs(out, CODED_KINDS)

    return of(text)


def words_of(text: Column, only: frozenset[str] | None) -> Column:
    """Different words of a text, of ``only`` if given."""

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return in_portions(texts, portion)

    def portion(texts: list[str | None]) -> pa.Array:
        rows = [{m.lower() for m in WORD.findall(t or "")} for t in texts]
        return pa.array([sorted(r if only is None else r & only) for r in rows], pa.list_(pa.string()))

    return of(text)


def _sent(terms: DataFrame) -> frozenset[str] | None:
    """The words of a table that is small enough to be sent to every task; none of a larger one."""
    return frozenset(r[0] for r in terms.collect()) if terms.count() <= BROADCAST_TERMS else None


def revealing(rows: DataFrame, table: DataFrame, how: Disclosure) -> DataFrame:
    """entity, term, share, bits of the pairs over the thresholds.

    ``rows`` (doc_id, text) is the corpus, ``table`` (doc_id, near, entities) what ``found`` says of it. A pair is counted in
    every document that holds both, wherever they stand. Its evidence are the different surroundings of the entity that hold the
    word, or the different documents' surroundings of both, whichever are more.
    """
    spark = rows.sparkSession
    total = max(1, rows.count())
    one = F.lit(1)
    near = table.where(F.size("near") > 0).select(F.explode("near").alias("n")).select("n.*").distinct()
    near = written(spark, near.groupBy("entity", "term").agg(F.count(one).alias("n_near")).where(F.col("n_near") >= how.surroundings), "pii-near")
    held = table.where(F.size("entities") > 0).select("doc_id", F.explode("entities").alias("e")).select("doc_id", F.col("e.name").alias("entity"), F.col("e.around").alias("e_around")).groupBy("doc_id", "entity").agg(F.min("e_around").alias("e_around"))
    # Entities that no word can reveal: in too few documents and surroundings, or in so many that no share gives the bits.
    known = held.groupBy("entity").agg(F.count(one).alias("n_entity")).join(near.select("entity", F.lit(True).alias("often")).distinct(), "entity", "left")
    known = known.where(((F.col("n_entity") >= how.surroundings) | F.col("often")) & (F.col("n_entity") <= total / 2.0**how.bits)).select("entity", "n_entity")
    held = written(spark, held.join(known, "entity"), "pii-entities")
    # Per document: how many documents its commonest entity is in, and into how many blocks its entities are cut.
    docs = held.groupBy("doc_id").agg(F.max("n_entity").alias("n_most"), F.ceil(F.count(one) / BLOCK).cast("int").alias("blocks"))
    docs = written(spark, docs, "pii-docs")
    coded = rows.join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode(coded_words(F.col("text"), how.near)).alias("w"))
    coded = written(spark, coded.select("doc_id", F.col("w.name").alias("term"), F.col("w.around").alias("t_around")).groupBy("doc_id", "term").agg(F.min("t_around").alias("t_around")), "pii-words")
    terms = coded.select("term").distinct()
    only = _sent(terms)
    # Words of one text are different ones, so documents are counted as they come, in partial counts. Only ids that stand on several
    # rows, and rows without one, need their words to be told apart by id.
    again = written(spark, rows.groupBy("doc_id").agg(F.count(one).alias("n")).where("n > 1 and doc_id is not null").select("doc_id", F.lit(True).alias("again")), "pii-again")
    own = F.when(F.col("again") | F.col("doc_id").isNull(), F.struct("doc_id")).alias("own")
    tokens = rows.join(again, "doc_id", "left").select(own, F.explode(words_of(F.col("text"), only)).alias("term"))
    counted = tokens.groupBy("term", "own").agg(F.count(one).alias("n"))
    counted = counted.groupBy("term").agg(F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(1)).alias("n_term"))
    # A word in more documents than an entity's share allows cannot reveal it.
    words = coded.join(counted, "term").join(docs, "doc_id").where(F.col("n_term") * how.share <= F.col("n_most"))
    words = words.select("doc_id", "term", "t_around", "n_term", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    held = held.join(docs.select("doc_id", "blocks"), "doc_id").withColumn("block", F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int"))
    met = held.join(words, ["doc_id", "block"]).where(F.col("n_term") * how.share <= F.col("n_entity"))
    met = met.groupBy("entity", "term", F.xxhash64("e_around", "t_around").alias("around")).agg(F.count(one).alias("n"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    met = met.groupBy("entity", "term").agg(F.count(one).alias("n_around"), F.sum("n").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    met = met.join(near, ["entity", "term"], "left").where(F.greatest("n_around", F.coalesce("n_near", F.lit(0))) >= how.surroundings)
    share = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    scored = met.select("entity", "term", share.alias("share"), F.log2(share * F.lit(float(total)) / F.col("n_entity")).alias("bits"))
    return scored.where((F.col("share") >= how.share) & (F.col("bits") >= how.bits))


def places(text: str | None, terms: dict[str, bool]) -> list[tuple[int, int, bool]]:
    """Every place of disclosing words outside the entities, with whether it is removed."""
    if not text or not terms or not any(w.lower() in terms for w in WORD.findall(text)):
        return []
    return [(a, b, terms[w]) for w, a, b in words_outside(text, [(a, b) for _, a, b in base_spans(text)]) if w in terms]


def spots(text: Column, hits: Column | None, sent: dict[str, bool]) -> Column:
    """``places`` of each row; the words are ``hits`` or else ``sent``."""
    if hits is None:

        @F.arrow_udf(SPOTS)
        def of(texts: pa.Array) -> pa.Array:
            return in_portions(texts, lambda part: _structs([places(t, sent) for t in part], SPOT_KINDS))

        return of(text)

    @F.arrow_udf(SPOTS)
    def each(texts: pa.Array, words: pa.Array) -> pa.Array:
        listed = lambda ws: {w["term"]: w["remove"] for w in ws.as_py() or []}
        return in_portions(texts, lambda part, own: _structs([places(t, listed(ws)) for t, ws in zip(part, own)], SPOT_KINDS), words)

    return each(text, hits)


def holders(rows: DataFrame, near: int) -> DataFrame:
    """doc_id, near, entities (as ``found`` has them) of the rows that hold an entity.

    Searched once: else the filter would search the texts again, by a second Python worker beside the first of each task.
    """
    return once(rows, "doc_id", f=found(F.col("text"), near)).select("doc_id", "f.near", "f.entities").where(F.size("entities") > 0)


def disclosing(docs: DataFrame, how: Disclosure) -> dict[str, bool] | DataFrame:
    """The disclosing words of a corpus and whether each is removed: as a dictionary, or as a table where they are many."""
    spark, rows = docs.sparkSession, doc_rows(docs)
    table = written(spark, holders(rows, how.near), "pii-found")
    if table.isEmpty():
        return {}
    terms = revealing(rows, table, how).groupBy("term").agg((F.max("share") >= how.remove).alias("remove"))
    terms = written(spark, terms, "pii-terms")
    return {r["term"]: r["remove"] for r in terms.collect()} if terms.count() <= BROADCAST_TERMS else terms


def marked(docs: DataFrame, terms: dict[str, bool] | DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the places of the disclosing words in each row's own text."""
    text = docs["text"].cast("string")
    if isinstance(terms, dict):
        return docs.withColumn(name, spots(text, None, terms) if terms else F.array().cast(SPOTS))
    # By the text's own code, which rows without an id have too; texts that share a code just share their words.
    coded, held = free_name(docs, "_text_code"), free_name(docs, "_hits")
    hits = doc_rows(docs).select(F.xxhash64("text").alias(coded), F.explode(words_of(F.col("text"), None)).alias("term")).distinct().join(terms, "term")
    hits = hits.groupBy(coded).agg(F.collect_list(F.struct("term", "remove")).alias(held))
    met = docs.withColumn(coded, F.xxhash64(text)).join(hits, coded, "left")
    return met.withColumn(name, spots(F.col("text").cast("string"), F.col(held), {})).drop(coded, held)


def personal(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, base (spans), base_sha256, terms (spans with ``remove``) for every row of ``docs``."""
    rows = doc_rows(docs)
    out = marked(rows.withColumn("found", found(F.col("text"), how.near)), disclosing(rows, how), "terms")
    return out.select("doc_id", "found.base", "found.base_sha256", "terms")


def _cleaned(text: str | None, base: list[tuple[str, int, int]], terms: list[tuple[int, int, bool]]) -> str | None:
    spans = [(a, b, f"[{kind.upper()}]") for kind, a, b in base] + [(a, b, "" if remove else "[TERM]") for a, b, remove in terms]
    if text is None or not spans:
        return text
    parts, at, last = [], 0, 0
    for start, end, mark in sorted(spans):
        if start >= last:
            parts += [text[at:start], mark]
        last = at = max(last, end)
    return "".join(parts) + text[at:]


def cleaned(text: Column, terms: dict[str, bool] | Column) -> Column:
    """Text with entities and generalised words as placeholders and removed words gone; overlapping spans become one.

    With the words at hand all is done in one call, so that a task needs one Python worker; else ``terms`` are their places.
    """
    if isinstance(terms, dict):

        @F.arrow_udf("string")
        def of(texts: pa.Array) -> pa.Array:
            return in_portions(texts, lambda part: pa.array([_cleaned(t, base_spans(t or ""), places(t, terms)) for t in part], pa.string()))

        return of(text)

    @F.arrow_udf("string")
    def each(texts: pa.Array, words: pa.Array) -> pa.Array:
        listed = lambda ws: [(w["start"], w["end"], w["remove"]) for w in ws.as_py() or []]
        return in_portions(texts, lambda part, own: pa.array([_cleaned(t, base_spans(t or ""), listed(ws)) for t, ws in zip(part, own)], pa.string()), words)

    return each(text, terms)


def sanitised(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """All rows with all columns, ``text`` cleaned; ``n_chars``, where it is a column, follows the text.

    Base spans and the places of disclosing words are worked out in each row, with or without an id.
    """
    terms, spot = disclosing(docs, how), free_name(docs, "_terms")
    if isinstance(terms, dict):
        out = docs.withColumn("text", cleaned(docs["text"].cast("string"), terms))
    else:
        rows = marked(docs, terms, spot)
        out = rows.withColumn("text", cleaned(F.col("text").cast("string"), F.col(spot)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

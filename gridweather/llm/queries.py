"""Registered queries of the text operators, each over its whole table, and the twins that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridweather import session
from gridweather.llm import decontaminate, filter_audit, hilbert, language_model, licences, main_text, merkle, minhash, pieces, pii, quality, secret_scan, url_filter
from gridweather.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(session.prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


@query("op1_minhash_near_duplicates")
def op1(spark, sf_dir):
    how = minhash.Similarity(shingle=3, percent=85)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), how).select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_secret_battery")
def op2(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in secret_scan.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.listed(secret_scan.KINDS), 256).alias("base_sha256"),
        secret_scan.listed((*secret_scan.KINDS, secret_scan.RANDOM)).alias("spans"), F.size("random").cast("bigint").alias("n_random"),
    )


@query("op3_kneser_ney")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = language_model.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return language_model.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_disclosing_terms")
def op4(spark, sf_dir):
    found = pii.personal(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    text = lambda kind, start, end: F.concat_ws(":", kind, start.cast("string"), end.cast("string"))
    spans = F.concat(F.transform("base", lambda s: text(s["kind"], s["start"], s["end"])), F.transform("terms", lambda s: text(F.lit(pii.TERM), s["start"], s["end"])))
    return found.select("doc_id", *counts, "base_sha256", F.array_join(spans, ",").alias("spans"), F.size("terms").cast("bigint").alias("n_terms"))


@query("op5_main_text")
def op5(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op6_host_reputation")
def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict", F.round("badness", 6).alias("badness"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes of pages: the last number of a page's path names the document it shows, whose label it takes."""
    named = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    shown = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), F.when(named != "", named.cast("bigint")).alias("doc_id"))
    marks = labels.where("doc_id is not null").select("doc_id", ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    marks = marks.groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return shown.join(marks, "doc_id").groupBy("page_id", "host").agg(F.max("bad").alias("bad"))


@query("op7_piece_transducer")
def op7(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op8_compression_bands")
def op8(spark, sf_dir):
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_bytes")


@query("op9_template_windows", decontaminate.sql())
def op9(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_licence_digests", licences.sql())
def op10(spark, sf_dir):
    return licences.licences(table(spark, sf_dir, "documents"))


@query("op11_hilbert_shards")
def op11(spark, sf_dir):
    rows = hilbert.shards(table(spark, sf_dir, "documents"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op12_path_copying_manifest", merkle.sql())
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    # No text, no change: a null text stays null, which is the dataset itself.
    out = merkle.manifest(docs, F.when(tampered, F.replace(docs["text"], F.lit("\n"), F.lit(""))))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_copied")


@query("op13_filter_orders", filter_audit.sql())
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

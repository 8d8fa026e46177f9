"""Hilbert shards, the Merkle manifest and the filter audit against brute force, and their odd inputs."""

import hashlib
import itertools
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridweather.llm import common, filter_audit, hilbert, licences, main_text, merkle, pieces, pii, secret_scan
from gridweather.llm.common import table
from gridweather.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: Hilbert-curve shards


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2), (3, 1), (1, 5)])
def test_curve_visits_every_point_by_single_steps(dimensions, bits):
    points = np.array(list(itertools.product(range(2**bits), repeat=dimensions)))
    index = hilbert.curve_index([points[:, i] for i in range(dimensions)], bits)
    assert sorted(index) == list(range(2 ** (dimensions * bits)))
    assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def test_curve_starts_like_the_drawn_one():
    """The plane's curve of order one: a cup through its four points."""
    assert list(hilbert.curve_index([np.array([0, 0, 1, 1]), np.array([0, 1, 1, 0])], 1)) == [0, 1, 2, 3]


def laid_out(rows, count):
    """The law of rows: runs at most one apart, places without gaps."""
    held = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(count)}
    sizes = [len(v) for v in held.values()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(v == list(range(len(v))) for v in held.values())


def test_shards_of_documents(spark):
    docs = {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op11_hilbert_shards"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    laid_out(got, 24)
    for r in got:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    # Along shards and places the rows follow the curve, worked out anew from the columns' cells.
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    along = [docs[r["doc_id"]] for r in got]
    cells = []
    for name in ("source", "lang"):
        values = sorted({d[name] for d in along}, key=str.encode)
        cells.append(np.array([(values.index(d[name]) + 2) * 64 // (len(values) + 2) for d in along]))
    sizes = np.array([d["n_chars"] for d in along])
    edges = np.unique(np.quantile(sizes, [(i + 1) / 63 for i in range(62)], method="inverted_cdf"))
    cells.append((np.searchsorted(edges, sizes, side="right") + 1) * 64 // (len(edges) + 2))
    place = hilbert.curve_index(cells, 6)
    assert list(place) == [r["curve"] for r in got] == sorted(place)


def test_boxes_prune_by_every_column(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    along = hilbert.shards(docs, 24)
    box = hilbert.boxes(along).cache()
    assert box.agg(F.sum("rows")).first()[0] == docs.count()
    kept = [hilbert.may_hold(box, source="src3").count(), hilbert.may_hold(box, lang="es").count(), hilbert.may_hold(box, n_chars=(0, 300)).count()]
    assert all(0 < k < 24 for k in kept) and hilbert.may_hold(box, lang="de", n_chars=(0, 300)).count() <= 4
    # Nothing wanted is left out.
    shards = {r["shard"] for r in along.where("d0 = 'src3'").collect()}
    assert shards <= {r["shard"] for r in hilbert.may_hold(box, source="src3").collect()}


def test_shards_of_odd_rows(spark, odd_docs, no_docs):
    got = hilbert.shards(odd_docs, 4).collect()
    laid_out(got, 4)
    assert len(got) == odd_docs.count()
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert hilbert.shards(no_docs, 4).count() == 0
    few = hilbert.shards(odd_docs.limit(3), 24).collect()
    laid_out(few, 24)
    with pytest.raises(ValueError):
        hilbert.Curve(bits=40)


def test_equal_rows_share_no_place(spark):
    """A third of the rows and more are the same row; dates, times, numbers with NaN and null as columns."""
    rows = spark.range(900).selectExpr(
        "if(id < 400, 7, id) as doc_id", "if(id < 400, 'same', repeat('x', int(id % 5))) as text", "if(id % 3 = 0, null, if(id < 400, double('NaN'), double(id))) as x",
        "date_add(date'2025-01-01', int(id % 7)) as day", "timestamp_seconds(id) as at", "cast(id as string) as n",
    )
    got = hilbert.shards(rows, 7, hilbert.Curve(("x", "day", "at", "n"), 5)).collect()
    laid_out(got, 7)
    assert len(got) == 900


# 12: Merkle manifest


def joined(nodes):
    return [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]


def manifest_by_force(rows, tampered):
    """Whole levels as lists; per row the tampered leaf is folded with the run's others."""
    write = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(write, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    first = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names, trees = sorted(groups, key=first), {}
    for name in names:
        groups[name] = sorted(groups[name], key=lambda r: (first(r["doc_id"]), leaf(r, r["text"])))
        trees[name] = [[leaf(r, r["text"]) for r in groups[name]]]
        while len(trees[name][-1]) > 1:
            trees[name].append(joined(trees[name][-1]))
    top = [[trees[n][-1][0] for n in names]]
    while len(top[-1]) > 1:
        top.append(joined(top[-1]))
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            new = r["text"] is not None and r["doc_id"] is not None and tampered(r["doc_id"])
            node, proof = leaf(r, r["text"].replace("\n", "")) if new else leaf(r, r["text"]), ""
            for levels, at in ((trees[name], i), (top, k)):
                for level in levels[:-1]:
                    run, own = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    a, b = "".join(run[:own]), "".join(run[own + 1 :])
                    proof, node, at = proof + a + b, sha(a + node + b), at // 3
            out.append((r["doc_id"], leaf(r, r["text"]), trees[name][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return Counter(out)


def odd(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 2 == 0


def manifested(docs):
    change = F.when(F.crc32(docs["doc_id"].cast("string")) % 2 == 0, F.replace(docs["text"], F.lit("\n"), F.lit("")))
    return merkle.manifest(docs, change)


def as_counter(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def test_manifest_over_several_blocks(spark):
    """Groups of one leaf, of one block, of whole blocks and of a block more, null and odd names among them."""
    sizes = {None: 3, "": 1, "a": 729, "b": 730, "B": 2200, "é": 10, "￿": 2, "😀": 5}
    rows = [(i * 7 % 5000, f"line {i}\n" * (i % 3), "en", i if i % 4 else None, name) for name, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, source string")
    got = as_counter(manifested(docs))
    assert got == manifest_by_force([r.asDict() for r in docs.collect()], odd)
    assert any(v[-1] for v in got) and any(not v[-1] for v in got)


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    assert as_counter(manifested(odd_docs)) == manifest_by_force([r.asDict() for r in odd_docs.collect()], odd)
    assert manifested(no_docs).count() == 0
    assert manifested(odd_docs.limit(1)).count() == 1


def test_versions_share_nodes():
    tree = merkle.Persistent()
    base = tree.grown([sha(str(i)) for i in range(20)], 3)
    whole = list(zip(tree.digests, tree.children))
    version = tree.changed(base, 13, 3, sha("other"))
    # Nothing that was there has changed, and a version adds its leaf and one node a level.
    assert list(zip(tree.digests, tree.children))[: len(whole)] == whole and len(tree.digests) == len(whole) + 4
    fresh = merkle.Persistent()
    again = fresh.grown([sha("other") if i == 13 else sha(str(i)) for i in range(20)], 3)
    assert tree.digests[version] == fresh.digests[again] != tree.digests[base]
    # A version of the version leaves both as they are, and changing back gives the first root.
    back = tree.changed(version, 13, 3, sha("13"))
    assert tree.digests[back] == tree.digests[base] and merkle.folded(sha("13"), tree.siblings(base, 13, 3)) == tree.digests[base]


# 13: filter audit


def audit_by_force(docs, labels):
    first, fails = {}, []
    for r in docs:
        if r["doc_id"] is not None:
            key = r["text"] or ""
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    for r in docs:
        text = r["text"] or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        bad = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        bad += "D" * any(c in "#$%&*|" for c in text) + "E" * (r["doc_id"] is not None and r["doc_id"] > first[text])
        marks = [x for x in labels if x["doc_id"] is not None and x["doc_id"] == r["doc_id"]]
        fails.append((r["lang"] or "", bad, any(x["quality"] == 1 for x in marks), any(x["toxic"] == 1 for x in marks)))
    out, removed_by = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for k, letter in enumerate(order):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                early = sum(letter in f[1] and any(x in f[1] for x in order[:k]) for f in fails if f[0] == part)
                only = sum(f[1] == letter for f in fails if f[0] == part)
                out[part, "".join(order), k + 1] = (letter, len(left), len(gone), early, only, sum(f[2] for f in gone), sum(f[3] for f in gone))
                removed_by[part, letter] += len(gone)
    return {k: (*v, removed_by[k[0], v[0]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("letter", *filter_audit.METRICS, "shapley")) for r in filter_audit.audit(docs, labels).collect()}


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 1), (6, 1, 0), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    # Every text also as another id, under several parts, with a part that is a text of no characters.
    more = odd_docs.unionByName(odd_docs.withColumn("lang", F.lit("")).withColumn("doc_id", F.col("doc_id") + 100))
    more = more.unionByName(odd_docs.withColumn("lang", F.lit("xx")).withColumn("text", F.concat(F.col("text"), F.lit(" #LOUD"))))
    want = audit_by_force([r.asDict() for r in more.collect()], [r.asDict() for r in labels.collect()])
    assert audited(more, labels) == want and len(want) == 1200
    assert audited(no_docs, labels) == {}
    assert len(audited(odd_docs, labels.where("false"))) == 600


def test_audit_of_one_text_many_times(spark):
    """All rows are copies of one text: every one but the least id is removed by E, in any order."""
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word other ', 150) || 'x' as text", "'en' as lang")
    got = audited(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert got["en", "EABCD", 1] == ("E", 1, 2999, 0, 0, 0, 0, got["en", "EABCD", 1][-1])
    assert got["en", "BEACD", 2][1:4] == (0, 0, 2999)


# Texts of any length, and what stays in a worker


def test_many_secrets_in_one_text(spark):
    """Two hundred thousand values in one text: time follows their number, and places are those of a plain search."""
    value = hashlib.sha256(b"x").hexdigest()[:24]
    text = "é " + f"{value} token=abcdef{'1' * 4} " * 100_000
    docs = spark.createDataFrame([(1, text), (1, text), (2, value)], "doc_id bigint, text string")
    began = time.perf_counter()
    got = secret_scan.scan(docs).select("doc_id", "hex", "assign", "random").collect()
    assert time.perf_counter() - began < 120
    for r in got[:2]:
        if r["doc_id"] == 1:
            assert [(s["start"], s["end"]) for s in r["hex"]] == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)]
            assert len(r["assign"]) == 100_000 and r["random"] == []


@pytest.mark.parametrize("text", ["1" * 10**6 + ".", "a" * 10**6 + "@", "a@" * 10**6, "1." * 10**6, "+1" * 10**6, "a@b.c" * 10**6, "1 " * 10**6])
def test_long_runs_of_personal_characters(text):
    began = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - began < 10


@settings(max_examples=500, deadline=None)
@given(st.text("ab.@-+_ 129", max_size=40))
def test_personal_spans_are_those_of_the_patterns(text):
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    assert pii.emails(text) == [m.span() for m in re.finditer(email, text)]
    small = lambda m: all(int(p) <= 255 for p in m[0].split("."))
    assert pii.addresses(text) == [m.span() for m in re.finditer(ip, text) if small(m)]


def test_own_columns_stay(spark, odd_docs):
    docs = odd_docs.withColumns({n: F.lit(i) for i, n in enumerate(["_found", "_Terms", "_text_code", "_hits"])})
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.select("_found", "_Terms", "_text_code", "_hits").collect()} == {(0, 1, 2, 3)}


def test_a_worker_holds_one_operator():
    first = common.held("one", dict)
    first["x"] = 1
    assert common.held("one", dict) is first
    assert common.held("two", list) == [] and common.held("one", dict) == {}
    common.nothing_held()
    assert not common._held


def anonymous_mb():
    """Memory of this process beside mapped files."""
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def test_a_worker_hands_freed_memory_back():
    """What lies below a block that stays is not left with the worker."""
    blocks = common.held("blocks", list)
    blocks += [np.ones(12_000) for _ in range(1_000)]
    stays = np.ones(12_000)
    del blocks
    before = anonymous_mb()
    common.nothing_held()
    assert stays.all() and before - anonymous_mb() > 50


def test_pieces_of_a_large_batch_are_worked_out_in_portions(monkeypatch):
    """Python holds the texts, ids and counts of a portion, however many rows a batch has; rows stay as they are by themselves."""
    model = pieces.Transducer(pieces.default_model())
    texts = [None if i % 150 == 49 else "" if i % 150 == 50 else f"row {i} of prose, " * 300 for i in range(400)]

    def peak(rows, many):
        monkeypatch.setattr(pieces, "ROWS", rows)
        tracemalloc.start()
        out = pieces.in_portions(model, pa.array(texts[:many], pa.string()))
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held, out

    pieces.in_portions(model, pa.array(texts[:1]))
    (one, _), (all_of, out), (whole, same) = peak(50, 50), peak(50, 400), peak(400, 400)
    assert out.equals(same) and out.is_null().to_pylist() == [t is None for t in texts]
    assert out.field("ids").to_pylist()[48:53] == [model.encode(texts[48]), [], [], model.encode(texts[51]), model.encode(texts[52])]
    assert all_of < 2 * whole / 3 and one > all_of / 2


def test_personal_data_is_searched_once_a_row(spark):
    """The filter on what is found does not search again, so a task needs one Python worker."""
    docs = spark.createDataFrame([(1, "mail a@b.de now"), (1, "mail a@b.de now"), (2, "none"), (3, None), (None, "from 1.2.3.4")], "doc_id bigint, text string")
    found = pii.holders(docs, 60)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["doc_id"] or 0, [e["name"] for e in r["entities"]]) for r in found.collect()) == [(0, ["1.2.3.4"]), (1, ["a@b.de"]), (1, ["a@b.de"])]


def test_article_pages_are_chosen_by_id(spark):
    """The first ids by order are learned from, whole; repeated pages of an id all count."""
    page = "<html><body><nav>menu</nav><article><p>{}</p></article></body></html>"
    rows = [(i, f"u{i}", page.format("word " * 50)) for i in range(40)] + [(100, "u", "<article><nav>" + "x " * 500 + "</nav></article>")] * 3 + [(None, "n", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    few, all_of = main_text.fit(pages, 10), main_text.fit(pages, 1000)
    assert few != all_of and few == main_text.fit(pages.where("page_id < 10"), 1000)


def test_no_licence_line_of_the_documents_is_left_out(spark):
    """Every line of the given documents that speaks of a licence is known, counted from the documents themselves."""
    sf_dir = "/root/testdata/sf0.01"
    lines = [line.strip() for r in table(spark, sf_dir, "documents").collect() for line in (r["text"] or "").split("\n") if "licen" in line.lower() and len(line) < 120]
    found = QUERIES["op10_licence_digests"](spark, sf_dir).agg(F.sum("n_lines")).first()[0]
    assert lines and found == len(lines)
    short = spark.createDataFrame([(1, "CC BY-SA 3.0"), (2, "licensed under cc by-nc-nd 4.0"), (3, "CC BY 7.0")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["licence"]) for r in licences.licences(short).collect()} == {(1, "CC-BY-SA-3.0"), (2, "CC-BY-NC-ND-4.0")}

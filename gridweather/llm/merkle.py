"""Merkle manifest of a dataset: a persistent tree per group of rows, versions by path copying, proofs for every row.

Each row is a leaf, the digest of its fields. Per group, leaves in order of their id are joined in runs of three, level by level,
until one node remains; these subroots, in order of their group, are joined likewise to the root.

The tree is built in aligned blocks of ``ARITY ** LEVELS`` nodes: a block is a subtree of its own, so blocks are built in parallel, and
the nodes that remain of them are the leaves of the next, much smaller tree, which is built the same way until one node is left.
Inside a block the tree is persistent. Nodes are never changed; a changed leaf makes a version: a new leaf and new ancestors, which
point to the untouched nodes of the version before. Above the block every version goes on by itself, along the path that its block
has through the upper trees, again copying one node a level: versions are never gathered there, so a task holds one block at most.

Null fields are written as a hyphen. Rows are ordered by id (null first), equal ids by their leaf; repeated rows are leaves of their
own with equal digests. Null groups come first. An empty table has no rows and no root. Other columns are never touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridweather.llm.common import written
from gridweather.operators.numbered import numbered

ARITY = 3
#: Levels of one block: at most 729 leaves, and versions of as many.
LEVELS = 6
BLOCK = ARITY**LEVELS
#: Levels of a path: digests of the nodes before and behind in the run, as text.
PATH = "array<struct<left:string,right:string>>"
#: Name of a tree: its group within a struct, where null is a value like others.
TREE = "struct<of:string>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode("utf-8")).hexdigest()


@dataclass
class Persistent:
    """Nodes of a tree and all its versions: digests and children by number, only ever added to."""

    digests: list[str] = field(default_factory=list)
    children: list[tuple[int, ...]] = field(default_factory=list)

    def leaf(self, of: str) -> int:
        return self._add(of, ())

    def over(self, children: tuple[int, ...]) -> int:
        return self._add(digest("".join([self.digests[c] for c in children])), children)

    def _add(self, of: str, children: tuple[int, ...]) -> int:
        self.digests.append(of)
        self.children.append(children)
        return len(self.digests) - 1

    def grown(self, leaves: list[str], levels: int) -> int:
        """Root of a new tree: ``levels`` times, runs of three become one node, the last run as it is."""
        nodes = [self.leaf(x) for x in leaves]
        for _ in range(levels):
            nodes = [self.over(tuple(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
        return nodes[0]

    def path(self, root: int, at: int, levels: int) -> list[tuple[int, int]]:
        """(node, which of its children is next) from the root down to the leaf at place ``at``."""
        out = []
        for level in range(levels, 0, -1):
            child = at // ARITY ** (level - 1) % ARITY
            out.append((root, child))
            root = self.children[root][child]
        return out

    def changed(self, root: int, at: int, levels: int, leaf: str) -> int:
        """Root of a version with another leaf: its ancestors are copied, all other nodes are shared with the version before."""
        new = self.leaf(leaf)
        for node, child in reversed(self.path(root, at, levels)):
            kept = self.children[node]
            new = self.over((*kept[:child], new, *kept[child + 1 :]))
        return new

    def siblings(self, root: int, at: int, levels: int) -> list[tuple[str, str]]:
        """(digests before, digests behind) in the run of the leaf and of each ancestor, from the leaf up."""
        out = []
        for node, child in reversed(self.path(root, at, levels)):
            run = [self.digests[c] for c in self.children[node]]
            out.append(("".join(run[:child]), "".join(run[child + 1 :])))
        return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def levels_of(n: int, most: int = LEVELS) -> int:
    """Levels until one of ``n`` nodes remains, as far as a block goes."""
    out = 0
    while n > 1 and out < most:
        n = -(-n // ARITY)
        out += 1
    return out


def node_block() -> Column:
    return F.floor(F.col("at") / BLOCK).alias("block")


def leaf_of(columns: list[Column]) -> Column:
    """Digest of fields in turn: a hyphen for null, else the count of UTF-8 bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tops(nodes: DataFrame) -> DataFrame:
    """tree, block, n (nodes of the tree) and top (the node that remains of the block) from tree, at (from 0 on), n, digest."""
    schema = f"tree {TREE}, block bigint, n bigint, top string"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def top(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["at"])
        tree, first = Persistent(), rows[0]
        root = tree.grown([r["digest"] for r in rows], levels_of(first["n"]))
        return pa.Table.from_pylist([{"tree": first["tree"], "block": first["block"], "n": first["n"], "top": tree.digests[root]}], kinds)

    return nodes.select("tree", node_block(), "at", "n", "digest").groupBy("tree", "block").applyInArrow(top, schema)


def met(nodes: DataFrame, above: DataFrame, each: Callable[[list[dict], dict], Iterator[dict]], schema: str) -> DataFrame:
    """What ``each`` makes of the nodes of a block, in order, and the block's row of ``above``; one task holds one block."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["at"])
        return pa.Table.from_pylist(list(each(rows, right.to_pylist()[0])) if rows else [], kinds)

    left = nodes.withColumn("block", node_block()).groupBy("tree", "block")
    return left.cogroup(above.groupBy("tree", "block")).applyInArrow(block, schema)


def upper(below: DataFrame, name: str) -> DataFrame:
    """tree, block, above (path of the block's node up to its tree's root) and root, for all blocks of ``tops``."""
    nodes = below.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    done = nodes.where("n <= 1").select("tree", F.col("at").alias("block"), F.array().cast(PATH).alias("above"), F.col("digest").alias("root"))
    more = nodes.where("n > 1")
    if more.isEmpty():
        return done
    return done.unionByName(paths(more, f"{name}-up").select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "root"))


def paths(nodes: DataFrame, name: str) -> DataFrame:
    """tree, at, path (from the node up to its tree's root) and root, for every one of ``nodes`` (tree, at, n, digest)."""

    def each(rows: list[dict], block: dict) -> Iterator[dict]:
        tree, levels = Persistent(), levels_of(rows[0]["n"])
        root = tree.grown([r["digest"] for r in rows], levels)
        for i, r in enumerate(rows):
            path = [{"left": a, "right": b} for a, b in tree.siblings(root, i, levels)]
            yield {"tree": r["tree"], "at": r["at"], "path": path + block["above"], "root": block["root"]}

    above = upper(written(nodes.sparkSession, tops(nodes), name), name)
    return written(nodes.sparkSession, met(nodes, above, each, f"tree {TREE}, at bigint, path {PATH}, root string"), name)


def forest(below: DataFrame) -> DataFrame:
    """tree, block, above (path of the block's node up to the dataset's root), subroot and root, for all blocks of all trees.

    The subroots, in order of their groups, are the leaves of one more tree.
    """
    spark = below.sparkSession
    own = written(spark, upper(below, "merkle"), "merkle-own")
    subroots = own.where("block = 0").select(F.col("tree").alias("_of"), F.col("root").alias("digest"))
    placed = numbered(subroots, [], ["_of"], "at", "n")
    last = paths(placed.select(F.struct(F.lit(None).cast("string").alias("of")).alias("tree"), "at", "n", "digest"), "merkle-last")
    last = placed.join(last.select("at", F.col("path").alias("_path"), F.col("root").alias("_root")), "at")
    last = last.select(F.col("_of").alias("tree"), "_path", "_root")
    return own.join(last, "tree").select("tree", "block", F.concat("above", "_path").alias("above"), F.col("root").alias("subroot"), F.col("_root").alias("root"))


def _proved(rows: list[dict], block: dict) -> Iterator[dict]:
    """The proof of each leaf of a block, and the root of its version: inside the block by copying the leaf's path, above it along
    the path of the block."""
    tree, levels = Persistent(), levels_of(rows[0]["n"])
    base = tree.grown([r["digest"] for r in rows], levels)
    whole = len(tree.digests)
    above = [(p["left"], p["right"]) for p in block["above"]]
    beyond = "".join([a + b for a, b in above])
    for i, r in enumerate(rows):
        proof = digest("".join([a + b for a, b in tree.siblings(base, i, levels)]) + beyond)
        version = base if r["changed"] is None else tree.changed(base, i, levels, r["changed"])
        yield {
            "doc_id": r["doc_id"], "leaf": r["digest"], "subroot": block["subroot"], "root": block["root"], "proof_sha256": proof,
            "folded_root": folded(tree.digests[version], above),
            "n_copied": 0 if version == base else levels + 1 + len(above), "n_shared": whole if version == base else whole - levels - 1,
        }


def manifest(docs: DataFrame, changed: Column, group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row as a leaf: doc_id, leaf, subroot, root and proof_sha256 of the dataset as it is; folded_root of the version in which
    this row alone has ``changed`` as its last field (null: no version, the dataset itself); verified, whether that is the root;
    n_copied, the nodes that the version copied, and n_shared, the nodes of its block that it shares with the dataset.
    """
    spark = docs.sparkSession
    before = [docs[f] for f in fields]
    other = F.when(changed.isNotNull(), leaf_of([*before[:-1], changed]))
    rows = docs.select(
        docs[group].cast("string").alias("group"), docs[fields[0]].cast("bigint").alias("doc_id"), leaf_of(before).alias("digest"), other.alias("changed")
    )
    rows = written(spark, rows, "merkle-leaves")
    nodes = numbered(rows, ["group"], ["doc_id", "digest"], "at", "n")
    nodes = nodes.select(F.struct(F.col("group").alias("of")).alias("tree"), "at", "n", "doc_id", "digest", "changed")
    above = written(spark, forest(written(spark, tops(nodes), "merkle-tops")), "merkle-above")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, n_copied bigint, n_shared bigint"
    return met(nodes, above, _proved, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(levels: int = 11) -> str:
    """DuckDB twin over ``documents`` with the contract's tampering: no blocks and no versions, but each level over whole trees, for
    groups and as many groups of up to ``ARITY ** levels`` nodes."""
    value = "case when {0} is null then '-' else cast(strlen(cast({0} as varchar)) as varchar) || ':' || cast({0} as varchar) end"
    leaf = lambda text: "sha256(" + " || ".join(value.format(f) for f in (*FIELDS[:-1], text)) + ")"
    # CRC-32 of ASCII text, bit by bit.
    shift = "list_reduce(range(8), lambda x, k: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), xor(r, b))"
    codes = "list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))"
    crc = f"xor(list_reduce({codes}, lambda r, b: {shift}, cast(4294967295 as bigint)), cast(4294967295 as bigint))"
    run = "over (partition by s, i // 3 order by i)"
    steps = []

    def climb(name: str) -> None:
        """Levels of the trees ``{name}n0`` (s, i, node, c), and with each the state of the leaves in ``{name}t0``."""
        for k in range(levels):
            n, t, up = f"{name}n{k}", f"{name}t{k}", k + 1
            steps.append(f"""{name}l{k} as (select s, i, node, c, coalesce(lag(node, 2) {run}, '') || coalesce(lag(node) {run}, '') as a,
    coalesce(lead(node) {run}, '') || coalesce(lead(node, 2) {run}, '') as b from {n})""")
            steps.append(f"""{name}t{up} as (select t.* replace (t.i // 3 as i, proof || a || b as proof, case when c > 1 then sha256(a || fold || b) else fold end as fold, height + (case when c > 1 then 1 else 0 end) as height)
    from {t} t join {name}l{k} l on t.s = l.s and t.i = l.i)""")
            steps.append(f"""{name}n{up} as (select s, i // 3 as i, case when max(c) > 1 then sha256(string_agg(node, '' order by i)) else max(node) end as node, (max(c) + 2) // 3 as c from {n} group by s, i // 3)""")

    steps.append(f"d as (select *, {leaf('text')} as leaf, text is not null and {crc} % 2 = 0 as tampered from documents)")
    steps.append(f"e as (select *, case when tampered then {leaf('replace(text, chr(10), chr(32)[:0])')} else leaf end as fold from d)")
    steps.append("""r as (select doc_id, leaf, fold, tampered, dense_rank() over (order by source nulls first) as s,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as c from e)""")
    steps.append("gn0 as (select s, i, leaf as node, c from r)")
    steps.append("gt0 as (select s, i, doc_id, leaf, fold, tampered, '' as proof, 0 as height from r)")
    climb("g")
    steps.append(f"u as (select s as tree, node as subroot from gn{levels})")
    steps.append("un0 as (select 0 as s, tree - 1 as i, subroot as node, (select count(*) from u) as c from u)")
    steps.append(f"ut0 as (select 0 as s, s - 1 as i, s as tree, doc_id, leaf, fold, tampered, proof, height from gt{levels})")
    climb("u")
    body = ",\n".join(steps)
    return f"""with {body}
select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified,
  cast(case when tampered then height + 1 else 0 end as bigint) as n_copied
from ut{levels} join u using (tree) cross join un{levels}"""

"""Merkle manifest of a table: ternary trees of sources under one root, with a proof of each row."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, checkpointed

#: Children of a node, and levels that are recomputed from one stored level: an aligned subtree has FANOUT ** EVERY nodes.
FANOUT, EVERY = 3, 5
#: Tables of sources or of ranges up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
_STEP = "array<struct<left:string,right:string>>"
_ARROW_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def row_digest(values: list[Column]) -> Column:
    """sha256 of the values, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    text = [c.cast("string") for c in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `pos`, a row's place in its tree from 0, and `size`, the tree's rows. Rows are dealt by ranges of (tree, order),
    so that a tree of any size is sorted by many tasks; a range adds what the ranges before hold of its tree."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("mark", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.withColumn("range", F.shiftright("mark", 33)))
    of_tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(of_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("tree", "range").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    starts = checkpointed(sizes.select("tree", "range", (F.col("first") - before).alias("first"), F.sum("n").over(of_tree).alias("size")))
    near = bounded_broadcast(starts, starts.count(), BROADCAST_ROWS)
    return checkpointed(dealt.join(near, ["tree", "range"]).withColumn("pos", F.col("mark") - F.col("first")).drop("mark", "range", "first"))


def climb(nodes: list[str], last: bool, every: int) -> list[list[str]]:
    """The levels above consecutive nodes of an aligned subtree: `every` levels, or up to the root if these are all nodes."""
    levels = [nodes]
    for _ in range(every):
        if last and len(levels[-1]) == 1:
            break
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return levels


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _tops(every: int) -> Callable:
    """The stored node above one aligned subtree."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        t = _sorted(table)
        size = t["size"][0].as_py()
        levels = climb(t["node"].to_pylist(), size <= FANOUT**every, every)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": [key[1].as_py()], "node": [levels[-1][0]], "size": [-(-size // FANOUT**every)]})

    return run


def _chunk(every: int) -> Column:
    return F.floor(F.col("pos") / FANOUT**every).alias("chunk")


def stored_levels(leaves: DataFrame, every: int = EVERY) -> list[DataFrame]:
    """The leaves (tree, pos, node, size of the tree's level) and every `every`-th level above, up to one node a tree."""
    levels = [leaves]
    while not (above := levels[-1].where("size > 1")).isEmpty():
        levels.append(checkpointed(above.groupBy("tree", _chunk(every)).applyInArrow(_tops(every), "tree string, pos long, node string, size long")))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, node: what remains of each tree."""
    tops = [x.where("size = 1").select("tree", "node") for x in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _steps(nodes: list[str], last: bool, every: int) -> list[list[dict]]:
    """For each of the nodes, what stands to its left and right in its run, level by level of the recomputed subtree."""
    levels = climb(nodes, last, every)
    out = []
    for i in range(len(nodes)):
        own, at = [], i
        for level in levels[:-1]:
            run = at - at % FANOUT
            own.append({"left": "".join(level[run:at]), "right": "".join(level[at + 1 : run + FANOUT])})
            at //= FANOUT
        out.append(own)
    return out


def _regenerated(table: pa.Table, above: pa.Table, every: int) -> tuple[pa.Table, list[list[dict]]]:
    """The nodes of an aligned subtree in order, and the siblings of each from its run up to the root."""
    if not len(table):
        return table, []
    t = _sorted(table)
    upper = above["path"][0].as_py() if len(above) else []
    return t, [s + upper for s in _steps(t["node"].to_pylist(), t["size"][0].as_py() <= FANOUT**every, every)]


def _paths(every: int) -> Callable:
    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        t, paths = _regenerated(table, above, every)
        return pa.table({"tree": t["tree"], "pos": t["pos"], "path": pa.array(paths, _ARROW_STEP)})

    return run


def node_paths(levels: list[DataFrame], ends: DataFrame, leaf: Callable = _paths, schema: str = f"tree string, pos long, path {_STEP}", every: int = EVERY) -> DataFrame:
    """The siblings of each leaf from its run up to the root and on to `ends` (tree, path): what a tree's root has above it.

    From the top down, each stored level is read with the level above: a task regenerates the nodes of one aligned
    subtree from its stored nodes, emits their siblings, and forgets them.
    """
    # the root of a tree may be at any stored level; its path starts there
    tops = [x.where("size = 1").select("tree", "pos").join(ends, "tree") for x in levels]
    paths = tops[-1]
    for k in range(len(levels) - 2, -1, -1):
        make, kind = (leaf, schema) if k == 0 else (_paths, f"tree string, pos long, path {_STEP}")
        below = levels[k].where("size > 1")
        made = below.groupBy("tree", _chunk(every)).cogroup(paths.groupBy("tree", F.col("pos").alias("chunk"))).applyInArrow(make(every), kind)
        if k == 0:
            return made
        paths = checkpointed(made.unionByName(tops[k]))
    return paths


def fold(node: str, path: list[dict]) -> str:
    """The root that a node and its siblings give."""
    for step in path:
        node = digest(step["left"] + node + step["right"])
    return node


def _proofs(every: int) -> Callable:
    """A leaf's proof digest, and the root that its (perhaps tampered) row folds to."""

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        t, paths = _regenerated(table, above, every)
        proof = [digest("".join(s["left"] + s["right"] for s in p)) for p in paths]
        own = [seen or n for seen, n in zip(t["seen"].to_pylist(), t["node"].to_pylist(), strict=True)]
        folded = [fold(n, p) for n, p in zip(own, paths, strict=True)]
        return pa.table({"id": t["id"], "tree": t["tree"], "leaf": t["node"], "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})

    return run


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", every: int = EVERY) -> DataFrame:
    """One row per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Leaves of a source are in order of doc_id (null first,
    ties by leaf); every FANOUT consecutive nodes become one, until one is left: the source's subroot. Subroots by source
    (null first, in UTF-8 order) give the root in the same way. Only one level in `every` is stored; proofs regenerate
    the levels between from the stored nodes of an aligned subtree. A row whose doc_id has an even crc32 is tampered with
    (its text loses line feeds), and folds to the root only if its text had none.

    Texts are read once and hashed where they are read; digests and ids alone are shuffled, by ranges, so that a source
    of any size is many tasks. Rows that repeat are leaves of their own; of equal leaves it doesn't matter which is first.
    A null doc_id has no crc32 and is not tampered with. An empty text is `0:`. An empty table gives no rows. Extra columns
    are not read.
    """
    c = {n: F.col(k) for n, k in (("id", doc_id), ("source", source), ("lang", lang), ("n_chars", n_chars), ("text", text))}
    plain = docs.select(*[v.alias(n) for n, v in c.items()])
    own = [F.col(n) for n in ("id", "source", "lang", "n_chars")]
    even = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & (F.instr("text", "\n") > 0)
    leaf = row_digest([*own, F.col("text")])
    seen = F.when(even, row_digest([*own, F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    # a tree's name sorts as its source does, the null one first
    named = plain.select("id", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"), leaf.alias("node"), seen.alias("seen"))
    leaves = placed(named, ["id", "node"])
    levels = stored_levels(leaves, every)
    subroots = checkpointed(roots(levels))
    over = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), ["name"])
    above = stored_levels(over, every)
    root = roots(above).first()
    ways = node_paths(above, over.sparkSession.createDataFrame([("", [])], f"tree string, path {_STEP}"), every=every)
    ends = checkpointed(over.select("name", "pos").join(ways.select("pos", "path"), "pos").select(F.col("name").alias("tree"), "path"))
    kind = f"id {plain.schema['id'].dataType.simpleString()}, tree string, leaf string, proof_sha256 string, folded_root string"
    # a source of one row: its leaf is its subroot, whose proof begins above it
    out = leaves.where("size = 1").groupBy("tree").cogroup(ends.groupBy("tree")).applyInArrow(_proofs(every), kind)
    if len(levels) > 1:
        out = out.unionByName(node_paths(levels, ends, _proofs, kind, every))
    done = out.join(bounded_broadcast(subroots.select("tree", F.col("node").alias("subroot")), subroots.count(), BROADCAST_ROWS), "tree")
    done = done.withColumn("root", F.lit(root and root["node"]).cast("string"))
    return done.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

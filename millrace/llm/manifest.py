"""A Merkle manifest of a dataset: stored checkpoint layers, proofs by recomputation.

Every row is a leaf. Per ``lang`` the leaves ascend by ``doc_id`` and every ``ARITY``
consecutive nodes become one, until one is left, the subroot; the subroots, ordered by lang,
give the root in the same way. Of all levels only every ``STEP``-th is stored. A proof needs
the siblings on every level between: each aligned subtree of ``ARITY ** STEP`` stored nodes
makes its missing interior nodes again, in one bounded group, emits the siblings and drops them.

1. ``leaves``: one digest per row, by built-in functions. Equal rows are counted, not listed.
2. ``placed``: the leaves are sorted into ranges of (lang, doc_id, leaf); a range numbers its
   rows, and the sums of the ranges before it give every leaf its place in its lang.
3. ``layers``: places are grouped into aligned subtrees, and each gives one stored node of the
   next layer. A layer has 1/512 of the nodes of the one below it.
4. ``proofs``: from the top layer down, a subtree and the path of its own top node (both
   stored) give the paths of its nodes. Only the subtrees that hold a wanted row are computed.

Defined results: a null lang is a group of its own before all others; null values count as
``-``, apart from empty ones; rows without an id come first in their lang; rows with one id
ascend by leaf digest, and equal rows stand side by side, each with its own proof; an empty
table has no leaves, no root and no proofs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, stored
from .places import placed

ARITY = 8
STEP = 3
SUBTREE = ARITY**STEP
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left: string, right: string>>"


@dataclass
class Manifest:
    """``layers[0]`` holds the placed leaves, the last one a node per lang; ``roots`` are the same
    layers over the subroots. ``subroots``: (lang, subroot), ``root``: one row or none."""

    layers: list[DataFrame]
    roots: list[DataFrame]
    subroots: DataFrame
    root: DataFrame


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(text: Column | str = "text") -> Column:
    """Digest of a row's fields, each as ``-`` or byte count, colon, value."""
    values = [F.col(c).cast("string") for c in FIELDS[:-1]] + [F.col(text) if isinstance(text, str) else text]
    written = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*written), 256)


def lower_cased(text: Column | str = "text") -> Column:
    return F.translate(text, UPPER, LOWER)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """grp, lang, doc_id, leaf, altered, copies: distinct leaves. ``altered`` is the leaf of the
    tampered text where ``tampered`` holds, else the leaf itself."""
    own, where = leaf(), F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    grp = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = docs.select(grp.alias("grp"), "lang", "doc_id", own.alias("leaf"), F.when(where, leaf(lower_cased())).alias("altered"))
    # Equal rows agree in all these columns. One hot row is thus one row after the shuffle.
    counted = rows.groupBy("grp", "lang", "doc_id", "leaf", "altered").agg(F.count(F.lit(1)).alias("copies"))
    return counted.withColumn("altered", F.coalesce("altered", "leaf"))


def in_subtrees(nodes: DataFrame) -> DataFrame:
    """A row per node and aligned subtree: equal rows that span several subtrees are cut there."""
    last = F.expr(f"(pos + copies - 1) div {SUBTREE}")
    cut = nodes.withColumn("block", F.explode(F.sequence(F.expr(f"pos div {SUBTREE}"), last)))
    low = F.greatest("pos", F.col("block") * SUBTREE)
    high = F.least(F.col("pos") + F.col("copies"), (F.col("block") + 1) * SUBTREE)
    return cut.withColumns({"pos": low, "copies": high - low})


def interior(nodes: list[str], total: int) -> list[list[str]]:
    """All levels of a subtree from its stored nodes up. A subtree among several ends after STEP
    levels; one that is its whole layer ends as soon as one node is left."""
    levels = [nodes]
    while len(levels[-1]) > 1 if total <= SUBTREE else len(levels) <= STEP:
        below = levels[-1]
        levels.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def _in_place(table: pa.Table) -> tuple[list[int], list[str]]:
    """Row numbers and digests of a subtree's nodes, equal rows listed, by place."""
    order = pc.sort_indices(table.column("pos")).to_pylist()
    copies, names = table.column("copies").to_pylist(), table.column("leaf").to_pylist()
    rows = [i for i in order for _ in range(copies[i])]
    return rows, [names[i] for i in rows]


def _top(table: pa.Table) -> pa.Table:
    total = table.column("total")[0].as_py()
    _, nodes = _in_place(table)
    node = interior(nodes, total)[-1][0]
    return pa.table(
        {
            "grp": table.column("grp").slice(0, 1),
            "pos": table.column("block").slice(0, 1),
            "leaf": pa.array([node]),
            "copies": pa.array([1], pa.int64()),
            "total": pa.array([-(-total // SUBTREE)], pa.int64()),
        }
    )


def layers(bottom: DataFrame) -> list[DataFrame]:
    """Stored layers from placed nodes up; the last has one node a group."""
    out = [stored(in_subtrees(bottom))]
    while True:
        top = out[-1].select("grp", "block", "pos", "leaf", "copies", "total").groupBy("grp", "block")
        above = top.applyInArrow(_top, "grp string, pos bigint, leaf string, copies bigint, total bigint")
        out.append(stored(above.withColumn("block", F.expr(f"pos div {SUBTREE}"))))
        if not out[-1].where("total > 1").limit(1).count():
            return out


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of a table. ``tampered`` marks rows whose altered leaf is kept beside their own."""
    own = layers(placed(leaves(docs, tampered), "doc_id", "leaf"))
    tops = own[-1].select("grp", F.col("leaf").alias("subroot"))
    over = tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("leaf"), F.lit(1).cast("bigint").alias("copies"))
    roots = layers(placed(over, "name"))
    names = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
    return Manifest(own, roots, tops.withColumn("lang", names), roots[-1].select(F.col("leaf").alias("root")))


def _pairs(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For every node of a subtree the siblings to its left and right on each level up to its top."""
    beyond: list[list[tuple[str, str]]] = [[]]
    for level in reversed(levels[:-1]):
        now = []
        for i in range(len(level)):
            run = i - i % ARITY
            now.append([("".join(level[run:i]), "".join(level[i + 1 : run + ARITY])), *beyond[i // ARITY]])
        beyond = now
    return beyond


def _paths(carried: list[str]):
    def work(key, nodes: pa.Table, above: pa.Table) -> pa.Table:
        names = [*carried, "pos", "path"]
        if not nodes.num_rows or not above.num_rows:
            return pa.table({c: nodes.column(c).slice(0, 0) for c in [*carried, "pos"]} | {"path": above.column("path").slice(0, 0)})
        rows, digests = _in_place(nodes)
        upper = [(p["left"], p["right"]) for p in above.column("path")[0].as_py()]
        found = [p + upper for p in _pairs(interior(digests, nodes.column("total")[0].as_py()))]
        flat = [p for path in found for p in path]
        pairs = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.string()), pa.array([p[1] for p in flat], pa.string())], names=["left", "right"])
        ends = [0]
        for path in found:
            ends.append(ends[-1] + len(path))
        first = nodes.column("block")[0].as_py() * SUBTREE
        out = nodes.select(carried).take(pa.array(rows, pa.int64()))
        out = out.append_column("pos", pa.array(range(first, first + len(rows)), pa.int64()))
        return out.append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)).select(names)

    return work


def _descend(layer: DataFrame, above: DataFrame, *carried: str) -> DataFrame:
    """Paths of a layer's nodes: (grp, carried, pos, path) from (grp, block, path) of their subtrees' tops."""
    columns = ["grp", *carried]
    schema = ", ".join(f"{c} {layer.schema[c].dataType.simpleString()}" for c in columns)
    held = dict.fromkeys([*columns, "leaf", "block", "pos", "copies", "total"])
    return (
        layer.select(*held).groupBy("grp", "block").cogroup(above.select("grp", "block", "path").groupBy("grp", "block"))
        .applyInArrow(_paths(columns), f"{schema}, pos bigint, path {PATH}")
    )


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """grp, doc_id, leaf, altered, pos, path: a row per leaf, its siblings from level to level up to the root.

    ``wanted`` (doc_id) restricts the work to the subtrees that hold these documents. The paths
    of the upper layers, 1/512 of the leaves and fewer, are stored; those of leaves are not."""
    own, over = list(manifest.layers), list(manifest.roots)
    if wanted is not None:
        ids = wanted.select("doc_id").distinct()
        asked = stored(own[0].join(ids, "doc_id", "left_semi").select("grp", "block").distinct())
        needed = asked
        for k in range(len(own) - 1):
            own[k] = own[k].join(needed, ["grp", "block"], "left_semi")
            needed = needed.select("grp", F.expr(f"block div {SUBTREE}").alias("block")).distinct()
    nothing = F.array().cast(PATH)
    path = over[-1].select("grp", F.col("pos").alias("block"), nothing.alias("path"))
    for layer in reversed(over[1:-1]):
        path = _descend(layer, path).select("grp", F.col("pos").alias("block"), "path")
    path = _descend(over[0], path, "name").select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("block"), "path")
    for layer in reversed(own[1:-1]):
        path = _descend(layer, stored(path)).select("grp", F.col("pos").alias("block"), "path")
    out = _descend(own[0], stored(path), "doc_id", "leaf", "altered")
    return out if wanted is None else out.join(ids, "doc_id", "left_semi")


def siblings(path: Column | str = "path") -> Column:
    """The siblings' digests in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(leaf_: Column | str, path: Column | str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    start = F.col(leaf_) if isinstance(leaf_, str) else leaf_
    return F.aggregate(path, start, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


def audit(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row."""
    manifest = build(docs, tampered)
    root = manifest.root.first()  # one digest, or none for an empty table
    tops = manifest.subroots.select("grp", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"))
    proved = proofs(manifest).select("grp", "doc_id", "leaf", F.sha2(siblings(), 256).alias("proof_sha256"), folded("altered").alias("folded_root"))
    out = proved.join(stored(tops), "grp").withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def every_third() -> Column:
    """Rows that the registered query tampers with: 3 divides the crc32 of the decimal id."""
    return F.pmod(crc_of_id(), F.lit(3)) == 0

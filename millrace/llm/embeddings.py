"""Near-duplicate vectors through a forest of random-projection trees.

Each tree splits the vectors recursively along random directions. A split lies in the widest
gap near the middle of a bounded sample of the node, and vectors close to it spill into both
sides. A node whose sample is one tight bunch is not cut any further. Trees are grown by
``LEVELS`` levels at a time: leaves that are still too large get a sample of their own and
are split again, until they fit or stop shrinking; those are compared as pairs of blocks.

Inside a leaf all cosines are computed in double precision. A pair counts in the first tree
in which its vectors share a leaf, so every link counts once without shuffling pairs: a task
returns one row per vector with its number of links and a spanning forest.

Defined results: vectors that are null, zero or hold null or non-finite components link with
nothing; vectors of different lengths link with nothing; equal vectors are one class and
link with each other; repeated rows of an id and vector are one row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored
from .components import components

COSINE = 0.9
TREES = 12
SAMPLE = 8_192  # sampled vectors for the first levels and for each leaf that is split again
LEAF = 320
LARGEST = 2_048  # vectors that one task compares with each other
LEVELS = 9
SPILL = 0.08  # share of a node's spread on each side of a split

_LEAF_ID = np.uint64(0x9E3779B97F4A7C15)


def _direction(tree: int, leaf: int, node: int, width: int) -> np.ndarray:
    out = np.random.default_rng([tree, leaf & 0xFFFFFFFFFFFFFFFF, node, width]).standard_normal(width)
    return out / np.linalg.norm(out)


def _child(leaf: int, node: int) -> int:
    """A 64-bit name for a node below a leaf of the levels before."""
    x = (np.array([leaf], dtype=np.int64).view(np.uint64) ^ np.uint64(node)) * _LEAF_ID
    x ^= x >> np.uint64(29)
    return int((x * _LEAF_ID).view(np.int64)[0])


def grow(vectors: np.ndarray, tree: int, leaf: int, levels: int, cosine: float = COSINE) -> dict[int, tuple[float, float]]:
    """(split, margin) of the inner nodes, numbered as in a heap; a node without a split is a leaf."""
    out, todo = {}, [(1, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if node >> levels or len(rows) < 8:
            continue
        part = vectors[rows]
        middle = part.mean(0)
        if (part @ middle >= cosine * max(np.linalg.norm(middle), 1e-300)).mean() > 0.5 and np.linalg.norm(middle) > 0.5:
            continue  # one tight bunch: cutting it would only lose links
        along = part @ _direction(tree, leaf, node, vectors.shape[1])
        ordered = np.sort(along)
        a, b = len(ordered) // 4, max(len(ordered) // 4 + 2, len(ordered) - len(ordered) // 4)
        gaps = np.diff(ordered[a:b])
        # of all gaps near the middle the widest, if it is wide; else the median
        at = a + int(np.argmax(gaps))
        if gaps.max() < 4 * (ordered[-1] - ordered[0]) / len(ordered):
            at = len(ordered) // 2 - 1
        split, margin = float(ordered[at] + ordered[at + 1]) / 2, SPILL * float(along.std())
        out[node] = (split, margin)
        todo += [(2 * node, rows[along <= split]), (2 * node + 1, rows[along > split])]
    return out


def descend(vectors: np.ndarray, tree: int, leaf: int, model: dict[int, tuple[float, float]]) -> list[tuple[int, np.ndarray]]:
    """(name of the leaf reached, rows); rows near a split reach several leaves."""
    out, todo = [], [(1, np.arange(len(vectors)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in model:
            out.append((_child(leaf, node), rows))
            continue
        split, margin = model[node]
        along = vectors[rows] @ _direction(tree, leaf, node, vectors.shape[1])
        todo += [(2 * node, rows[along <= split + margin]), (2 * node + 1, rows[along > split - margin])]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, scaled to length one in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    out = out / np.abs(out).max(axis=1, keepdims=True)  # against overflow of the squares
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _levels(n: int) -> int:
    return max(1, min(LEVELS, int(np.ceil(np.log2(max(2, n) / LEAF)))))


def _first_leaves(reps: DataFrame, n: int, width: int, trees: int, cosine: float) -> DataFrame:
    """(id, leaves): an array for each tree of the leaves below its first levels."""
    rows = max(64, min(SAMPLE, (32 << 20) // (8 * width)))
    sample = reps.orderBy(F.xxhash64("id"), "id").limit(rows).select("vector").toArrow()
    points = _matrix(sample.column("vector").combine_chunks())
    models = [grow(points, t, 0, _levels(n), cosine) for t in range(trees)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            points = _matrix(batch.column("vector"))
            leaves = [[[] for _ in models] for _ in range(len(points))]
            for t, model in enumerate(models):
                for leaf, rows in descend(points, t, 0, model):
                    for r in rows.tolist():
                        leaves[r][t].append(leaf)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaves, pa.list_(pa.list_(pa.int64())))], names=["id", "leaves"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "vector").mapInArrow(work, f"id {kind}, leaves array<array<bigint>>")


def _grow_leaf(cosine: float):
    def work(table: pa.Table) -> pa.Table:
        tree, leaf, n = (table.column(c)[0].as_py() for c in ("tree", "leaf", "n"))
        model = grow(_matrix(table.column("vector").combine_chunks()), tree, leaf, _levels(n), cosine)
        nodes = sorted(model)
        return pa.table(
            {
                "tree": pa.array([tree], pa.int32()), "leaf": pa.array([leaf], pa.int64()),
                "nodes": pa.array([nodes], pa.list_(pa.int64())),
                "splits": pa.array([[model[k][0] for k in nodes]], pa.list_(pa.float64())),
                "margins": pa.array([[model[k][1] for k in nodes]], pa.list_(pa.float64())),
            }
        )

    return work


def _descend_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their leaf's model go down to the leaves below."""
    for batch in slices(batches, 4096):
        points, ids, trees, after = _matrix(batch.column("vector")), [], [], []
        keys = list(zip(batch.column("tree").to_pylist(), batch.column("leaf").to_pylist()))
        for key in dict.fromkeys(keys):
            rows = np.array([k for k, x in enumerate(keys) if x == key])
            at = int(rows[0])
            model = dict(zip(batch.column("nodes")[at].as_py(), zip(batch.column("splits")[at].as_py(), batch.column("margins")[at].as_py())))
            for leaf, found in descend(points[rows], *key, model):
                ids += rows[found].tolist()
                trees += [key[0]] * len(found)
                after += [leaf] * len(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(ids, pa.int64())), pa.array(trees, pa.int32()), pa.array(after, pa.int64()), batch.column("leaf").take(pa.array(ids, pa.int64()))],
            names=["id", "tree", "leaf", "was"],
        )


def leaves(reps: DataFrame, trees: int = TREES, largest: int = LARGEST, cosine: float = COSINE) -> DataFrame:
    """(id, tree, leaf, n): the leaves of all vectors with their number of rows."""
    n, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = reps.schema["id"].dataType.simpleString()
    first = stored(_first_leaves(reps, n, width or 1, trees, cosine))
    placed = stored(first.select("id", F.posexplode("leaves").alias("tree", "leaf")).select("id", "tree", F.explode("leaf").alias("leaf")).withColumn("above", F.lit(n).cast("bigint")))
    done = None
    while True:
        sizes = placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("above").alias("above"))
        # a leaf that hardly shrank is one dense bunch and is compared in blocks
        sizes = stored(sizes.withColumn("split", (F.col("n") > largest) & (F.col("n") < 0.7 * F.col("above"))))
        rows = placed.drop("above").join(sizes.drop("above"), ["tree", "leaf"])
        ready = rows.where(~F.col("split")).select("id", "tree", "leaf", "n")
        done = ready if done is None else done.unionByName(ready)
        if not sizes.where("split").limit(1).count():
            return done
        again = stored(rows.where("split").select("id", "tree", "leaf", "n").join(reps.select("id", "vector"), "id"))
        few = again.where(F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / (SAMPLE // 4))) == 0)
        models = stored(
            few.groupBy("tree", "leaf").applyInArrow(_grow_leaf(cosine), "tree int, leaf bigint, nodes array<bigint>, splits array<double>, margins array<double>")
        )
        moved = again.join(models, ["tree", "leaf"]).select("id", "vector", "tree", "leaf", "nodes", "splits", "margins")
        below = moved.mapInArrow(_descend_rows, f"id {kind}, tree int, leaf bigint, was bigint")
        was = sizes.where("split").select("tree", F.col("leaf").alias("was"), F.col("n").alias("above"))
        placed = stored(below.join(was, ["tree", "was"]).select("id", "tree", "leaf", "above"))


def _compare(cosine: float):
    """All pairs of one leaf, or of two blocks of a large one, that share no earlier leaf."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, leaf, left, right = (k.as_py() for k in key)
        table = table.sort_by("id")
        points = _matrix(table.column("vector").combine_chunks())
        side = table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        # which earlier leaves a row is in: those of trees before, and of this tree those with a smaller name
        named = table.column("leaves").to_pylist()
        earlier = [[(t, x) for t, found in enumerate(row[: tree + 1]) for x in found if t < tree or x < leaf] for row in named]
        number: dict[tuple[int, int], int] = {}
        spots = [[number.setdefault(x, len(number)) for x in row] for row in earlier]
        marks = np.zeros((len(points), len(number)), dtype=np.float32)
        marks[np.repeat(np.arange(len(points)), [len(x) for x in spots]), [x for row in spots for x in row]] = 1
        marks = marks[:, marks.sum(axis=0) > 1]
        links, root = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        neighbours: list[np.ndarray] = []
        for at in range(0, len(points), 512):
            close = points[at : at + 512] @ points.T >= cosine
            a, b = np.nonzero(close & (marks[at : at + 512] @ marks.T == 0))
            a += at
            keep = (a != b) & ((side[a] != side[b]) if left != right else True)
            a, b = a[keep], b[keep]
            np.add.at(links, a, copies[b])
            neighbours += np.split(b, np.searchsorted(a, np.arange(at + 1, min(at + 512, len(points)))))
        for i in range(len(points)):
            if root[i] == i:
                todo = [i]
                while todo:
                    near = neighbours[todo.pop()]
                    fresh = near[(root[near] == near) & (near > i)]
                    root[fresh] = i
                    todo += fresh.tolist()
        ids = table.column("id").combine_chunks()
        return pa.table({"id": ids, "links": pa.array(links, pa.int64()), "root": ids.take(pa.array(root))})

    return work


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, largest: int = LARGEST) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    e = F.col("embedding")
    each = vectors.select("vec_id", e).distinct()
    size = F.aggregate(e, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (size > 0)
    usable = F.coalesce(fine, F.lit(False))
    # -0.0 and 0.0 are equal
    plain = F.transform(e, lambda x: x + F.lit(0.0).cast("float"))
    members = stored(each.where(usable).select("vec_id", plain.alias("vector")))
    results = []
    widths = [r[0] for r in members.select(F.size("vector").alias("w")).distinct().collect()]
    classes = stored(members.groupBy("vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    for width in widths:
        reps = classes.where(F.size("vector") == width)
        placed = stored(leaves(reps, trees, largest, cosine))
        of_tree = placed.groupBy("id", "tree").agg(F.collect_list("leaf").alias("l"))
        arrays = of_tree.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "l"))), lambda x: x["l"]).alias("leaves"))
        blocks = F.ceil(F.col("n") / (largest // 2)).cast("int")
        whole = F.when(F.col("n") <= largest, F.lit(1)).otherwise(blocks)
        rows = placed.withColumn("blocks", whole).join(reps, "id").join(arrays, "id")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "id", "vector", "copies", "leaves", "block", "tree", "leaf",
            F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        )
        results.append(rows.groupBy("tree", "leaf", "left", "right").applyInArrow(_compare(cosine), f"id {kind}, links bigint, root {kind}"))
    nothing = F.lit(0).cast("bigint")
    rest = each.where(~usable).groupBy("vec_id").agg(F.lit(1)).select("vec_id", nothing.alias("n_links"), F.col("vec_id").alias("component_id"))
    if not widths:
        return rest.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    compared = results[0]
    for more in results[1:]:
        compared = compared.unionByName(more)
    compared = stored(compared.groupBy("id", "root").agg(F.sum("links").alias("links")))
    united = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "id", "left").join(united, "id", "left")
    linked = members.join(of_class, "vector").select(
        "vec_id",
        (F.coalesce("links", nothing) + F.col("copies") - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    out = linked.unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

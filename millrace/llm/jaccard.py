"""Join of documents on the Jaccard similarity of their word n-grams through a MinHash LSH forest.

1. Documents with the same set of n-grams are one class; only its smallest id goes on.
2. Each class gets an ordered prefix of minima in each of ``trees`` trees. The depth at which the
   trees are cut into nodes is shortened level by level until an isolated pair exactly at the
   threshold is missed with at most ``1 - target``. Nodes of deeper levels lie inside the nodes
   of the last one, so only that level is grouped: for a fixed threshold the forest finds the
   same pairs as banding with one band a tree, and no prefix is shortened by itself.
3. Nodes with more than one class tie their members to the smallest one; the components of
   these ties are the candidate groups, so each text is sent to one group instead of every tree.
4. Inside a group all pairs are counted exactly from the n-grams. A large group, such as a
   chain of texts of which only neighbours are alike, is compared node by node instead if that
   takes fewer copies of texts; a pair then counts in the first tree in which it shares a node.
   Groups and nodes over ``block`` members are dealt out as pairs of blocks, so that no task
   holds more than two blocks. Tasks return one row per member (its number of links and a
   spanning forest of the links), never the pairs.

Words are split at white space and lower-cased; a text of fewer words than an n-gram is one
n-gram. Defined results: null texts and texts without words link with nothing; ids name
documents, so rows of one id are one document, whose text is the smallest one of these rows
if they differ in n-grams (a null text is empty); rows without an id are returned
without class and links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rows import quoted
from .common import id_and_text, slices, stored
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 32
MAX_DEPTH = 10
TARGET_RECALL = 0.99999
BLOCK = 1024
_CHUNK = 1 << 13

_MIX = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, TREES * MAX_DEPTH + WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float, trees: int, max_depth: int, target: float) -> int:
    """Shorten the prefix from its full depth until the recall at the threshold reaches the target."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


_HASHES = _WordHash()


def shingles(text: str, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = max(1, len(each) - size + 1)
    out = np.full(n, len(each) if len(each) < size else size, dtype=np.uint64)
    for k in range(min(size, len(each))):
        out = (out ^ (out >> np.uint64(29))) * _MIX[0, k] + each[k : k + n]
    return np.unique((out ^ (out >> np.uint64(32))) * _MIX[1, 0])


def signature(hashes: np.ndarray, trees: int, depth: int) -> list[bytes]:
    """One prefix per tree: its first ``depth`` minima in order, four bytes each. Prefixes of
    one tree sort like the paths of a trie, and a shorter prefix begins every longer one."""
    a, b = _MIX[0, : trees * depth, None], _MIX[1, : trees * depth, None]
    low = np.full(trees * depth, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[None, at : at + _CHUNK] * a + b
        low = np.minimum(low, (part >> np.uint64(32)).min(axis=1))
    return [row.tobytes() for row in low.astype(">u4").reshape(trees, depth)]


def _signed(docs: DataFrame, size: int, trees: int, depth: int) -> DataFrame:
    """doc_id, same (128 bits that name the set; null without words), prefixes of the trees."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same, prefixes = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, size)
                same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                prefixes.append(signature(hashes, trees, depth) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(prefixes, pa.list_(pa.binary()))], names=["doc_id", "same", "prefixes"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc_id {kind}, same binary, prefixes array<binary>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the number of common n-grams. Frequent n-grams go through a product of 0/1
    matrices in slices, rare ones through their few pairs."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets) if n else np.empty(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(every)))
    out = np.zeros(n * n, dtype=np.int64)
    for c in np.unique(count[(count > 1) & (count <= 24)]):
        rows = owner[edge[count == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        step = max(1, (1 << 21) // len(i))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a, b = part[:, i].ravel(), part[:, j].ravel()
            out += np.bincount(a * n + b, minlength=n * n)
    out = out.reshape(n, n)
    out += out.T
    often = np.flatnonzero(count > 24)
    for at in range(0, len(often), 2048):
        part = often[at : at + 2048]
        marks = np.zeros((n, len(part)), dtype=np.float32)
        for k, e in enumerate(part):
            marks[owner[edge[e] : edge[e] + count[e]], k] = 1
        out += (marks @ marks.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with at least the threshold, without the diagonal."""
    both = shared_counts(sets)
    size = np.array([len(s) for s in sets])
    out = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _verify(size: int, threshold: float):
    """One pair of blocks: links between its sides (or inside one block), as one row per member."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, tree, _, left, right = (k.as_py() for k in key)
        members: dict = {}
        for row in table.select(["doc_id", "text", "copies", "block", "prefixes"]).to_pylist():
            members.setdefault(row["doc_id"], row)
        rows = [members[i] for i in sorted(members)]
        link = linked([shingles(r["text"], size) for r in rows], threshold)
        copies = np.array([r["copies"] for r in rows])
        side = np.array([r["block"] for r in rows])
        counted = link & (side[:, None] != side[None, :]) if left != right else link.copy()
        for earlier in range(max(tree, 0)):  # pairs that share a node of an earlier tree count there
            _, code = np.unique([r["prefixes"][earlier] for r in rows], return_inverse=True)
            counted &= code[:, None] != code[None, :]
        root = list(range(len(rows)))
        for i in range(len(rows)):  # the smallest member reached: rows are in order of id
            if root[i] == i:
                todo = [i]
                while todo:
                    for j in np.flatnonzero(link[todo.pop()]).tolist():
                        if root[j] == j and j > i:
                            root[j] = i
                            todo.append(j)
        ids = [r["doc_id"] for r in rows]
        kind = table.schema.field("doc_id").type
        return pa.table({"doc_id": pa.array(ids, kind), "links": pa.array(counted @ copies, pa.int64()), "root": pa.array([ids[r] for r in root], kind)})

    return work


def deal(nodes: DataFrame, shared: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """node, component, tree, prefix, block, left, right: where each class is compared. ``tree``
    is -1 for a group compared as a whole, else the group is compared node by node."""
    copies = F.col("n") * F.ceil(F.col("n") / block)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > block).select("component", copies.alias("whole"))
    # Each member of a group shares a node, so groups up to a block take the fewest copies as a whole.
    by_node = shared.withColumnRenamed("b", "node").join(groups.join(large, "component"), "node")
    by_node = by_node.groupBy("component").agg(F.sum(copies).alias("parts"), F.first("whole").alias("whole"))
    split = stored(by_node.where("parts < whole").select("component"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    kept = groups.join(sizes.select("component", blocks), "component").join(split, "component", "left_anti")
    kept = kept.select("node", "component", F.lit(-1).alias("tree"), F.lit(b"").alias("prefix"), "blocks")
    if not split.isEmpty():
        parted = groups.join(split, "component").join(nodes.withColumnRenamed("class_id", "node"), "node")
        parted = parted.join(shared.select("tree", "prefix", blocks), ["tree", "prefix"])
        kept = kept.unionByName(parted.select("node", "component", "tree", "prefix", "blocks"))
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("node", "component", "tree", "prefix", "block", other.alias("other"))
    return dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")


def one_text(known: DataFrame, signed: DataFrame, sign) -> tuple[DataFrame, DataFrame]:
    """Texts and signatures with one set of n-grams for every id."""
    differs = (F.min("same") != F.max("same")) | ((F.count("same") > 0) & (F.count("same") < F.count(F.lit(1))))
    several = stored(signed.groupBy("doc_id").agg(differs.alias("differs")).where("differs").select("doc_id"))
    if several.isEmpty():
        return known, signed
    least = stored(known.join(several, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
    alone = known.join(several, "doc_id", "left_anti")
    return alone.unionByName(least), stored(signed.join(several, "doc_id", "left_anti").unionByName(sign(least)))


def join(
    docs: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH,
    target: float = TARGET_RECALL, block: int = BLOCK,
) -> DataFrame:
    """doc_id, class_id (smallest id with the same n-grams), n_links (other documents at or
    above the threshold, copies included), component_id (smallest id reached by links)."""
    texts = id_and_text(docs)
    known = texts.where(F.col("doc_id").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    depth = prefix_depth(threshold, trees, max_depth, target)
    sign = lambda part: _signed(part, size, trees, depth)
    known, signed = one_text(known, stored(sign(known)), sign)
    with_words = signed.where("same is not null")
    ids = with_words.select("same", "doc_id").distinct()
    classes = stored(with_words.groupBy("same").agg(F.min("doc_id").alias("class_id"), F.first("prefixes").alias("prefixes"))
                     .join(ids.groupBy("same").agg(F.count(F.lit(1)).alias("copies")), "same"))
    nodes = classes.select("class_id", F.posexplode("prefixes").alias("tree", "prefix"))
    shared = stored(nodes.groupBy("tree", "prefix").agg(F.min("class_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    ties = nodes.join(shared.drop("n"), ["tree", "prefix"]).where("class_id <> b").select(F.col("class_id").alias("a"), "b")
    groups = stored(components(ties))
    of_class = classes.select(F.col("class_id").alias("node"), "copies", "prefixes")
    members = deal(nodes, shared, groups, block).join(of_class, "node")
    members = members.withColumn("prefixes", F.when(F.col("tree") >= 0, F.col("prefixes")))
    pairs = members.join(known.withColumnRenamed("doc_id", "node"), "node").withColumnRenamed("node", "doc_id")
    checked = stored(
        pairs.groupBy("component", "tree", "prefix", "left", "right").applyInArrow(_verify(size, threshold), f"doc_id {kind}, links bigint, root {kind}")
    )
    links = checked.groupBy(F.col("doc_id").alias("class_id")).agg(F.sum("links").alias("links"))
    united = components(checked.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    of_class = classes.select("same", "class_id", "copies").join(links, "class_id", "left").join(
        united.withColumnRenamed("node", "class_id"), "class_id", "left"
    )
    # Copies of one text may be a large share of all rows; Spark splits that side of a skewed join.
    placed = signed.select("doc_id", "same").distinct().join(of_class, "same", "left")
    found = placed.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("bigint").alias("n_links"),
        F.coalesce("component", "class_id", "doc_id").alias("component_id"),
    )
    nameless = texts.where(F.col("doc_id").isNull())
    none = F.lit(None).cast(kind)
    return found.unionByName(nameless.select("doc_id", none.alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), none.alias("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """Of each group of near copies the document with the smallest id, with all its columns; of
    rows of one id the one with the smallest text, then the smallest other values. Rows without
    an id stay."""
    groups = join(docs, **options)
    kept = groups.where("doc_id = component_id").select("doc_id")
    nameless = docs.where(F.col("doc_id").isNull())
    ordered = (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType)
    plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, ordered) and f.name not in ("doc_id", "text")]
    order = F.struct(F.coalesce("text", F.lit("")), *map(quoted, plain))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*map(quoted, docs.columns)), order).alias("_row"))
    return one.select("_row.*").unionByName(nameless)

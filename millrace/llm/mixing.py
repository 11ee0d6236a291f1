"""Mixing sources to target weights by balanced sampling, the cube method.

A source that is to give r times its words takes each document floor(r) times, and once more
with probability r - floor(r). These inclusion probabilities are not drawn one by one: they move
together, along vectors of the null space of the balancing constraints (words and documents of
the source), until each is 0 or 1, so that both totals stay what they were.

1. Sizes, source totals and targets: targets are shares of all words by weight; what a source
   cannot give is shared again among the others until none is above its limit.
2. Flight: the documents of a source are dealt into chunks of about ``CHUNK``. In a chunk one
   more document than there are constraints is active at a time; a step along their null vector,
   at random in one of its two directions, settles at least one. At most two stay open.
3. What is open in all chunks of a source is dealt and moved again, with both totals still kept,
   until one chunk is left.
4. Landing: of that last chunk the flight leaves ``LANDING`` documents. They are rounded, the
   longest first and each against the error so far, then by flips that bring the words nearer
   to the target, then the number of documents.

Chunks, order and directions depend on ids, sizes and the seed alone: reruns agree, however the
rows are spread. Equal rows (id, source, size) are one unit with a count.

Defined results: null and empty texts have no words and take none; a null source is one source,
after all others; rows without an id and repeated rows are taken like any other, copies of a row
differ by at most one repeat; a source without words has the target 0; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .places import placed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
CHUNK = 4096
LANDING = 32
COPIES = 4096  # copies of one row that are listed by one task at a time
_NEAR = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """grp, source, doc_id, size: the number of words of every row."""
    grp = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # "=" sorts before "~": null is last
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(grp.alias("grp"), "source", "doc_id", words.alias("size"))


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """grp, source, source_size, target, whole, share: a row per source, stored. Every document is
    taken ``whole`` times, and once more with probability ``share``."""
    totals = sized.groupBy("grp", "source").agg(F.sum("size").alias("source_size"))
    nodes = totals.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "source", "source_size", F.lit(1).cast("bigint").alias("copies"))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("pos") % len(weights) + 1).cast("int"))
    ranked = stored(placed(nodes, "name").select("name", "source", "source_size", weight.cast("bigint").alias("weight")))

    wide = lambda c: c.cast("decimal(38,0)")
    limit, first = F.col("source_size") * most, ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    num, den = first[0] or 0, first[1] or 1
    while True:  # a level of num / den a weight: what lies above its limit goes there, the rest rises
        above = wide(F.col("weight")) * wide(F.lit(num)) > wide(limit) * wide(F.lit(den))
        sums = ranked.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (first[0] or 0) - (sums[0] or 0), sums[1] or 1
        if new[0] * den == num * new[1]:
            break
        num, den = new
    asked, given = wide(F.col("weight")) * wide(F.lit(num)), wide(F.col("source_size")) * wide(F.lit(den))
    whole = F.when(above, most).when(F.col("source_size") > 0, F.call_function("div", asked, given)).otherwise(0)
    share = F.when(above | (F.col("source_size") == 0), 0.0).otherwise((asked - wide(F.col("whole")) * given).cast("double") / given.cast("double"))
    target = F.when(above, limit.cast("double")).otherwise(asked.cast("double") / F.lit(float(den)))
    out = ranked.withColumn("whole", whole.cast("bigint")).withColumn("share", share).withColumn("target", target)
    return stored(out.select(F.col("name").alias("grp"), "source", "source_size", "target", "whole", "share"))


def null_vector(columns: list[Sequence[float]]) -> list[float]:
    """A vector other than 0 that the matrix of these columns, one more than rows, takes to 0."""
    rows = [list(r) for r in zip(*columns)]
    n = len(columns)
    for c in range(n):
        best = max(range(c, len(rows)), key=lambda k: abs(rows[k][c]), default=None)
        if best is None or abs(rows[best][c]) < 1e-12:  # all columns before are reduced to unit vectors
            return [-rows[k][c] for k in range(c)] + [1.0] + [0.0] * (n - c - 1)
        rows[c], rows[best] = rows[best], rows[c]
        head = rows[c][c]
        pivot = rows[c] = [x / head for x in rows[c]]
        for k, row in enumerate(rows):
            if k != c and row[c]:
                by = row[c]
                rows[k] = [x - by * y for x, y in zip(row, pivot)]
    raise AssertionError("more rows than columns")


def flight(values: list[Sequence[float]], pi: list[float], rng: random.Random, leave: int = 0) -> list[float]:
    """Move ``pi`` in the null space of the constraints whose coefficients are ``values`` until at
    most as many are open as there are constraints, or ``leave`` if that is more."""
    if not pi:
        return []
    pi, width = list(pi), len(values[0])
    scale = [max(abs(v[j]) for v in values) or 1.0 for j in range(width)]
    values = [[x / s for x, s in zip(v, scale)] for v in values]
    waiting = [i for i in reversed(range(len(pi))) if _NEAR < pi[i] < 1 - _NEAR]
    active: list[int] = []
    while True:
        while waiting and len(active) <= width:
            active.append(waiting.pop())
        if len(active) <= width or len(active) + len(waiting) <= leave:
            return [0.0 if p <= _NEAR else 1.0 if p >= 1 - _NEAR else p for p in pi]
        u = null_vector([values[i] for i in active])
        up = min((1 - pi[i]) / x if x > 0 else -pi[i] / x for i, x in zip(active, u) if x)
        down = min(pi[i] / x if x > 0 else (pi[i] - 1) / x for i, x in zip(active, u) if x)
        step = up if rng.random() * (up + down) < down else -down  # the mean of both ways is 0
        for i, x in zip(active, u):
            pi[i] += step * x
        active = [i for i in active if _NEAR < pi[i] < 1 - _NEAR]


def landing(sizes_: list[int], pi: list[float]) -> list[float]:
    """Round what is still open so that the words come near their total, then the documents."""
    pi, open_ = list(pi), [i for i, p in enumerate(pi) if 0 < p < 1]
    words = docs = 0.0
    for i in sorted(open_, key=lambda i: -sizes_[i]):
        take, leave = (words + (1 - pi[i]) * sizes_[i], docs + 1 - pi[i]), (words - pi[i] * sizes_[i], docs - pi[i])
        better = (abs(take[0]), abs(take[1])) < (abs(leave[0]), abs(leave[1]))
        (words, docs), pi[i] = (take, 1.0) if better else (leave, 0.0)
    flips = [(i,) for i in open_] + [(i, j) for k, i in enumerate(open_) for j in open_[:k]]
    while True:
        best, error = None, (round(abs(words), 6), round(abs(docs), 6))
        for flip in flips:
            w = words + sum((1 - 2 * pi[i]) * sizes_[i] for i in flip)
            d = docs + sum(1 - 2 * pi[i] for i in flip)
            if (new := (round(abs(w), 6), round(abs(d), 6))) < error:
                best, error, after = flip, new, (w, d)
        if best is None:
            return pi
        words, docs = after
        for i in best:
            pi[i] = 1 - pi[i]


def _move(seed: int, round_: int, leave: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("order", "size", "doc_id", "copies")])
        size, pi = table.column("size").to_pylist(), table.column("pi").to_pylist()
        grp, chunk, last = (table.column(c)[0].as_py() for c in ("grp", "chunk", "last"))
        rng = random.Random(f"{seed}/{round_}/{chunk}/{grp}")
        pi = flight([(s, 1.0) for s in size], pi, rng, leave if last else 0)
        if last:
            pi = landing(size, pi)
        out = table.select(["grp", "doc_id", "size", "copies", "times"])
        return out.append_column("pi", pa.array(pi, pa.float64()))

    return work


def cube(units: DataFrame, seed: int = 0, chunk: int = CHUNK, leave: int = LANDING) -> DataFrame:
    """grp, doc_id, size, copies, times of all units, with 1 added to ``times`` where the sample has the
    unit. ``pi`` is the probability; units of a ``grp`` are balanced in words (``size``) and number."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    fractional = (F.col("pi") > 0) & (F.col("pi") < 1)
    settled = lambda df: df.where(~fractional).withColumn("times", F.col("times") + F.col("pi").cast("bigint")).drop("pi")
    units = stored(units)
    done, rest, round_ = [settled(units)], units.where(fractional), 0
    while True:
        counts = stored(rest.groupBy("grp").agg(F.expr(f"(count(1) + {chunk - 1}) div {chunk}").alias("chunks")))
        if not counts.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        order = F.xxhash64("doc_id", "size", "grp", F.lit(seed), F.lit(round_))
        dealt = rest.join(counts, "grp").withColumns(
            {"chunk": F.pmod(order, F.col("chunks")), "order": F.xxhash64(order), "last": F.col("chunks") == 1}
        )
        moved = stored(dealt.drop("chunks").groupBy("grp", "chunk").applyInArrow(_move(seed, round_, leave), schema))
        done.append(settled(moved))
        rest, round_ = moved.where(fractional), round_ + 1


def _listed(units: DataFrame) -> DataFrame:
    """A row per document again. Copies of a row share its repeats as evenly as can be; many copies
    are listed by many tasks."""
    one = units.where("copies = 1").drop("copies")
    many = units.where("copies > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})"))).repartition("doc_id", "part")
    last = F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1
    copy = many.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, last)))
    times = F.expr("times div copies") + (F.col("copy") < F.expr("times % copies")).cast("bigint")
    return one.unionByName(copy.withColumn("times", times).select(*one.columns))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, chunk: int = CHUNK, leave: int = LANDING) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: how often the mix takes each document."""
    sized = stored(sizes(docs).groupBy("grp", "source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")))
    weighed = sized.withColumn("size", F.col("size") * F.col("copies"))
    wanted = targets(weighed, weights, most)
    # The copies of a row are taken share * copies times: the whole part now, the rest by the sample.
    more = F.col("share") * F.col("copies")
    units = sized.drop("source").join(wanted.select("grp", "whole", "share"), "grp").select(
        "grp", "doc_id", "size", "copies",
        (F.col("whole") * F.col("copies") + F.floor(more)).alias("times"),
        F.when(F.col("size") > 0, more - F.floor(more)).otherwise(0.0).alias("pi"),
    )
    taken = _listed(cube(units, seed, chunk, leave)).join(wanted, "grp")
    return taken.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
